"""marram.operators"""
