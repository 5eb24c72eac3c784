"""marram.streaming"""
