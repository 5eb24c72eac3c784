"""marram.functions"""
