"""marram.sources"""
