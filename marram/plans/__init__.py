"""marram.plans"""
