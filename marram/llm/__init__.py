"""Operators for preparing training text: ten Spark jobs over documents and pages.

Nothing outside this package imports it.
"""
