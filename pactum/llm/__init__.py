"""Training-data operators: ten corpus operations built on Spark DataFrames.

Nothing outside this subpackage imports it.
"""
