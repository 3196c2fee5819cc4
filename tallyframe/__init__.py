"""Tallyframe: messy tables in, ranked findings out, planned by Spark.

Every operator takes DataFrames and returns DataFrames; nothing here collects
data whose size follows the input.
"""

__version__ = "0.1.0"
