"""Cartolith: code-intelligence analytics expressed as Spark plans.

Every operator is a function from DataFrames to a DataFrame.  Nothing here
collects data to the driver except results whose size is bounded by a
documented parameter.
"""

__version__ = "0.1.0"
