"""Lodestar: a PySpark-native engine for record-discovery pipelines.

Every operator is a function from DataFrames to DataFrames. Importing the package starts nothing.
"""

__version__ = "0.1.0"
