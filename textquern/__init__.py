"""Spark-native text analytics and multi-label classification on DataFrames."""

__version__ = "0.1.0"
