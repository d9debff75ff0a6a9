"""Spark-native analytics for labelled observation tables and time series.

Every operator takes a DataFrame plus column names and returns a DataFrame.
"""

__version__ = "0.1.0"
