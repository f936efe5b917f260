"""Spark-native analytics for healthcare and operations data.

Every public function takes DataFrames and returns a DataFrame (or Columns);
dates that the caller would read off a clock are passed in as ``as_of``.
"""

__version__ = "0.1.0"
