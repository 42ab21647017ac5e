"""Spark-native validation and exploratory analysis of precinct election returns.

A flagged record is unusual under a stated model; it is not evidence of error or
misconduct. Every method reports an explicit status and no composite score exists.
"""

__version__ = "0.1.0"
