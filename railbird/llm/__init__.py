"""Operators of a training-data pipeline.

Every operator takes DataFrames and returns a DataFrame.  Nothing else in the
library imports this subpackage.
"""
