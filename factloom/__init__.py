"""A rule engine for fact graphs, on PySpark DataFrames."""
