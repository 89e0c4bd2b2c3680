"""foliant: page-layout analytics on PySpark DataFrames."""
