"""keepwell: state-retention analytics on PySpark DataFrames."""
