"""Citation-ledger analytics on Spark: every operator takes and returns DataFrames or Columns."""

__version__ = "0.1.0"
