"""Relational steps of record linkage; every function takes and gives DataFrames or Columns."""
