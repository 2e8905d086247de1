"""Operators of the ledger: DataFrames and parameters in, a DataFrame out."""
