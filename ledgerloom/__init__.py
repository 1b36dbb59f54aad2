"""Ledger analytics on Spark: trades, transfer graphs, balances, messages and stored objects."""
