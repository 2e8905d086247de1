"""Agent-usage analytics on Spark: a ledger of token events and the reports over it."""
