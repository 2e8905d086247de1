"""Incremental ingest: the tail of log files into snapshots, batch by batch."""
