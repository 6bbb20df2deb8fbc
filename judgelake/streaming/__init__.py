"""Structured Streaming jobs over the append-only ledger."""
