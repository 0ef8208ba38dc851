"""Structured Streaming forms of the gate, the business-day aggregate and the upsert."""
