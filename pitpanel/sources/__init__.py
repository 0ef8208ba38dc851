"""Landed files to typed tables, and snapshots with provenance."""
