"""Incremental forms of the aggregates that merge."""
