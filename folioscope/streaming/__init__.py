"""Structured Streaming jobs: incremental ingest and period totals."""
