"""Structured Streaming forms of the statistics job and of hit ingestion."""
