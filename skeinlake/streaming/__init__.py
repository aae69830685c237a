"""Structured Streaming forms of incremental indexing and session ageing."""
