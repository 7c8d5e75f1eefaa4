"""Incremental maintenance of fact tables with Structured Streaming."""
