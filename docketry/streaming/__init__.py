"""Incremental extraction, catalog updates and job status with Structured Streaming."""
