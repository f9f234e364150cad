"""Structured Streaming: incremental ingest, transfer states and counters."""
