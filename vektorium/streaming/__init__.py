"""Structured Streaming ingestion and event-time operators."""
