"""Structured Streaming ingestion (an extension)."""
