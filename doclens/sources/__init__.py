"""Scans, file ingestion and sinks."""
