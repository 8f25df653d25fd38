"""Structured Streaming form of the screening job."""
