"""Structured Streaming over request logs."""
