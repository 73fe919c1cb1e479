"""Streaming feed of the finding catalog."""
