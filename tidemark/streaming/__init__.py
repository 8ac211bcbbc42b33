"""Structured Streaming forms of the live-board operators."""
