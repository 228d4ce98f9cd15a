"""Structured Streaming forms of the checkpoint operators."""
