"""Feedback and limits as Structured Streaming."""
