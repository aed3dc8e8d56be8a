"""Structured Streaming jobs and their state functions."""
