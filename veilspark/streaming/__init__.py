"""Policies on Structured Streaming."""
