"""Structured Streaming scoring with fitted parameters."""
