"""Readers and writers for observations, events, parameters and results."""
