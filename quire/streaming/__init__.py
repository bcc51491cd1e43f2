"""Streaming of the manuscript engine."""
