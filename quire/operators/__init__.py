"""Operators of the manuscript engine."""
