"""Functions of the manuscript engine."""
