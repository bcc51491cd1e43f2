"""Sources of the manuscript engine."""
