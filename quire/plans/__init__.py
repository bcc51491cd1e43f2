"""Plans of the manuscript engine."""
