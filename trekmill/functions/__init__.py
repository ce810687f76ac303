"""Column functions: text, geography, clock and metrics."""
