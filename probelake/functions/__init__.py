"""Column functions and the mergeable latency sketch."""
