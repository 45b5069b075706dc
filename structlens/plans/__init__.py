"""The query catalogue over the benchmark tables."""
