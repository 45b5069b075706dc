"""Structural questions about text and source corpora, answered with Spark."""
