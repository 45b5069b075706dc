"""Incremental and streaming maintenance of the symbol index."""
