"""Operators on files, lines, symbols, tokens, regions and graphs."""
