"""Reading source trees, texts, diffs and TOML; writing indexes, caches and graphs."""
