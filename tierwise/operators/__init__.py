"""Row-level and per-entity operators."""
