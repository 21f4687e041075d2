"""Specs, runs that compose operators, the query catalogue and the hot-key join."""
