"""Streaming forms of the grouping by gaps and of windowed profiles."""
