"""Records that arrive over time."""
