"""streaming of fathomline."""
