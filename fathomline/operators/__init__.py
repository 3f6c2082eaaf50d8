"""operators of fathomline."""
