"""sources of fathomline."""
