"""functions of fathomline."""
