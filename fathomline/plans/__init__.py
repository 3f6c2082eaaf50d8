"""plans of fathomline."""
