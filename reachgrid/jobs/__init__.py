"""jobs of the library."""
