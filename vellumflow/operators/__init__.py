"""operators of vellumflow."""
