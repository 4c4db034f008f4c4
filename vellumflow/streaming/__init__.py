"""streaming of vellumflow."""
