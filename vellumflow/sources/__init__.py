"""sources of vellumflow."""
