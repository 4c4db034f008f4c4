"""functions of vellumflow."""
