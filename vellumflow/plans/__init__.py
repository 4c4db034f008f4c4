"""plans of vellumflow."""
