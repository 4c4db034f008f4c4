"""vellumflow: Spark-first corpus analytics for historical text collections."""

__version__ = "0.1.0"
