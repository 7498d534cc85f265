"""setweave: set expansion over semi-structured pages, and the data processing around it, on Spark."""

__version__ = "0.1.0"
