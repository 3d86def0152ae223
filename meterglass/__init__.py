"""Usage analytics and training-data operators as Spark jobs."""

__version__ = "0.1.0"
