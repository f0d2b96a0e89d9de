"""Order-based retail analytics as composable Spark DataFrame transformations."""

__version__ = "0.1.0"
