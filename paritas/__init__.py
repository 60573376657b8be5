"""Table reconciliation and data-quality checks as lazy Spark DataFrame jobs."""

__version__ = "0.1.0"
