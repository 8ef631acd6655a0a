"""Job-posting analytics expressed as Spark DataFrame and Column functions."""

__version__ = "0.1.0"
