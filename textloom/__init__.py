"""Text analytics on PySpark."""
