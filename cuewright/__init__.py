"""Timed-text, document and processing-log analytics on PySpark."""
