"""Text-safety scanning for Spark: screening, views, detection, redaction, correlation."""
