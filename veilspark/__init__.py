"""Spark-native PII detection, redaction, span decoding and timing metrics."""

__version__ = "0.1.0"
