"""Spark-first engine for text that lives inside images, and for corpus preparation."""
