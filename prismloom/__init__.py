"""Spark-first analytics for multimodal datasets."""
