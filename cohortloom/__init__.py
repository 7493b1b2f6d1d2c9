"""Spark-first analytics for multimodal sensor studies."""
