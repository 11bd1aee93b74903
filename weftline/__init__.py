"""Spark-first analytics over mixed image-text corpora and their evaluation data."""
