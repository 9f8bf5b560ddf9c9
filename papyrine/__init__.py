"""Papyrine: a Spark-first engine for profiling, cleaning, ranking and extracting from document tables."""
