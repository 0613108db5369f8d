"""Batch retrieval over document collections, and corpus preparation, on Spark."""
