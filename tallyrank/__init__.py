"""Ranking analytics on Spark: interactions, retrieval, recommendation, metrics and tests as DataFrame functions."""
