"""Similarity-based scoring of transactions on Spark."""
