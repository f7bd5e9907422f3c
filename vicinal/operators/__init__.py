"""Operators on DataFrames: vectors, neighbours, forests, scores and their evaluation."""
