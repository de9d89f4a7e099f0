"""Spark-first corpus graph and survey analytics: DataFrames in, DataFrames out."""
