"""Lectio: full-text search, ranking and corpus operators as Spark DataFrame plans."""
