"""Operators that a large text-corpus pipeline needs, as Spark jobs."""
