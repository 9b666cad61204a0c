"""Spark-first analytics for news and document intelligence."""
