"""Spark-first analytics for discussion data, market series and training corpora."""
