"""Composed plans and the query catalog used by ``__spark_entry__``."""
