"""Retrieval analytics on Spark: queries x documents x vectors as set-oriented jobs."""

__version__ = "0.1.0"
