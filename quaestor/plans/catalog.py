"""Loads every registered query."""

from quaestor.plans import (  # noqa: F401
    queries_evidence,
    queries_pipeline,
    queries_rank,
    queries_search,
    queries_spans,
    queries_stream,
    queries_text,
)


def flagship(spark, folder):
    return queries_search.rrf_fusion(spark, folder)
