"""Exact nearest neighbours.

Every corpus vector meets every query vector inside a task, as matrix products of bounded size; only the best k per query
and partition leave the task, and the final choice is a pruned window.  Query vectors travel as broadcast blocks of
bounded size; a larger query table is worked off block by block, so no block outgrows memory.
"""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.operators.lexical import top_k

BLOCK_BYTES = 64 << 20
#: Bytes of one score matrix (queries x corpus vectors) inside a task.
MATRIX_BYTES = 32 << 20


def best_of(score: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns per row, ties by document; docs has one row per query."""
    if score.shape[1] > 4 * k:  # the k-th best value decides who is sorted at all
        edge = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
        width = int((score >= edge).sum(1).max())
        pick = np.argsort(-(score >= edge).astype(np.int8), axis=1, kind="stable")[:, :width]
        score, docs = np.take_along_axis(score, pick, 1), np.take_along_axis(docs, pick, 1)
    order = np.lexsort((docs, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(docs, order, 1)


def _block_search(block, dims: int, k: int, matrix_bytes: int):
    def run(batches):
        ids, q, scope = block.value
        best_score, best_docs, seen = None, None, False
        step = max(k, matrix_bytes // (8 * max(1, len(ids))))
        for pdf in batches:
            if pdf.empty:
                continue
            if any(len(v) != dims for v in pdf["embedding"]):
                raise ValueError(f"corpus vectors must have {dims} values")
            for a in range(0, len(pdf), step):
                part = pdf.iloc[a : a + step]
                v = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
                score = np.round((1.0 + q @ v.T) / 2.0, 6)
                if scope is not None:
                    score[scope[:, None] != part["idx"].to_numpy()] = -np.inf
                docs = np.broadcast_to(part["doc_id"].to_numpy(), score.shape)
                if seen:  # a running best k: what leaves the task does not grow with the partition
                    score, docs = np.concatenate([best_score, score], 1), np.concatenate([best_docs, docs], 1)
                best_score, best_docs = best_of(score, docs, k)
                seen = True
        if seen:
            n = best_score.shape[1]
            out = {"query_id": np.repeat(ids, n), "doc_id": best_docs.ravel(), "score": best_score.ravel()}
            out |= {} if scope is None else {"idx": np.repeat(scope, n)}
            yield pd.DataFrame(out)[np.isfinite(best_score.ravel())]

    return run


def knn(
    corpus: DataFrame, queries: DataFrame, k: int = 50, block_bytes: int = BLOCK_BYTES, matrix_bytes: int = MATRIX_BYTES
) -> DataFrame:
    """query_id, doc_id, score, rank with score (1 + cosine) / 2.  corpus: doc_id, embedding.

    Queries with a column idx meet only the vectors of that idx; the same pass serves all of them.
    """
    spark = corpus.sparkSession
    shape = queries.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("hi"), F.min(F.size("embedding")).alias("lo")
    ).first()
    id_type = queries.schema["query_id"].dataType.simpleString()
    doc_type = corpus.schema["doc_id"].dataType.simpleString()
    scope = [c for c in queries.columns if c == "idx"]
    schema = f"query_id {id_type}, doc_id {doc_type}, score double" + ", idx string" * len(scope)
    if not shape["n"]:
        return spark.createDataFrame([], schema + ", rank int")
    dims = shape["hi"]
    if shape["lo"] != dims:
        raise ValueError("query vectors differ in width")
    rows_per_block = max(1, block_bytes // (8 * dims))
    n_blocks = -(-shape["n"] // rows_per_block)
    # hash blocks: each holds about rows_per_block vectors, whatever the ids look like
    numbered = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))
    parts = []
    for b in range(n_blocks):
        pdf = numbered.where(F.col("_block") == b).select("query_id", "embedding", *scope).toPandas()
        if pdf.empty:
            continue
        q = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        q = np.divide(q, norm, out=np.zeros_like(q), where=norm > 0)
        block = spark.sparkContext.broadcast((pdf["query_id"].to_numpy(), q, pdf["idx"].to_numpy() if scope else None))
        parts.append(corpus.select("doc_id", "embedding", *scope).mapInPandas(_block_search(block, dims, k, matrix_bytes), schema))
    return top_k(reduce(DataFrame.unionByName, parts), k)
