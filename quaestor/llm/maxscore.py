"""Exact top-k by inner product with MaxScore over postings of dimensions.

A dimension is a term and a vector's component its impact.  A query's terms are ordered by the most they can add within a
block of vectors (impacts may be negative, so the bound is taken at both ends of the term's range).  Terms whose bounds
together do not exceed the query's current k-th best score are non-essential: no vector can win by them alone.  The
essential postings are traversed; a vector goes on to be probed in the others, in descending order of their bounds, only
while what it has and what is left to gain exceed the k-th best.  Vectors come in ascending id, so a later one needs more
than the k-th best, not as much.

Vectors are dealt evenly to shards and queries to groups that fit in memory; every (shard, group) cell is one task, which
holds its group and streams its shard in blocks.  Each cell gives k rows a query, and shards are merged by a window.
Neither a vector nor an id that many rows share can fill a cell, since rows are dealt by their place in the table.

Defined results.  Rows whose id or vector is null, or whose vector holds null or non-finite components, take no part.  An
empty vector takes part; vectors of unequal length are compared over the shorter one.  A row is no candidate for queries of
its own id.  Repeated rows are candidates each, and queries each.  Components and
scores beyond 64 bits are held at the limit.  An empty table gives no rows.  Other columns are not read.  The input should be a table scan or another plan
that gives its rows in the same order when a task runs again.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most bytes of the queries that a task holds and of the vectors it compares at a time, in doubles.
QUERY_BYTES = 16 << 20
BLOCK_BYTES = 2 << 20
#: Rows of a shard, as long as no more than SHARDS are needed; larger tables have larger shards, which are streamed.
SHARD_ROWS = 8192
SHARDS = 1024
#: Terms probed at a time, queries split into terms at a time.
PROBE = 8
SPLIT = 1024
#: Postings shorter than this part of a block are kept as lists of places.
SPARSE = 0.25
_LIMITS = (-(1 << 63), (1 << 63) - 1)


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id and terms, floor(scale * component) in doubles, of the vectors that take part."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    terms = F.transform(vec_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("id"), terms.alias("terms")
    )


def _matrix(terms: pa.ListArray, width: int) -> np.ndarray:
    """One row a vector, zeros beyond its own length."""
    sizes = np.diff(terms.offsets.to_numpy())
    values = terms.flatten().to_numpy()
    if len(sizes) and sizes.min() == width:
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


class Postings:
    """A block of vectors, ascending by id, as one posting list a term."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.n = ids, len(ids)
        self.rows = np.ascontiguousarray(vectors.T)
        self.high, self.low = self.rows.max(1, initial=0), self.rows.min(1, initial=0)  # a vector without the term adds 0
        filled = [np.flatnonzero(row) for row in self.rows]
        self.places = filled if sum(map(len, filled)) < SPARSE * self.rows.size else None

    def traverse(self, weights: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """What the terms add to every vector."""
        if not len(terms):
            return np.zeros(self.n, self.rows.dtype)
        if self.places is None:
            return weights[terms] @ self.rows[terms]
        sums = np.zeros(self.n, self.rows.dtype)
        for t in terms:
            sums[self.places[t]] += weights[t] * self.rows[t, self.places[t]]
        return sums

    def probe(self, weights: np.ndarray, terms: np.ndarray, at: np.ndarray) -> np.ndarray:
        return weights[terms] @ self.rows[np.ix_(terms, at)]


class Search:
    """The best k of every query of a group over the blocks seen so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(ids)  # scores, descending, and their ids
        self.full = np.zeros(len(ids), bool)
        self.least = np.zeros(len(ids), np.int64)  # of those that are full
        self.reach = _reach(queries)
        self.work = self.plain = 0  # products made, and without any bound

    def block(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Look at more vectors, of higher ids than before."""
        whole = self.reach * _reach(vectors) * max(1, self.queries.shape[1]) < 1 << 53  # exact in doubles as far as that
        kind = np.float64 if whole else object
        postings = Postings(ids, vectors.astype(kind))
        for at in range(0, len(self.ids), SPLIT):
            self._split(postings, range(at, min(at + SPLIT, len(self.ids))), self.queries[at : at + SPLIT].astype(kind))

    def _split(self, postings: Postings, rows: range, queries: np.ndarray) -> None:
        bounds = np.maximum(queries * postings.high, queries * postings.low)
        order = np.argsort(bounds, axis=1, kind="stable")
        sums = np.cumsum(np.take_along_axis(bounds, order, 1), axis=1)  # ascending, as no bound is negative
        least, full = self.least[rows.start : rows.stop, None], self.full[rows.start : rows.stop, None]
        idle = ((sums <= least).astype(bool) & full).sum(1)
        for q, weights, terms, gain, free in zip(rows, queries, order, sums, idle.tolist()):
            self.plain += len(terms) * postings.n
            if free < len(terms) or not self.full[q]:
                self._query(q, postings, weights, terms, gain, free)

    def _query(self, q: int, postings: Postings, weights: np.ndarray, terms: np.ndarray, gain: np.ndarray, free: int) -> None:
        least, full = self.least[q], self.full[q]
        scores = postings.traverse(weights, terms[free:])
        self.work += (len(terms) - free) * postings.n
        alive = (scores + (gain[free - 1] if free else 0) > least).astype(bool) if full else np.ones(postings.n, bool)
        alive[np.searchsorted(postings.ids, self.ids[q]) : np.searchsorted(postings.ids, self.ids[q], "right")] = False
        at = np.flatnonzero(alive)
        scores = scores[at]
        while free and len(at):
            more = terms[max(0, free - PROBE) : free]
            self.work += len(more) * len(at)
            scores = scores + postings.probe(weights, more, at)
            free -= len(more)
            keep = (scores + (gain[free - 1] if free else 0) > least).astype(bool)
            at, scores = at[keep], scores[keep]
        if not len(at):
            return
        scores = np.clip(scores, *_LIMITS).astype(np.int64) if scores.dtype == object else scores.astype(np.int64)
        if len(at) > 4 * self.k:  # equal scores at the border all stay
            border = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            at, scores = at[scores >= border], scores[scores >= border]
        scores, who = np.concatenate([self.best[q][0], scores]), np.concatenate([self.best[q][1], postings.ids[at]])
        first = np.lexsort((who, ~scores))[: self.k]
        self.best[q] = scores[first], who[first]
        self.full[q] = len(first) == self.k
        self.least[q] = scores[first[-1]]

    def found(self):
        """(row of the query, id, score) of what is best now."""
        for q, (scores, who) in enumerate(self.best):
            for vec, score in zip(who.tolist(), scores.tolist()):
                yield q, vec, score


def _reach(values: np.ndarray) -> int:
    return max(int(values.max(initial=0)), -int(values.min(initial=0)))


_CELL = "cell int, is_vector boolean, id long, row long, terms array<long>"
_FOUND = "row long, query_id long, vec_id long, score long"


def _cells(k: int, width: int):
    """Task function: a cell's queries, then its vectors in ascending id; gives the best k of every query."""
    block_rows = max(1, BLOCK_BYTES // (8 * max(1, width)))

    def run(batches):
        cell, queries, search, held = None, [], None, []

        def look(last: bool) -> None:
            nonlocal search, held
            if search is None:
                table = pa.Table.from_batches(queries).combine_chunks()
                search = Search(table.column("id").to_numpy(), _matrix(table.column("terms").combine_chunks(), width), k)
                search.row = table.column("row").to_numpy()
            rows = sum(b.num_rows for b in held)
            if rows and (last or rows >= block_rows):
                table = pa.Table.from_batches(held).combine_chunks()
                for at in range(0, rows, block_rows):
                    piece = table.slice(at, block_rows).combine_chunks()
                    search.block(piece.column("id").to_numpy(), _matrix(piece.column("terms").combine_chunks(), width))
                held = []

        def done():
            if queries:
                look(True)
                rows = [(int(search.row[q]), int(search.ids[q]), vec, score) for q, vec, score in search.found()]
                if rows:
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows)], ["row", "query_id", "vec_id", "score"])

        for batch in batches:
            cells = batch.column("cell").to_numpy()
            kinds = batch.column("is_vector").to_numpy(False)
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                if cells[a] != cell:
                    yield from done()
                    cell, queries, search, held = cells[a], [], None, []
                if not kinds[a]:
                    queries.append(batch.slice(a, b - a))
                elif queries:
                    held.append(batch.slice(a, b - a))
                    look(False)
        yield from done()

    return run


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k highest inner products, ties to the smaller vec_id."""
    rows = quantised(vectors, id_col, vec_col, scale)
    asks = quantised(vectors.where(is_query), id_col, vec_col, scale)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("terms")), F.lit(0)).alias("width")).first()
    shards = min(max(1, math.ceil(size["n"] / SHARD_ROWS)), SHARDS)
    groups = max(1, math.ceil(asks.count() * 8 * size["width"] / QUERY_BYTES))
    place = F.monotonically_increasing_id()
    # places of file rows are stretches of consecutive numbers, so remainders deal them out evenly
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    candidates = rows.withColumn("row", place).withColumn("shard", F.pmod("row", F.lit(shards)).cast("int")).withColumn("group", every_group)
    queries = asks.withColumn("row", place).withColumn("group", F.pmod("row", F.lit(groups)).cast("int")).withColumn("shard", every_shard)
    cells = [(F.col("group") * shards + F.col("shard")).cast("int").alias("cell"), F.lit(True).alias("is_vector"), "id", "row", "terms"]
    dealt = queries.select(cells[0], F.lit(False).alias("is_vector"), *cells[2:]).union(candidates.select(*cells))
    dealt = dealt.repartitionById(shards * groups, "cell").sortWithinPartitions("cell", "is_vector", "id")
    best = dealt.mapInArrow(_cells(k, size["width"]), _FOUND)
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v AS q JOIN v AS c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY rank <= 10
"""
