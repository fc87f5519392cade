"""Importance resampling towards a target corpus, with exact ranks by parallel sorting by regular sampling.

Words are runs of bytes other than ASCII signs and spaces, A-Z in lower case; features are all runs of `lo` to `hi` words,
hashed into buckets by CRC-32.  A bucket's gain is its floored log ratio between target and corpus, 1,000 a nat, kept in
one array; a document's weight is the floored mean of its features' gains.  Its score adds Gumbel noise that follows from
its id, so the highest scores are a sample without replacement in proportion to exp(weight / 1000).

The sort: every task sorts what it has scored and writes it as a run; regular samples of all runs give splitters that cut
the order into segments; runs are exchanged by segment and merged there; counts of the segments before give exact ranks.
Splitters hold run and position as last keys, so equal scores, even equal rows, are cut apart too: no value can fill a
segment.  Only segments that the draw reaches are exchanged.  The driver sees counts of buckets and segments and at most
MERGE * SEGMENTS sampled keys, whatever the corpus.

Defined results.  Null and empty texts, and texts without a word, have no features, weight 0 and a score that is noise
alone.  A null id counts as the empty text in the noise and stands last among ties; equal ids (repeated rows) share their
noise and each take a rank, fewer features first.  Very long texts are read in pieces, features across pieces included.
An empty corpus gives no rows, an empty target zero counts.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import shuffle_partitions, texts, written
from quaestor.llm.fragments import crc32 as crc32_sql
from quaestor.llm.fragments import lower_ascii

#: Bytes of a text cut into words at a time.
PIECE = 1 << 20
#: Rows of a segment, as long as no more than SEGMENTS are needed; larger inputs have larger segments, which sort on disk.
SEGMENT_ROWS = 1 << 20
SEGMENTS = 4096
#: Sampled keys for each segment.
MERGE = 32

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _words(raw: bytes):
    """Yield lists of words, from about PIECE bytes each."""
    raw, at = raw.translate(_WORD), 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):
            end = raw.rfind(b" ", at, end) + 1 or raw.find(b" ", end) + 1 or len(raw)
        yield raw[at:end].split()
        at = end


def _features(raw: bytes, lo: int, hi: int):
    """Yield (words, CRC-32 of features) for the pieces of a text; every run of lo to hi words comes once."""
    tail: list[bytes] = []
    for words in _words(raw):
        n, words = len(words), tail + words
        found = []
        for size in range(lo, hi + 1):
            have = words[max(0, len(tail) - size + 1) :]
            runs = have if size == 1 else list(map(b" ".join, zip(*(have[k:] for k in range(size)))))
            found.append(np.fromiter(map(crc32, runs), np.int64, len(runs)))
        yield n, np.concatenate(found)
        tail = words[len(words) - hi + 1 :] if hi > 1 and len(words) >= hi else words if hi > 1 else []


def bucket_counts(rows: DataFrame, buckets: int, lo: int, hi: int) -> np.ndarray:
    """Features of a table from texts() in each bucket; tasks add up before the shuffle, the driver gets one number a bucket."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                for _, codes in _features(text.as_py(), lo, hi):
                    counts += np.bincount(codes % buckets, minlength=buckets)
        full = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(full), pa.array(counts[full])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored log ratios with one added to every bucket."""
    buckets, all_corpus, all_target = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * (all_corpus + buckets) / ((s + 1.0) * (all_target + buckets))))
            for s, t in zip(corpus.tolist(), target.tolist())
        ],
        np.int64,
    )


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(rows: DataFrame, gain: np.ndarray, lo: int, hi: int, seed: int) -> DataFrame:
    """id, n_words, n_features, weight and score of every row of a table from texts()."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").cast(pa.large_binary()):
                n_words = n = total = 0
                for k, codes in _features(text.as_py(), lo, hi):
                    n_words, n, total = n_words + k, n + len(codes), total + int(gain[codes % len(gain)].sum())
                out.append((n_words, n, total // n if n else 0))
            ids = batch.column("id")
            n_words, n, weight = np.array(out, np.int64).reshape(-1, 3).T
            score = weight + np.array([noise(k, seed) for k in ids.to_pylist()], np.int64)
            columns = [ids, *(pa.array(x, pa.int64()) for x in (n_words, n, weight, score))]
            yield pa.record_batch(columns, ["id", "n_words", "n_features", "weight", "score"])

    return rows.mapInArrow(run, "id long, n_words long, n_features long, weight long, score long")


# -- parallel sorting by regular sampling ------------------------------------------------------------------------------

_RUN = "id long, n_words long, n_features long, weight long, score long, run int, pos long"


def in_score_order(*last: str) -> list[Column]:
    """Highest scores first, then ids with null last, fewer features; run and position as last keys tell equal rows apart."""
    return [F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"), *(F.asc(c) for c in last)]


def sorted_runs(rows: DataFrame) -> DataFrame:
    """Every task's rows in order, with the run's number and positions, in the shared folder."""

    def run(batches):
        number, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield batch.append_column("run", pa.array(np.full(n, number, np.int32))).append_column("pos", pa.array(np.arange(at, at + n)))
            at += n

    return written(rows.sortWithinPartitions(*in_score_order()).mapInArrow(run, _RUN), "runs")


def splitters(runs: DataFrame, total: int, segments: int) -> list[tuple]:
    """Keys that cut the order into segments of about equal size, from every stride-th row of the runs."""
    stride = max(1, total // (segments * MERGE))
    keys = ["score", "id", "n_features", "run", "pos"]
    regular = runs.where((F.col("pos") + F.pmod(F.xxhash64("run"), F.lit(stride))) % stride == 0).select(*keys).collect()
    have = sorted(_key(*r) for r in regular)
    return [have[len(have) * k // segments] for k in range(1, segments)] if have else []


def _key(score, doc_id, n_features, run, pos) -> tuple:
    return (-score, doc_id is None, doc_id or 0, n_features, run, pos)


def with_segments(runs: DataFrame, cuts: list[tuple]) -> DataFrame:
    """Adds the number of splitters at or before each row."""
    borders = np.array(cuts, np.int64).reshape(-1, 6)

    def run(batches):
        for batch in batches:
            ids, n = batch.column("id"), batch.num_rows
            own = [-batch.column("score").to_numpy(), ids.is_null().to_numpy(False).astype(np.int64), ids.fill_null(0).to_numpy()]
            own += [batch.column(c).to_numpy().astype(np.int64) for c in ("n_features", "run", "pos")]
            keys = [np.concatenate([borders[:, k], own[k]]) for k in range(6)]
            order = np.lexsort(keys[::-1])  # stable: a splitter stands before the row it was taken from
            segment = np.empty(n + len(borders), np.int32)
            segment[order] = np.cumsum(order < len(borders))
            yield batch.append_column("segment", pa.array(segment[len(borders) :]))

    return runs.mapInArrow(run, f"{_RUN}, segment int")


def ranked(runs: DataFrame, total: int, wanted: int) -> DataFrame:
    """Rows of the runs with their rank from 1 as far as `wanted`, null beyond."""
    segments = min(max(shuffle_partitions(runs.sparkSession), math.ceil(total / SEGMENT_ROWS)), SEGMENTS)
    rows = with_segments(runs, splitters(runs, total, segments))
    sizes = np.zeros(segments, np.int64)
    for segment, n in rows.groupBy("segment").count().collect():
        sizes[segment] = n
    before = np.cumsum(sizes) - sizes
    reached = max(1, int(np.searchsorted(before, wanted)))

    def run(batches):
        last, at = -1, 0
        for batch in batches:
            segment = batch.column("segment").to_numpy()
            first = np.flatnonzero(np.diff(segment, prepend=-1))
            begin = np.repeat(first, np.diff(first, append=len(segment)))
            place = np.arange(len(segment)) - begin + np.where(segment == last, at, 0)
            last, at = int(segment[-1]), int(place[-1]) + 1
            rank = before[segment] + place + 1
            yield batch.append_column("rank", pa.array(rank, mask=rank > wanted))

    exchanged = rows.where(F.col("segment") < reached).repartitionById(reached, "segment").sortWithinPartitions("segment", *in_score_order("run", "pos"))
    merged = exchanged.mapInArrow(lambda batches: run(b for b in batches if b.num_rows), f"{_RUN}, segment int, rank long")
    return merged.unionByName(rows.where(F.col("segment") >= reached).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    lo: int = 1,
    hi: int = 1,
    buckets: int = 10_000,
    least_words: int = 20,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """Every document with its weight and score, and the rank of those drawn: percent of those with at least least_words."""
    rows, goal = texts(docs, id_col, text_col), target.select(F.lit(0).alias("id"), F.col(target_col).alias("text"))
    gain = gains(bucket_counts(rows, buckets, lo, hi), bucket_counts(texts(goal, "id"), buckets, lo, hi))
    every = written(scored(rows, gain, lo, hi, seed), "scored")
    runs = sorted_runs(every.where(F.col("n_words") >= least_words))
    total = runs.count()
    out = ["id", "n_features", "weight", "score", "rank"]
    short = every.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")).select(*out)
    return ranked(runs, total, total * percent // 100).select(*out).union(short).withColumnRenamed("id", "doc_id")


def _sql_words(text: str) -> str:
    return rf"regexp_extract_all({lower_ascii(text)}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_sql_words("coalesce(text, '')")} AS w FROM documents),
dw AS (SELECT k, unnest(w) AS w FROM d), bw AS (SELECT unnest({_sql_words("coalesce(text, '')")}) AS w FROM benchmark),
code AS (SELECT w, {crc32_sql("w")} % 10000 AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
s AS (SELECT b, count(*) AS n FROM dw JOIN code USING (w) GROUP BY b), t AS (SELECT b, count(*) AS n FROM bw JOIN code USING (w) GROUP BY b),
total AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS s, (SELECT count(*) FROM bw)::DOUBLE AS t),
gain AS (
  SELECT s.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (total.s + 10000) / ((s.n + 1)::DOUBLE * (total.t + 10000))))::BIGINT AS g
  FROM s LEFT JOIN t USING (b), total),
weighed AS (SELECT k, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN code USING (w) JOIN gain USING (b) GROUP BY k),
scored AS (
  SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weighed USING (k)),
placed AS (
  SELECT *, n_features >= 20 AS fit,
    row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS r,
    count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN fit AND r <= 10 * n // 100 THEN r END AS rank FROM placed
"""
