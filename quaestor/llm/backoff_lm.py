"""Stupid-backoff language model scores of documents under the rest of their corpus.

Counts of n-grams of one to ORDER words over all documents stand in tables partitioned by the n-gram's hash; the documents'
exploded n-grams are joined to them and summed per document.  A document's own n-grams are taken off the counts first, so
a text is never evidence for itself: S(w | u v) = c(u v w) / c(u v) where the rest of the corpus holds u v w, else BACKOFF *
S(w | v), and so on down to c(w) / N, or 1 / (N + 1) for a word that no other document holds.

Words are maximal runs of non-blank bytes, A-Z in lower case.  Nulls: a null text is empty; texts without words have
n_words 0 and a null score.  A null id is kept.  Rows that share an id are scored apart; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quaestor.llm.common import PRIME, grams, in_batches, mix, texts, word_hashes
from quaestor.llm.counting import distinct, to_keys, with_totals, words_in

ORDER = 3
BACKOFF = 0.4
BATCH_BYTES = 8 << 20
SCHEMA = "doc_id long, n_words long, seen3 long, seen2 long, seen1 long, score double"


def exploded(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Row of each word, then per order the n-gram that ends at each word (0 where the document starts too late)."""
    rows, parts = [], [[] for _ in range(ORDER)]
    for chunk_at, chunk in _chunks(table.column("text")):
        for first, hashes, counts, _, _ in word_hashes(chunk):
            row = np.repeat(np.arange(len(counts)) + first + chunk_at, counts)
            rows.append(row)
            for n in range(1, ORDER + 1):
                out = np.zeros(len(hashes), np.uint64)
                if len(hashes) >= n:
                    same = row[n - 1 :] == row[: len(row) - n + 1]
                    out[n - 1 :] = np.where(same, np.maximum(to_keys(mix(grams(hashes, n) + np.uint64(n))), np.uint64(1)), np.uint64(0))
                parts[n - 1].append(out)
    if not rows:
        return np.zeros(0, np.int64), [np.zeros(0, np.uint64)] * ORDER, np.zeros(table.num_rows, np.int64)
    row = np.concatenate(rows)
    return row, [np.concatenate(p) for p in parts], np.bincount(row, minlength=table.num_rows)


def _chunks(column: pa.ChunkedArray):
    at = 0
    for chunk in column.chunks:
        yield at, chunk
        at += len(chunk)


def _keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a batch; the key 0 counts its words."""
    row, by_order, _ = exploded(table)
    keys, counts = distinct(np.concatenate([g[g > 0] for g in by_order]))
    return np.concatenate([np.zeros(1, np.uint64), keys]), np.concatenate([[len(row)], counts])


def _own(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How often each n-gram occurs in its own document."""
    _, code, counts = np.unique(mix(key + row.astype(np.uint64) * np.uint64(PRIME)), return_inverse=True, return_counts=True)
    return counts[code]


def _score(table: pa.Table, totals: np.ndarray) -> pa.Table:
    row, by_order, sizes = exploded(table)
    _, code = np.unique(np.concatenate([[np.uint64(0)], *by_order]), return_inverse=True)
    code, n = code[1:], len(row)
    rest = []
    for k, key in enumerate(by_order):
        total = totals[code[k * n : (k + 1) * n]]
        rest.append(np.where(key > 0, total - _own(row, key), 0).astype(float))
    words = (totals[0] - sizes[row]).astype(float)
    score = np.where(rest[0] > 0, rest[0] / np.maximum(words, 1), 1 / (words + 1))
    seen = [rest[0] > 0]
    for k in range(1, ORDER):
        context = np.concatenate([[0.0], rest[k - 1][:-1]])
        seen.append(rest[k] > 0)
        begins = by_order[k] == 0  # too early in the document for an n-gram of this order: no penalty either
        backed = np.where(begins, score, BACKOFF * score)
        score = np.where(seen[k], rest[k] / np.maximum(context, 1), backed)
    level = np.select([seen[2], seen[1], seen[0]], [3, 2, 1], 0)
    count = lambda v: np.bincount(row[level == v], minlength=table.num_rows)
    mean = np.bincount(row, np.log10(score), table.num_rows) / np.maximum(sizes, 1)
    return pa.table(
        {
            "doc_id": table.column("id"),
            "n_words": pa.array(sizes, pa.int64()),
            "seen3": pa.array(count(3), pa.int64()),
            "seen2": pa.array(count(2), pa.int64()),
            "seen1": pa.array(count(1), pa.int64()),
            "score": pa.array(mean, pa.float64(), mask=sizes == 0),
        }
    )


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, words scored at each order, and the mean log10 score per word."""
    rows = texts(docs)
    return with_totals(in_batches(rows, BATCH_BYTES), _keys, _score, SCHEMA, 2 * words_in(rows))


ORACLE = r"""
WITH w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents)),
g AS (SELECT doc_id, i, w AS g1, CASE WHEN i > 1 THEN lag(w) OVER d || ' ' || w END AS g2,
  CASE WHEN i > 2 THEN lag(w, 2) OVER d || ' ' || lag(w) OVER d || ' ' || w END AS g3,
  CASE WHEN i > 1 THEN lag(w) OVER d END AS h1, CASE WHEN i > 2 THEN lag(w, 2) OVER d || ' ' || lag(w) OVER d END AS h2
  FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, count(*) AS n, sum(count(*)) OVER () - count(*) AS rest FROM g GROUP BY doc_id),
o AS (SELECT doc_id, g, count(*) AS own FROM (SELECT doc_id, unnest([g1, g2, g3]) AS g FROM g) WHERE g IS NOT NULL GROUP BY 1, 2),
c AS (SELECT doc_id, g, sum(own) OVER (PARTITION BY g) - own AS c FROM o),
s AS (SELECT g.doc_id, coalesce(c1.c, 0) AS c1, coalesce(c2.c, 0) AS c2, coalesce(c3.c, 0) AS c3, coalesce(k1.c, 0) AS k1,
  coalesce(k2.c, 0) AS k2, n.rest, g.i FROM g JOIN n USING (doc_id) LEFT JOIN c c1 ON c1.doc_id = g.doc_id AND c1.g = g1
  LEFT JOIN c c2 ON c2.doc_id = g.doc_id AND c2.g = g2 LEFT JOIN c c3 ON c3.doc_id = g.doc_id AND c3.g = g3
  LEFT JOIN c k1 ON k1.doc_id = g.doc_id AND k1.g = h1 LEFT JOIN c k2 ON k2.doc_id = g.doc_id AND k2.g = h2),
p AS (SELECT doc_id, c1, c2, c3, CASE WHEN c3 > 0 THEN c3 / k2 ELSE CASE WHEN i > 2 THEN 0.4e0 ELSE 1e0 END * CASE WHEN c2 > 0
  THEN c2 / k1 ELSE CASE WHEN i > 1 THEN 0.4e0 ELSE 1e0 END * CASE WHEN c1 > 0 THEN c1 / rest ELSE 1e0 / (rest + 1) END END END AS s FROM s)
SELECT d.doc_id, coalesce(count(p.s), 0)::BIGINT AS n_words, count(*) FILTER (c3 > 0)::BIGINT AS seen3,
  count(*) FILTER (c3 = 0 AND c2 > 0)::BIGINT AS seen2, count(*) FILTER (c3 = 0 AND c2 = 0 AND c1 > 0)::BIGINT AS seen1,
  round(avg(log10(s)), 6) AS score
FROM documents d LEFT JOIN p USING (doc_id) GROUP BY d.doc_id
"""
