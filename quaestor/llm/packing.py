"""Order-preserving packing of token sequences by dynamic programming.

Documents follow each other in ascending id order; a window of at most LENGTH ids becomes a sequence.  Cuts are chosen at
document ends (free), sentence ends (SENTENCE) or, in stretches without either, every STRIDE ids (ANYWHERE); the cost of a
plan is its padding plus these penalties.  f(i) = penalty(i) + LENGTH - p(i) + min over j of f(j) + p(j), where p is the
position and j runs over the cuts at most LENGTH before i: the minimum of a sliding window, kept in a monotone queue.

Nulls: a null text is empty (its document holds the end id only), a null id is kept and sorts first.  Rows that share an id
stay separate documents.  Empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quaestor.llm.common import in_order, texts
from quaestor.llm.subword import encoder, read_tokenizer, release, sentence_ends

LENGTH = 2048
SENTENCE, ANYWHERE, STRIDE = 2.0, 12.0, 24
#: Ids planned at a time; the plan's last windows are planned again with what follows, so memory does not grow.
STRETCH = 1 << 20
PART_BYTES = 16 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def candidates(ids: np.ndarray, ends: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may be cut, ascending and without 0, and their penalties.  ends: ends of documents."""
    penalty = np.full(len(ids) + 1, np.inf)
    penalty[1:][sentence[ids]] = SENTENCE
    penalty[ends] = 0.0
    at = np.flatnonzero(np.isfinite(penalty))
    gaps = np.diff(np.concatenate([[0], at]))
    for k in np.flatnonzero(gaps > STRIDE).tolist():
        forced = np.arange(at[k] - gaps[k] + STRIDE, at[k], STRIDE)
        penalty[forced] = ANYWHERE
    at = np.flatnonzero(np.isfinite(penalty[1:])) + 1
    return at, penalty[at]


def plan(at: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> list[int]:
    """Cuts of the cheapest plan from 0 to the last position."""
    positions, costs = [0, *at.tolist()], [0.0, *penalty.tolist()]
    best, back = [0.0] * len(positions), [0] * len(positions)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for i in range(1, len(positions)):
        p = positions[i]
        while positions[queue[0][1]] < p - length:
            queue.popleft()
        low, j = queue[0]
        best[i], back[i] = costs[i] + length - p + low, j
        key = best[i] + p
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, i))
    out, i = [], len(positions) - 1
    while i:
        out.append(positions[i])
        i = back[i]
    return out[::-1]


class Packer:
    """Plans a stream of documents window by window."""

    def __init__(self, part: int, sentence: np.ndarray, length: int):
        self.sequence, self.sentence, self.length = part << 32, sentence, length
        self.docs: list[tuple] = []  # (id, ids, ids already placed)
        self.size = 0

    def add(self, doc_id, ids: np.ndarray):
        self.docs.append((doc_id, ids, 0))
        self.size += len(ids)
        if self.size >= STRETCH:
            yield from self.flush(False)

    def flush(self, final: bool):
        if not self.size:
            return
        flat = np.concatenate([ids[done:] for _, ids, done in self.docs])
        ends = np.cumsum([len(ids) - done for _, ids, done in self.docs])
        cuts = plan(*candidates(flat, ends, self.sentence), self.length)
        if not final:  # the last windows may change with what follows
            cuts = [c for c in cuts if c <= len(flat) - 8 * self.length] or cuts[:1]
        k, before, first = 0, 0, 0
        for cut in cuts:
            while first < cut:
                doc_id, ids, done = self.docs[k]
                take = min(cut - first, len(ids) - done)
                yield doc_id, done, take, zlib.crc32(ids[done : done + take].tobytes()), len(ids), self.sequence, first - before
                first += take
                if done + take == len(ids):
                    k += 1
                else:
                    self.docs[k] = (doc_id, ids, done + take)
            before = cut
            self.sequence += 1
        del self.docs[:k]
        self.size = len(flat) - cuts[-1]


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = LENGTH, keep: bool = True) -> DataFrame:
    """One row per piece: which ids of which document stand where in which sequence.

    keep: encoded pieces stay with the worker for its next task; without, they go with the task.
    """
    content = read_tokenizer(tokenizer_path)
    sent = docs.sparkSession.sparkContext.broadcast(content)  # one file, whatever the corpus

    def run(batches):
        encode = encoder(sent.value)
        packer = Packer(TaskContext.get().partitionId(), sentence_ends(sent.value), length)
        end, rows = np.array([end_id], "<u4"), []
        for batch in batches:
            names = batch.column("id").to_pylist()
            for first, ids, at in encode(batch.column("text")):
                for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    rows.extend(packer.add(names[first + k], np.concatenate([ids[a:b], end])))
            if rows:
                yield _table(rows)
                rows = []
        rows.extend(packer.flush(True))
        if not keep:
            del encode
            release()
        if rows:
            yield _table(rows)

    return in_order(texts(docs), PART_BYTES).select("id", "text").mapInArrow(run, SCHEMA)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split(" ")[0] for c in SCHEMA.split(", ")])
