"""Corpus-wide counts of 64-bit keys, asked for by batches of documents.

Every batch sends each of its distinct keys once, with its own count, to the key's bucket; the bucket adds up what all
batches sent and answers each batch with the totals in the order it asked.  Keys travel sorted and as differences (about
five bytes each), already summed within the batch, so a key that half the corpus holds arrives once per batch.  Buckets
are ranges of a uniform hash and hold about BUCKET_KEYS keys whatever the corpus, since their number follows its size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from quaestor.llm.common import give_back, shuffle_partitions, text_size, unpacked

BUCKET_KEYS = 1 << 20
ASKED = "batch long, bucket int, keys binary, counts binary"


#: Keys are the upper 56 bits of a uniform hash: a corpus of 10 ** 13 n-grams confuses one in ten thousand.
KEY_BITS = 56


def to_keys(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - KEY_BITS)


def _narrow(a: np.ndarray) -> bytes:
    """Non-negative integers, compressed; the first byte tells their width."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(a.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + zstandard.compress(a.astype(f"<u{width}").tobytes(), 1)


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw[1:]), f"<u{raw[0]}").astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending distinct keys as differences of equal width."""
    steps = np.diff(keys)
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    body = np.ascontiguousarray(steps.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + body.tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    width = raw[0]
    body = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(body), 8), np.uint8)
    steps[:, :width] = body
    return np.cumsum(np.concatenate([np.frombuffer(raw, "<u8", 1, 1), steps.view("<u8").reshape(-1)]), dtype=np.uint64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(KEY_BITS - 24)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def asked(batch: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.Table:
    """The requests of one batch: distinct ascending keys and its own counts."""
    cut = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cut))
    return pa.table(
        {
            "batch": pa.array(np.full(len(full), batch), pa.int64()),
            "bucket": pa.array(full, pa.int32()),
            "keys": pa.array([pack_keys(keys[cut[b] : cut[b + 1]]) for b in full], pa.binary()),
            "counts": pa.array([_narrow(counts[cut[b] : cut[b + 1]]) for b in full], pa.binary()),
        }
    )


def _add_up(table: pa.Table) -> pa.Table:
    keys = [unpack_keys(raw) for raw in table.column("keys").to_pylist()]
    counts = np.concatenate([_wide(raw) for raw in table.column("counts").to_pylist()])
    sizes = np.cumsum([len(k) for k in keys])
    _, code = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(code, counts).astype(np.int64)[code]
    answers = [_narrow(t) for t in np.split(totals, sizes[:-1])]
    return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "counts": pa.array(answers, pa.binary())})


def totals_of(answer: pa.Table) -> np.ndarray:
    """Totals in the order of the batch's keys."""
    order = np.argsort(answer.column("bucket").to_numpy())
    raw = answer.column("counts").to_pylist()
    return np.concatenate([_wide(raw[k]) for k in order]) if len(order) else np.zeros(0, np.int64)


def with_totals(
    batched: DataFrame,
    keys_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]],
    finish: Callable[[pa.Table, np.ndarray], pa.Table],
    schema: str,
    keys_in_all: int,
) -> DataFrame:
    """finish(rows of a batch, totals of its keys over all batches), for every batch from in_batches().

    keys_of gives a batch's distinct ascending keys and its counts; finish finds the totals in the same order.
    keys_in_all: about how many keys the batches send together; sets the number of buckets.
    """
    buckets = min(1 << 23, max(math.ceil(keys_in_all / BUCKET_KEYS), 2 * shuffle_partitions(batched.sparkSession)))

    def ask(table: pa.Table) -> pa.Table:
        out = asked(table.column("batch")[0].as_py(), *keys_of(unpacked(table)), buckets)
        give_back()
        return out

    def use(docs: pa.Table, answer: pa.Table) -> pa.Table:
        out = finish(unpacked(docs), totals_of(answer))
        give_back()
        return out

    requests = batched.groupBy("batch").applyInArrow(ask, ASKED)
    answers = requests.groupBy("bucket").applyInArrow(_add_up, "batch long, bucket int, counts binary")
    return batched.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(use, schema)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ascending keys and how often each occurs."""
    found, counts = np.unique(keys, return_counts=True)
    return found, counts.astype(np.int64)


def words_in(rows: DataFrame) -> int:
    """About how many words the texts hold."""
    return text_size(rows)[1] // 6
