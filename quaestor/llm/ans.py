"""Token-id files coded by a static range asymmetric numeral system.

A file row is a segment: whole documents, about SEGMENT ids, coded with one frequency table that all blocks of the segment
share.  A block holds BLOCK ids dealt over LANES interleaved states; the states and the place in the word stream are
recorded every CHECKPOINT steps, and every such span carries a checksum, so spans decode independently of each other.
Segments are Parquet rows: Spark's commit protocol, splits and remote stores apply to them.

Nulls: a null text is empty, its document holds the end id only; a null document id is kept and sorts first.  An empty
table gives no rows.  Rows that share an id stay separate documents, in the order of their text hash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm.common import in_order, shared_folder, texts
from quaestor.llm.subword import encoder, read_tokenizer

SEGMENT = 1 << 22
BLOCK = 1 << 16
LANES = 32
CHECKPOINT = 256
#: Frequencies of a table add up to 2 ** PRECISION.
PRECISION = 20
#: States stay in [LOW, 2 ** 32 * LOW), below 2 ** 53: all of the coder's arithmetic is exact in double precision.
LOW = 1 << 21
PART_BYTES = 16 << 20

SCHEMA = (
    "part int, segment int, first_id long, n_ids long, doc_ids binary, doc_nulls binary, doc_lengths binary, symbols binary, "
    "frequencies binary, states binary, places binary, words binary, block_words binary, checksums binary"
)


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that occur and their frequencies, each at least 1, adding up to 2 ** PRECISION."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts, total = counts[symbols], 1 << PRECISION
    if len(symbols) > total:
        raise ValueError(f"{len(symbols)} different ids do not fit into a table of {total}")
    scaled = np.maximum(1, counts * (total - len(symbols)) // counts.sum())
    scaled[np.argmax(counts)] += total - scaled.sum()
    return symbols.astype("<u4"), scaled.astype("<u4")


def _shape(n: int, block: int, lanes: int, every: int) -> tuple[int, int, int]:
    """Blocks, steps and spans per block of n ids."""
    blocks = -(-n // block)
    steps = block // lanes if blocks > 1 else -(-n // lanes)
    return blocks, steps, -(-steps // every)


def encode(ids: np.ndarray, block: int = BLOCK, lanes: int = LANES, every: int = CHECKPOINT) -> dict:
    """Code ids (uint32).  Id number s * lanes + k of a block is step s of lane k; all blocks advance together."""
    n = len(ids)
    symbols, freqs = frequencies(ids)
    place = np.zeros(int(symbols[-1]) + 1, np.int32)
    place[symbols] = np.arange(len(symbols))
    freq = freqs.astype(np.float64)
    start = np.concatenate([[0.0], np.cumsum(freq)[:-1]])
    blocks, steps, spans = _shape(n, block, lanes, every)
    index = np.zeros(blocks * steps * lanes, np.int32)
    index[:n] = place[ids]
    index = np.ascontiguousarray(index.reshape(blocks, steps, lanes).swapaxes(0, 1))
    last = n - (blocks - 1) * steps * lanes  # ids in the last block; its missing ids are not coded
    state = np.full((blocks, lanes), float(LOW))
    states = np.empty((spans, blocks, lanes), np.uint64)
    lane_of = np.repeat(np.arange(blocks, dtype=np.int32), lanes)
    out_words, out_blocks, step_words = [], [], np.zeros((steps, blocks), np.int64)
    top, total = float((LOW >> PRECISION) << 32), float(1 << PRECISION)
    for s in range(steps - 1, -1, -1):
        f, b = freq[index[s]], start[index[s]]
        full = state >= f * top
        live = None
        if (s + 1) * lanes > last:
            live = np.ones((blocks, lanes), bool)
            live[-1] = np.arange(s * lanes, (s + 1) * lanes) < last
            full &= live
        at = np.flatnonzero(full)
        high = np.floor(state * 2.0**-32)
        out_words.append((state - high * 2.0**32).reshape(-1)[at])
        out_blocks.append(lane_of[at])
        step_words[s] = np.count_nonzero(full, axis=1)
        state = np.where(full, high, state)
        whole = np.floor(state / f)
        coded = whole * (total - f) + state + b  # whole * total + remainder + start
        state = coded if live is None else np.where(live, coded, state)
        if s % every == 0:
            states[s // every] = state
    states = states.swapaxes(0, 1)
    words = np.concatenate(out_words[::-1]).astype("<u4")
    owner = np.concatenate(out_blocks[::-1]).astype(np.uint16 if blocks < 1 << 16 else np.int64)
    words = words[np.argsort(owner, kind="stable")]
    before = np.concatenate([np.zeros((1, blocks), np.int64), np.cumsum(step_words, 0)[:-1]])
    raw = ids.astype("<u4").tobytes()
    size = steps * lanes
    sums = [
        zlib.crc32(raw[4 * (b * size + s * every * lanes) : 4 * min(b * size + min((s + 1) * every * lanes, size), n)])
        for b in range(blocks)
        for s in range(spans)
    ]
    return {
        "symbols": symbols.tobytes(),
        "frequencies": freqs.tobytes(),
        "states": states.astype("<u8").tobytes(),
        "places": before[::every].T.astype("<u4").tobytes(),
        "words": words.tobytes(),
        "block_words": step_words.sum(0).astype("<u4").tobytes(),
        "checksums": np.array(sums, "<u4").tobytes(),
    }


def decode(row: dict, n: int, block: int = BLOCK, lanes: int = LANES, every: int = CHECKPOINT, spans_wanted=None) -> np.ndarray:
    """Ids of a segment; spans_wanted (numbers of spans) decodes these only, the rest stays 0.

    Every span starts from its checkpoint, all wanted spans advance together, and each is held against its checksum.
    """
    blocks, steps, spans = _shape(n, block, lanes, every)
    symbols = np.frombuffer(row["symbols"], "<u4")
    freqs = np.frombuffer(row["frequencies"], "<u4")
    slot = np.repeat(np.arange(len(symbols), dtype=np.int32), freqs)
    freq = freqs.astype(np.float64)
    start = np.concatenate([[0.0], np.cumsum(freq)[:-1]])
    words = np.concatenate([np.frombuffer(row["words"], "<u4"), [0]]).astype(np.float64)
    base = np.concatenate([[0], np.cumsum(np.frombuffer(row["block_words"], "<u4"), dtype=np.int64)])
    wanted = np.arange(blocks * spans) if spans_wanted is None else np.asarray(spans_wanted, np.int64)
    state = np.frombuffer(row["states"], "<u8").reshape(blocks * spans, lanes)[wanted].astype(np.float64)
    at = np.frombuffer(row["places"], "<u4").reshape(blocks * spans)[wanted] + base[wanted // spans]
    out = np.zeros((blocks * spans, every, lanes), "<u4")
    first = (wanted // spans) * steps * lanes + (wanted % spans) * every * lanes
    length = np.maximum(0, np.minimum(np.minimum(every, steps - (wanted % spans) * every) * lanes, n - first))
    picked = np.zeros((len(wanted), every, lanes), "<u4")
    lane, total, low = np.arange(lanes), float(1 << PRECISION), float(LOW)
    shortest = length.min(initial=0) // lanes
    for s in range(int(-(-length.max(initial=0) // lanes))):
        high = np.floor(state / total)
        rest = state - high * total
        i = slot[rest.astype(np.int64)]
        picked[:, s, :] = symbols[i]
        new = freq[i] * high + rest - start[i]
        need = new < low
        if s >= shortest:
            live = s * lanes + lane < length[:, None]
            new = np.where(live, new, state)
            need &= live
        taken = np.cumsum(need, 1)
        state = np.where(need, new * 2.0**32 + words[np.where(need, at[:, None] + taken - 1, -1)], new)
        at = at + taken[:, -1]
    out[wanted] = picked
    sums = np.frombuffer(row["checksums"], "<u4")
    result = np.zeros(n, "<u4")
    for k, span in enumerate(wanted.tolist()):
        ids = out[span].reshape(-1)[: length[k]]
        if zlib.crc32(ids.tobytes()) != sums[span]:
            raise ValueError(f"checksum of span {span} differs")
        result[first[k] : first[k] + length[k]] = ids
    return result


def write(docs: DataFrame, path: str, tokenizer_json: str, end_id: int = 0, segment: int = SEGMENT) -> None:
    """Encode all texts, append end_id to each document, and write the id files in ascending document order."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one file, whatever the corpus

    def run(batches):
        encode_texts, part = encoder(vocabulary.value), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        names, nulls, lengths, held, size, seen, number = [], [], [], [], 0, 0, 0

        def segment_row():
            ids = np.concatenate(held)
            row = {
                "part": part,
                "segment": number,
                "first_id": seen,
                "n_ids": len(ids),
                "doc_ids": np.array(names, "<i8").tobytes(),
                "doc_nulls": np.array(nulls, bool).tobytes(),
                "doc_lengths": np.array(lengths, "<i8").tobytes(),
            } | encode(ids)
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for batch in batches:
            doc_ids = batch.column("id").to_pylist()
            for first, ids, at in encode_texts(batch.column("text")):
                for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    name = doc_ids[first + k]
                    names.append(name or 0)
                    nulls.append(name is None)
                    lengths.append(b - a + 1)
                    held += [ids[a:b], end]
                    size += b - a + 1
                    if size >= segment:
                        yield segment_row()
                        seen, number, size = seen + size, number + 1, 0
                        names, nulls, lengths, held = [], [], [], []
        if size:
            yield segment_row()

    in_order(texts(docs), PART_BYTES).select("id", "text").mapInArrow(run, SCHEMA).write.parquet(path)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
ARROW = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split(" ") for c in SCHEMA.split(", "))])


def _documents(spark: SparkSession, path: str, name: str, kind: str, value) -> DataFrame:
    """doc_id, start, n_tokens and, under name, value(ids as bytes) of every document of the files."""
    files = spark.read.schema(SCHEMA).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row per partition of the writer: a few numbers, however large the corpus
    bases = totals.selectExpr("part", "sum(n) over (order by part) - n as base")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                raw = memoryview(decode(row, row["n_ids"]).tobytes())
                lengths = np.frombuffer(row["doc_lengths"], "<i8")
                first = np.concatenate([[0], np.cumsum(lengths)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * len(lengths), pa.int32()),
                        pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=np.frombuffer(row["doc_nulls"], bool)),
                        pa.array(first[:-1] + row["first_id"], pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([value(raw[4 * a : 4 * b]) for a, b in zip(first[:-1], first[1:])], _KINDS[kind]),
                    ],
                    ["part", "doc_id", "start", "n_tokens", name],
                )

    docs = files.mapInArrow(run, f"part int, doc_id long, start long, n_tokens long, {name} {kind}")
    return docs.join(bases, "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", name)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids (binary, 4 bytes each)."""
    return _documents(spark, path, "ids", "binary", bytes)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """As read(), with the crc32 of the decoded ids in their place: no ids leave the task that decodes them."""
    return _documents(spark, path, "ids_crc32", "long", zlib.crc32)


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write the id files and describe every document from what is read back."""
    spark = docs.sparkSession
    path = shared_folder(spark, "token-ids")
    write(docs, path, read_tokenizer(tokenizer_path), end_id)
    return read_checksums(spark, path)
