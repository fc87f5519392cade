"""Helpers shared by the operators: column selection, sizes, word hashing, components."""

from __future__ import annotations

import ctypes
import math
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
PRIME = 0x9E3779B97F4A7C15
INVERSE = pow(PRIME, -1, 1 << 64)
#: Bytes of text hashed at a time; a longer document is hashed alone.
CHUNK = 1 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names.

    Only a local session (tests) that names none gets a temporary folder of this machine; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        base = tempfile.mkdtemp(prefix="spark-")
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{os.urandom(6).hex()}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and go on from there: lineage ends, and lost executors lose nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return what a Python worker has freed to the system: a worker is used again and else keeps it through other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the operators read, whatever else the table holds: id (long) and text (null becomes empty)."""
    return docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def text_size(rows: DataFrame) -> tuple[int, int]:
    """Rows and bytes of text of a table from texts()."""
    row = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def in_order(rows: DataFrame, part_bytes: int) -> DataFrame:
    """Rows in ascending (id, text hash) order over range partitions of about part_bytes of text each.

    Equal ids may be cut apart between partitions by their text, so that one id cannot fill a partition.
    """
    _, size = text_size(rows)
    keyed = rows.withColumn("tie", F.xxhash64("text"))
    return keyed.repartitionByRange(max(1, math.ceil(size / part_bytes)), "id", "tie").sortWithinPartitions("id", "tie")


def in_batches(rows: DataFrame, batch_bytes: int) -> DataFrame:
    """Rows packed into batches of about batch_bytes of text: one compressed row (batch, payload) each.

    A batch is a stretch of an input partition, so it is the same whenever it is computed again.
    """

    def run(batches):
        part, number, ids, held, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            sizes = np.diff(np.frombuffer(batch.column("text").cast(pa.large_string()).buffers()[1], np.int64, batch.num_rows + 1))
            at = 0
            while at < batch.num_rows:
                take = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), batch_bytes - size, side="right")))
                piece = batch.slice(at, take)
                held.append(piece)
                size += int(sizes[at : at + take].sum())
                at += take
                if size >= batch_bytes or at < batch.num_rows:
                    yield _packed(part << 32 | number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield _packed(part << 32 | number, held)

    return rows.select("id", "text").mapInArrow(run, "batch long, payload binary")


def _packed(batch: int, pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    whole = pa.Table.from_batches(pieces).combine_chunks()
    with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_table(whole)
    payload = pa.array([sink.getvalue().to_pybytes()], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), payload], ["batch", "payload"])


def unpacked(table: pa.Table) -> pa.Table:
    """id and text of a batch."""
    return pa.concat_tables([pa.ipc.open_stream(raw).read_all() for raw in table.column("payload").to_pylist()]).combine_chunks()


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; an id that is null counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


# -- words -------------------------------------------------------------------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: a bijection that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def mix_one(value: int) -> int:
    return int(mix(np.array([value & MASK], np.uint64))[0])


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 1), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= 2 * CHUNK:
            _powers[base] = have
    return have


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def stretches(column: pa.Array, size: int = CHUNK):
    """Yield (first row, bytes, bounds) for stretches of a text column of at most size bytes (or one text).

    Row first + i has bytes[bounds[i]:bounds[i + 1]].
    """
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first, total = 0, len(column)
    while first < total:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), total)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(column: pa.Array):
    """Yield (first row, word hashes, words per row, byte starts, byte ends) for stretches of a text column.

    Words are maximal runs of bytes other than space and \\t..\\r, A-Z in lower case; byte offsets count within the stretch.
    """
    for first, raw, bounds in stretches(column):
        inside = ~_SPACE[raw]
        begin = np.zeros(len(raw) + 1, bool)
        begin[bounds] = True
        starts = np.flatnonzero(inside & (begin[:-1] | ~np.concatenate([[False], inside[:-1]])))
        ends = np.flatnonzero(inside & (begin[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * powers(PRIME, len(raw))[: len(raw)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * powers(INVERSE, len(raw))[starts])
        yield first, hashes, np.diff(np.searchsorted(starts, bounds)), starts, ends


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n neighbouring words; position i is the run that starts at word i."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    size = len(hashes) - n + 1
    out = hashes[:size].copy()
    for j in range(1, n):
        out = out * np.uint64(PRIME) + hashes[j : j + size]
    return mix(out)


# -- connected components ----------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node of an undirected edge table (a long, b long): columns node, component.

    Labels spread to neighbours by their minimum and every label's own node follows (pointer jumping), so rounds grow with
    the logarithm of a chain's length.  Minima are pre-aggregated before each shuffle, and each round is written to the
    shared folder: a hub's edges are never gathered in one group, and a lost executor costs no earlier round.
    """
    both = edges.select("a", "b").where("a <> b")
    both = written(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().select("a", "b"), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    before = None
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        roots = hooked.groupBy("label").agg(F.min("new").alias("low"))
        joined = hooked.join(roots, "label").select("node", F.least("new", "low").alias("label"))
        labels = written(joined, "labels")
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = written(labels.join(jump, "label").select("node", F.least("label", "up").alias("label")), "labels")
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return labels.select("node", F.col("label").alias("component"))
        before = now
