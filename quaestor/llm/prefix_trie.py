"""Trie of conversations by shared prefixes, as balanced parentheses.

A turn is its 128-bit digest and its size; texts never leave the first task.  Conversations that are equal as a whole form
a class (digests of the turns with their depths, added by exclusive or), represented by the smallest id.  Classes are
sorted by their digest sequences, so that shared prefixes are neighbours, and cut into shards of about equal size.  A shard
writes its trie as balanced parentheses with the minimum excess of each block in a tree: findclose walks it and delimits
the subtree of each node, ranks of "()" pairs count its leaves, and differences of cumulative arrays give its members and
savings.  The spine that a shard shares with its neighbours (known from their border paths) is given in parts, and parts of
a node are added up; children of a spine node find its merged id through (shard, node), so the root's children never meet.

Hot keys.  Turns are numbered over range partitions with carried offsets, so a conversation may fill many tasks.  A
sequence enters the trie with its first PATH turns; what follows is a chain that no other class shares and is written
straight from its rows.  Only classes that agree on all of these PATH turns and then go on differently travel as a whole,
32 bytes a turn in one row.  A class's ids are joined in pieces and hashed as a stream.

Defined results.  Turns are ordered by turn, null first, then by digest: equal turns in an order fixed by their content.
Null role or text counts as empty.  Rows without conv_id are left out.  A conversation without turns belongs to the root.
Repeated rows are turns each.  Empty and very long texts are turns like others.  No conversations, no nodes.  Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.llm.common import shuffle_partitions, written
from quaestor.llm.fragments import crc32 as crc32_sql

#: Turns of a sequence that enter the trie; rows of a range partition or turns of a shard, where that gives more than usual.
PATH = 256
PART_ROWS = 1 << 20
#: Conversation ids joined to one piece.
PIECE = 1 << 16
#: Parentheses in a block of the excess tree; nodes looked at together inside blocks.
BLOCK = 64
LOOK = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()
NEVER = np.iinfo(np.int64).max

# -- turns, numbered ---------------------------------------------------------------------------------------------------

_OWN = "conv long, part int, pos long, h1 long, h2 long, bytes long, cum long"


def numbered(turns: DataFrame) -> DataFrame:
    """conv, part, p (from 1), h1, h2, bytes, cum (bytes of the conversation as far as here) of every turn, written."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit("second"), role, text).alias("h2"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("tie"),
    )
    spark, order = turns.sparkSession, ["conv", "turn", "h1", "h2", "tie"]
    parts = max(shuffle_partitions(spark), math.ceil(rows.count() / PART_ROWS))

    def run(batches):
        part, last, n, size = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, sizes = batch.column("conv").to_numpy(), batch.column("bytes").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            run_of = np.repeat(np.arange(len(first)), np.diff(first, append=len(conv)))
            pos, sums = np.arange(len(conv)) - first[run_of] + 1, np.cumsum(sizes)
            cum = sums - (sums - sizes)[first][run_of]
            if conv[0] == last:
                pos, cum = pos + n * (run_of == 0), cum + size * (run_of == 0)
            last, n, size = conv[-1], int(pos[-1]), int(cum[-1])
            columns = [batch.column("conv"), pa.array(np.full(len(conv), part, np.int32)), pa.array(pos)]
            columns += [batch.column(c) for c in ("h1", "h2", "bytes")] + [pa.array(cum)]
            yield pa.record_batch(columns, ["conv", "part", "pos", "h1", "h2", "bytes", "cum"])

    own = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, _OWN), "turns")
    before = spark.createDataFrame(_offsets(own), "part int, conv long, n long, size long")  # some rows a partition at most
    own = own.join(F.broadcast(before), ["part", "conv"], "left")
    p, cum = F.col("pos") + F.coalesce("n", F.lit(0)), F.col("cum") + F.coalesce("size", F.lit(0))
    return own.select("conv", "part", p.alias("p"), "h1", "h2", "bytes", cum.alias("cum"))


def _offsets(own: DataFrame) -> list[tuple[int, int, int, int]]:
    """(part, conv, turns, bytes) that earlier partitions hold of the conversation with which a partition begins."""
    ends = sorted(own.groupBy("part").agg(F.min("conv"), F.max("conv")).collect())
    carried = sorted({b[1] for a, b in zip(ends, ends[1:]) if a[2] == b[1]})
    if not carried:
        return []
    table = F.broadcast(own.sparkSession.createDataFrame([(c,) for c in carried], "conv long"))
    counts = own.join(table, "conv", "left_semi").groupBy("conv", "part").agg(F.count("pos"), F.sum("bytes")).collect()
    out, sums = [], {}
    for conv, part, n, size in sorted(counts):
        have = sums.get(conv, (0, 0))
        out.append((part, conv, *have))
        sums[conv] = have[0] + n, have[1] + size
    return out


# -- sequences ---------------------------------------------------------------------------------------------------------


def sequences(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: turns (conv, part, d, h1, h2, bytes, after) and lengths (conv, size).

    `after` counts the bytes from a turn to the end of its conversation.
    """
    return _shifted(own, own.groupBy("conv").agg(F.max("p").alias("size"), F.max("cum").alias("total")).withColumn("skip", F.lit(0)))


def rebuilt(own: DataFrame, family: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns come from the first of their family, as sequences() gives them.

    Conversation c takes the first h turns of conversation c - c % family, h = crc32(c) % most, then its own after its first h.
    """
    heads = own.where(F.col("p") < most).groupBy(F.col("conv").alias("base"))
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("p", "h1", "h2", "bytes"))).alias("heads"))  # most - 1 at most
    convs = own.groupBy("conv").agg(F.max("p").alias("size"), F.max("cum").alias("total"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    convs = convs.withColumn("skip", h).withColumn("base", F.col("conv") - F.col("conv") % family)
    lead = F.coalesce(F.least("skip", F.size("heads")), F.lit(0))
    convs = written(convs.join(heads, "base", "left").withColumn("lead", F.greatest(lead, F.lit(0))), "conversations")
    taken = convs.where("lead > 0").select("conv", F.explode(F.slice("heads", F.lit(1), F.col("lead"))).alias("t"))
    nothing = F.lit(None).cast("long")
    taken = taken.select("conv", F.lit(-1).alias("part"), F.col("t.p").alias("d"), "t.h1", "t.h2", "t.bytes", nothing.alias("after"))
    rest, sizes = _shifted(own, convs.select("conv", "skip", "lead", "total", "size"))
    return rest.unionByName(taken), sizes


def _shifted(own: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    if "lead" not in convs.columns:
        convs = convs.withColumn("lead", F.lit(0))
    # one row for each partition that holds turns of a conversation, so that a long one is joined in as many tasks
    spans = own.select("conv", "part").distinct().join(convs, "conv")
    rows = own.join(spans, ["conv", "part"]).where(F.col("p") > F.col("skip"))
    d, after = F.col("lead") + F.col("p") - F.col("skip"), F.col("total") - F.col("cum") + F.col("bytes")
    size = F.col("lead") + F.greatest(F.lit(0), F.col("size") - F.col("skip"))
    return rows.select("conv", "part", d.cast("long").alias("d"), "h1", "h2", "bytes", after.alias("after")), convs.select(
        "conv", size.cast("long").alias("size")
    )


# -- classes of equal sequences ----------------------------------------------------------------------------------------

_KEYS = ["x1", "x2", "size"]
_PIECE = "x1 long, x2 long, size long, conv long, n long, ids string, y1 long, y2 long, tail long"
_CLASS = "conv long, size long, n long, ends string, y1 long, y2 long, tail long"


def classes(turns: DataFrame, sizes: DataFrame, path: int) -> DataFrame:
    """conv (smallest member), size, n (members), ends (SHA-256 of their ids), first-turns digest y1, y2, tail bytes."""
    at, early = F.xxhash64("d", "h1", "h2"), F.col("d") <= path
    at2 = F.xxhash64(F.lit("second"), "d", "h1", "h2")
    sums = turns.groupBy("conv").agg(
        F.bit_xor(at).alias("x1"),
        F.bit_xor(at2).alias("x2"),
        F.bit_xor(F.when(early, at)).alias("y1"),
        F.bit_xor(F.when(early, at2)).alias("y2"),
        F.sum(F.when(~early, F.col("bytes"))).alias("tail"),
    )
    rows = sizes.join(sums, "conv", "left").select("conv", "size", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("x1", "x2", "y1", "y2", "tail")))
    parts, order = shuffle_partitions(turns.sparkSession), [*_KEYS, "conv"]

    def pieces(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in _KEYS]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            conv = batch.column("conv")
            spans = [(p, min(p + PIECE, b)) for a, b in zip([0, *cuts], [*cuts, len(conv)]) for p in range(a, b, PIECE)]
            at = pa.array([a for a, _ in spans])
            ids = [",".join(map(str, conv[a:b].to_pylist())) for a, b in spans]
            whole = {c: batch.column(c).take(at) for c in (*_KEYS, "conv", "y1", "y2", "tail")}
            whole |= {"n": pa.array([b - a for a, b in spans], pa.int64()), "ids": pa.array(ids, pa.string())}
            names = [c.split()[0] for c in _PIECE.split(", ")]
            yield pa.record_batch([whole[c] for c in names], names)

    def merged(batches):
        key, row, digest = None, None, None
        for batch in batches:
            for x in batch.to_pylist():
                if (now := tuple(x[c] for c in _KEYS)) != key:
                    if row:
                        yield row | {"ends": digest.hexdigest()}
                    key, row, digest = now, x | {"n": 0}, hashlib.sha256()
                digest.update(f"{',' * (row['n'] > 0)}{x['ids']}".encode())
                row["n"] += x["n"]
        if row:
            yield row | {"ends": digest.hexdigest()}

    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _CLASS.split(", ")])

    def out(batches):
        held = []
        for row in merged(batches):
            held.append({c: row[c] for c in schema.names})
            if len(held) == 10_000:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    found = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pieces, _PIECE)
    joined = found.repartition(parts, *_KEYS).sortWithinPartitions(*order).mapInArrow(out, _CLASS)
    return written(joined, "classes")


# -- balanced parentheses ----------------------------------------------------------------------------------------------


class Parentheses:
    """A trie's shape: 1 opens a node and 0 closes it; minima of the excess in blocks, and of blocks in a tree."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits.astype(np.int8)
        self.excess = np.cumsum(2 * self.bits.astype(np.int64) - 1)
        self.opens = np.flatnonzero(self.bits)
        blocks = max(1, -(-len(bits) // BLOCK))
        self.padded = np.full(blocks * BLOCK, NEVER)
        self.padded[: len(bits)] = self.excess
        self.padded = self.padded.reshape(blocks, BLOCK)
        self.levels = [self.padded.min(1)]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            self.levels.append(np.minimum(low[::2], np.append(low[1::2], np.full(len(low) % 2, NEVER))))

    def find_close(self) -> np.ndarray:
        """Position of the parenthesis that closes each node: the first one behind it with less excess."""
        out = np.empty(len(self.opens), np.int64)
        for at in range(0, len(self.opens), LOOK):
            out[at : at + LOOK] = self._close(self.opens[at : at + LOOK])
        return out

    def _close(self, opens: np.ndarray) -> np.ndarray:
        goal, block = self.excess[opens] - 1, opens // BLOCK
        hit = (self.padded[block] <= goal[:, None]) & (np.arange(BLOCK) > (opens % BLOCK)[:, None])
        inside, place = hit.any(1), hit.argmax(1)
        rest = np.flatnonzero(~inside)
        if len(rest):
            block[rest] = self._next_block(block[rest] + 1, goal[rest])
            place[rest] = (self.padded[block[rest]] <= goal[rest, None]).argmax(1)
        return block * BLOCK + place

    def _next_block(self, at: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """First block from `at` on whose minimum is at most the goal; it exists, as every node is closed."""
        at, level = at.copy(), np.zeros(len(at), np.int64)
        todo = np.arange(len(at))
        for k, low in enumerate(self.levels):  # up: as far as a block of this level, or its right neighbour, will do
            good = np.append(low, NEVER)[np.minimum(at[todo], len(low))] <= goal[todo]
            odd = ~good & (at[todo] % 2 == 1)
            level[todo[good]] = k
            at[todo] += odd
            todo = todo[~good]
            at[todo] //= 2
        for k in range(len(self.levels) - 2, -1, -1):  # down: the left child if it will do
            go = np.flatnonzero(level > k)
            left = 2 * at[go]
            at[go] = left + (self.levels[k][left] > goal[go])
        return at

    def subtree_ends(self) -> np.ndarray:
        """For each node in preorder, the number of the first node behind its subtree."""
        return np.cumsum(self.bits, dtype=np.int64)[self.find_close()]

    def leaves(self) -> np.ndarray:
        return np.append(self.bits[1:], 1)[self.opens] == 0


def _shared(paths: list[np.ndarray]) -> np.ndarray:
    """Length of the common prefix of each path with the one before it; paths are (n, 2) digests."""
    size = np.array([len(p) for p in paths])
    both, start = np.minimum(size[1:], size[:-1]), np.concatenate([[0], np.cumsum(size)])
    flat = np.concatenate(paths)
    pair = np.repeat(np.arange(len(both)), both)
    step = np.arange(len(pair)) - np.repeat(np.cumsum(both) - both, both)
    differ = (flat[start[pair] + step] != flat[start[pair + 1] + step]).any(1)
    out = both.copy()
    np.minimum.at(out, pair[differ], step[differ])
    return out


def _prefix_keys(path: np.ndarray, depth: int) -> list[bytes]:
    """Digests of the prefixes of 0 to depth turns."""
    state, out = hashlib.blake2b(digest_size=16), []
    for turn in path[:depth].astype("<i8"):
        out.append(state.digest())
        state.update(turn.tobytes())
    return [*out, state.digest()]


_NODE = (
    "kind int, shard int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, weight long, once long, ends string"
)
#: Kinds of nodes: whole with a whole parent, whole below the spine, part of a spine node.
WHOLE, BELOW, PART = 0, 1, 2


def shard_nodes(shard: int, rows: list[dict], before: np.ndarray | None, after: np.ndarray | None) -> pa.RecordBatch:
    """Nodes of the classes of a shard, sorted by path; before and after are the neighbours' border paths."""
    paths = [r["path"] for r in rows]
    head = np.array([len(p) for p in paths])
    size, n = (np.array([r[c] for r in rows], np.int64) for c in ("size", "n"))
    length = head + (size > head)  # a tail's first node stands for all of it
    shared = np.concatenate([[0], _shared(paths)]).astype(np.int64)
    fresh = length - shared
    closing = np.concatenate([[0], length[:-1] - shared[1:]])
    counts = np.stack([closing, fresh], 1).reshape(-1)
    bits = np.concatenate([[1], np.repeat(np.tile([0, 1], len(rows)), counts), np.zeros(length[-1] + 1, np.int64)])
    shape = Parentheses(bits)

    first = 1 + np.cumsum(fresh) - fresh  # of each class's own nodes
    end = np.where(length > 0, first + fresh - 1, 0)
    owner = np.concatenate([[0], np.repeat(np.arange(len(rows)), fresh)])
    depth = np.concatenate([[0], np.arange(len(owner) - 1) - np.repeat(first - 1, fresh) + np.repeat(shared, fresh) + 1])
    total = len(depth)
    is_tail = depth > head[owner]
    weight, inner = np.zeros(total, np.int64), np.flatnonzero((depth > 0) & ~is_tail)
    sizes = np.concatenate([np.empty(0, np.int64), *(r["sizes"] for r in rows)])
    weight[inner] = sizes[(np.cumsum(head) - head)[owner[inner]] + depth[inner] - 1]
    weight[is_tail] = np.array([r["tail"] for r in rows], np.int64)[owner[is_tail]]

    by_depth = np.lexsort((np.arange(total), depth))
    place = (depth * total + np.arange(total))[by_depth]
    parent = by_depth[np.searchsorted(place, (depth - 1) * total + np.arange(total)) - 1]
    parent[0] = -1
    low = np.full(total, NEVER)
    low[end] = [r["conv"] for r in rows]
    levels = np.searchsorted(depth[by_depth], np.arange(depth.max() + 2))
    for d in range(int(depth.max()), 0, -1):
        here = by_depth[levels[d] : levels[d + 1]]
        np.minimum.at(low, parent[here], low[here])

    goes_on, part = np.zeros(total, bool), np.zeros(total, bool)
    keys = np.full(total, None, object)
    if after is not None:
        reach = int(_shared([paths[-1], after])[0])
        right = np.array([by_depth[levels[d + 1] - 1] for d in range(reach + 1)])
        goes_on[right] = part[right] = True
        keys[right] = _prefix_keys(paths[-1], reach)
    if before is not None:
        left = np.arange(int(_shared([before, paths[0]])[0]) + 1)
        part[left] = True
        keys[left] = _prefix_keys(paths[0], len(left) - 1)

    stop = shape.subtree_ends()
    last = ~goes_on  # counted where a node is seen for the last time: there it has its children, if any
    ended = np.zeros(total, np.int64)
    np.add.at(ended, end, n)

    def inside(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[stop] - sums[:-1]

    members = inside(ended)
    children = np.bincount(parent[1:][last[1:]], minlength=total)
    more = is_tail & (size[owner] > depth)  # the rest of the chain
    ends = np.full(total, None, object)
    ends[end] = [r["ends"] if l == s else None for r, l, s in zip(rows, length, size)]
    below = np.concatenate([[False], part[parent[1:]]]) & ~part
    kind = np.where(part, PART, np.where(below, BELOW, WHOLE))
    kin = np.where(parent >= 0, keys[parent], None)
    known = parent >= 0
    columns = [
        pa.array(kind, pa.int32()),
        pa.array(np.full(total, shard), pa.int32()),
        pa.array(np.where(part, keys, None), pa.binary()),
        pa.array(kin, pa.binary()),
        pa.array(low),
        pa.array(depth),
        pa.array(low[parent], mask=~known),
        pa.array(members),
        pa.array(children + more),
        pa.array(inside(shape.leaves() & last)),
        pa.array(inside(members * weight)),
        pa.array(inside(weight * last)),
        pa.array(ends, pa.string()),
    ]
    return pa.record_batch(columns, [c.split()[0] for c in _NODE.split(", ")])


def _build(batches):
    """Task function over whole shards: border paths of the neighbours (side -1 and 1) and the classes (side 0)."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    shards = table.column("shard").to_numpy()
    cuts = np.flatnonzero(np.diff(shards)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(shards)]):
        rows, border = [], {}
        for r in table.slice(a, b - a).to_pylist():
            r["path"] = np.array(r["path"], np.int64).reshape(-1, 2)
            r["sizes"] = np.array(r["sizes"] or [], np.int64)
            if r["side"]:
                border[r["side"]] = r["path"]
            else:
                rows.append(r)
        yield shard_nodes(int(shards[a]), rows, border.get(-1), border.get(1))


def trie(turns: DataFrame, sizes: DataFrame, path: int = PATH, shard_turns: int = PART_ROWS) -> DataFrame:
    """Nodes of the trie of the sequences that sequences() or rebuilt() gives."""
    turns = written(turns, "sequences")
    found = classes(turns, sizes, path)
    long = found.where(F.col("size") > path)
    crowded = long.groupBy("y1", "y2").count().where("count > 1").select("y1", "y2")
    crowded = written(long.join(crowded, ["y1", "y2"], "left_semi").select("conv", F.lit(True).alias("crowded")), "crowded")
    found = found.join(crowded, "conv", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    early = turns.where(F.col("d") <= path).join(found.select("conv"), "conv", "left_semi")
    rest = turns.where(F.col("d") > path).join(crowded, "conv", "left_semi")
    lists = early.unionByName(rest).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("d", "h1", "h2", "bytes"))).alias("t"))
    nothing = F.array().cast("array<long>")
    rows = found.join(lists, "conv", "left").select(
        "conv",
        "size",
        "n",
        "ends",
        "tail",
        F.coalesce(F.flatten(F.transform("t", lambda x: F.array(x.h1, x.h2))), nothing).alias("path"),
        F.coalesce(F.col("t.bytes"), nothing).alias("sizes"),
    )
    steps = early.count()
    shards = max(shuffle_partitions(turns.sparkSession), math.ceil(steps / shard_turns))
    sorted_rows = rows.repartitionByRange(shards, "path", "size").withColumn("shard", F.spark_partition_id())
    sorted_rows = written(sorted_rows, "shards")
    borders = sorted_rows.groupBy("shard").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    near = Window.orderBy("shard")  # one row a shard
    borders = borders.select("shard", F.lag("high").over(near).alias("before"), F.lead("low").over(near).alias("after"))
    sides = borders.select("shard", F.explode(F.array(F.struct(F.lit(-1).alias("side"), F.col("before").alias("path")), F.struct(F.lit(1).alias("side"), F.col("after").alias("path")))).alias("b"))
    sides = sides.select("shard", "b.side", "b.path").where("path IS NOT NULL")
    whole = sorted_rows.withColumn("side", F.lit(0)).unionByName(sides, allowMissingColumns=True)
    whole = whole.repartitionById(shards, "shard").sortWithinPartitions("shard", "side", "path", "size")
    nodes = written(whole.mapInArrow(_build, _NODE), "nodes")

    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "weight", "once", "ends"]
    parts = nodes.where(F.col("kind") == PART)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "weight", "once")]
    spine = parts.groupBy("key", "depth").agg(
        F.min("conv_id").alias("conv_id"), *sums, F.max("ends").alias("ends"), F.max("parent_key").alias("parent_key")
    )
    spine = written(spine, "spine")
    up = spine.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    names = parts.select("shard", F.col("key").alias("parent_key")).join(up, "parent_key")
    below = nodes.where(F.col("kind") == BELOW).drop("parent_conv_id").join(names, ["shard", "parent_key"])
    every = nodes.where(F.col("kind") == WHOLE).select(*out).union(below.select(*out)).union(spine.join(up, "parent_key", "left").select(*out))
    ends = F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256")
    every = every.select(*out[:6], (F.col("weight") - F.col("once")).alias("saved_tokens"), ends)
    return every.union(_chains(turns.where(F.col("d") > path + 1), found.where(~F.col("crowded"))))


def _chains(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Nodes of the turns that no other class shares."""
    spans = turns.select("conv", "part").distinct().join(found.select("conv", "size", "n", "ends"), "conv")
    is_last = F.col("d") == F.col("size")
    return turns.join(spans, ["conv", "part"]).select(
        F.col("conv").alias("conv_id"),
        F.col("d").alias("depth"),
        F.col("conv").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(is_last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("n") - 1) * F.col("after")).alias("saved_tokens"),
        F.when(is_last, F.col("ends")).otherwise(EMPTY).alias("ends_sha256"),
    )


ORACLE = f"""
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p,
    md5(coalesce(role, '') || chr(0) || coalesce(text, '')) AS turn, octet_length(encode(coalesce(text, ''))) AS b
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - c % 5 AS base, {crc32_sql("c::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT c FROM own)),
rows AS (
  SELECT v.c, 0 AS k, o.p, turn, b FROM convs v JOIN own o ON o.c = v.base AND o.p <= v.h
  UNION ALL SELECT v.c, 1, o.p, turn, b FROM convs v JOIN own o ON o.c = v.c AND o.p > v.h),
placed AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY k, p) AS d, turn, b FROM rows),
chained AS (SELECT c, d, b, string_agg(turn, '') OVER (PARTITION BY c ORDER BY d) AS path FROM placed UNION ALL SELECT c, 0, 0, '' FROM convs),
sized AS (SELECT c, max(d) AS size FROM chained GROUP BY c),
node AS (
  SELECT d, path, min(c) AS conv_id, count(*) AS n, any_value(b) AS b, max(size) > d AS inner_node,
    string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (size = d) AS ends
  FROM chained JOIN sized USING (c) GROUP BY d, path)
SELECT a.conv_id, a.d::BIGINT AS depth, any_value(up.conv_id) AS parent_conv_id, a.n AS n_convs,
  count(*) FILTER (s.d = a.d + 1) AS n_children, count(*) FILTER (NOT s.inner_node) AS n_leaves,
  sum((s.n - 1) * s.b)::BIGINT AS saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
FROM node a LEFT JOIN node up ON up.d = a.d - 1 AND up.path = substr(a.path, 1, 32 * (a.d - 1)) JOIN node s ON s.d >= a.d AND starts_with(s.path, a.path)
GROUP BY a.conv_id, a.d, a.path, a.n, a.ends
"""
