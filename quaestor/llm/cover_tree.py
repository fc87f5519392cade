"""Exact embedding near-duplicates by cover trees and their dual traversal.

Vectors of a label form a cover tree of nested levels: level d holds centres that are at least RADIUS / 2 ** d apart, every
vector below hangs on its nearest centre, and each node knows its covering radius, the largest distance to what it holds.
The upper levels are tables; a node is split while it holds more than LEAF vectors, and what no radius can split (copies)
is cut into blocks by hash.  The dual traversal starts at the pair (root, root) of each label and goes down level by level,
dropping node pairs whose centres are further apart than the sum of their covering radii and the threshold distance.  The
pairs of leaves that remain are tasks of their own: each builds the last levels of its two trees, drops node pairs by the
same bound, takes node pairs that lie within the threshold as a whole, and compares the rest in double precision.

Only vectors of equal label and length are compared; equal vectors are one with a count.  Vectors that are null, zero or
hold null or non-finite components, and rows without label, link with nothing.  Rows that share an id link as one id; a
row without an id links, counts, and has a null component.  Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import components, written

COSINE = 0.98
RADIUS = 1.0
LEAF = 1024
FAN_OUT = 32
SAMPLE = 512
DEPTH = 12
#: Levels inside a leaf end at this radius.
LAST = 0.125
#: Slack of the bounds for rounding, and where distances come from products; the comparison itself has none.
SLACK = 1e-9
ROUGH = 1e-6
#: Distances of node pairs held at a time.
GAPS = 1 << 21


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1) if raw else np.zeros((0, 1))


def _unit(batches):
    """Normalised double vectors as bytes; null where a vector cannot link."""
    for batch in batches:
        out = []
        for v in batch.column("embedding").to_pylist():
            a = np.array(v, np.float64) if v and None not in v else np.zeros(1)
            norm = np.linalg.norm(a / max(np.abs(a).max(), 1e-300)) * np.abs(a).max() if np.isfinite(a).all() else 0.0
            out.append((a / norm).tobytes() if norm > 0 and np.isfinite(norm) else None)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(out, pa.binary())], ["id", "label", "v"])


def farthest(points: np.ndarray, apart: float, most: int) -> np.ndarray:
    """Centres at least `apart` from each other, farthest first, until all points are covered or there are `most`.

    Points are unit vectors, so the largest product with a centre tells the nearest one; radii are measured afterwards.
    """
    centres, closest = [0], points @ points[0]
    while len(centres) < most and closest.min() < 1 - apart * apart / 2:
        centres.append(int(closest.argmin()))
        np.maximum(closest, points @ points[centres[-1]], out=closest)
    return points[centres]


def _centres(depth: int):
    def run(table: pa.Table) -> pa.Table:
        points = _vectors(table.column("v").take(np.argsort(table.column("id").to_numpy())))
        n = table.column("n")[0].as_py()
        found = farthest(points, RADIUS / 2**depth, min(FAN_OUT, max(2, math.ceil(2 * n / LEAF))))
        return pa.table({"node": table.column("node").slice(0, 1), "centres": pa.array([found.tobytes()], pa.binary())})

    return run


def _assign(batches):
    """The nearest centre of each vector's node: its number, and the distance to it."""
    for batch in batches:
        vectors, centres = batch.column("v").to_pylist(), batch.column("centres").to_pylist()
        number, far, where = [], [], []
        last, table = None, None
        for v, c in zip(vectors, centres):
            if c is not last:
                last, table = c, np.frombuffer(c, np.float64).reshape(-1, len(v) // 8)
            gap = np.linalg.norm(table - np.frombuffer(v, np.float64), axis=1)
            number.append(int(gap.argmin()))
            far.append(float(gap.min()))
            where.append(table[number[-1]].tobytes())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("id", "copies", "v", "node")), pa.array(number, pa.int32()), pa.array(far, pa.float64()), pa.array(where, pa.binary())],
            ["id", "copies", "v", "node", "number", "far", "centre"],
        )


def _apart(batches):
    """Distance of the centres of each node pair."""
    for batch in batches:
        a, b = batch.column("ca").to_pylist(), batch.column("cb").to_pylist()
        gap = [float(np.linalg.norm(np.frombuffer(x, np.float64) - np.frombuffer(y, np.float64))) for x, y in zip(a, b)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("a", "b", "ra", "rb")), pa.array(gap, pa.float64())], ["a", "b", "ra", "rb", "gap"]
        )


def _nested(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The last levels of a tree: node of each point, node centres and covering radii, at radius LAST.

    A node of one level is split by centres half as far apart until LAST is reached.
    """
    node, radius = np.zeros(len(points), np.int64), RADIUS
    while radius > LAST:
        radius /= 2
        fresh, count = np.empty_like(node), 0
        for k in range(int(node.max(initial=-1)) + 1):
            members = np.flatnonzero(node == k)
            if len(members) == 1:
                fresh[members] = count
                count += 1
                continue
            centres = farthest(points[members], radius, len(members))
            gaps = np.sqrt(np.maximum(0, 2 - 2 * points[members] @ centres.T))
            fresh[members] = count + gaps.argmin(1)
            count += len(centres)
        _, node = np.unique(fresh, return_inverse=True)
    order = np.argsort(node, kind="stable")
    first = np.searchsorted(node[order], np.arange(node.max() + 1))
    centres = points[order[first]]
    radii = np.zeros(len(centres))
    np.maximum.at(radii, node, np.linalg.norm(points - centres[node], axis=1))
    return node, centres, radii


def linked_pairs(x: np.ndarray, y: np.ndarray, cosine: float):
    """Yield (rows of x, rows of y) that link: stretches of node pairs of the two trees."""
    limit = math.sqrt(2 - 2 * cosine)
    nx, cx, rx = _nested(x)
    ny, cy, ry = _nested(y)
    by_x, by_y = np.argsort(nx, kind="stable"), np.argsort(ny, kind="stable")
    at_x, at_y = (np.searchsorted(n[by], np.arange(len(c) + 1)) for n, by, c in ((nx, by_x, cx), (ny, by_y, cy)))
    step = max(1, GAPS // max(1, len(cy)))
    for first in range(0, len(cx), step):
        # distances of unit vectors from one product; its rounding is far below ROUGH, and what it leaves is compared exactly
        gaps = np.sqrt(np.maximum(0, 2 - 2 * cx[first : first + step] @ cy.T))
        reach = rx[first : first + step, None] + ry
        for k, near in _rows(gaps <= reach + limit + ROUGH):
            left = by_x[at_x[first + k] : at_x[first + k + 1]]
            whole = gaps[k, near] + reach[k, near] <= limit - ROUGH
            right = np.concatenate([by_y[at_y[j] : at_y[j + 1]] for j in near])
            sure = np.repeat(whole, at_y[near + 1] - at_y[near])
            hit = sure | (np.einsum("id,jd->ij", x[left], y[right]) >= cosine)
            i, j = np.nonzero(hit)
            if len(i):
                yield left[i], right[j]


def _rows(mask: np.ndarray):
    """(row, its columns) of the rows that have any."""
    row, column = np.nonzero(mask)
    cuts = np.flatnonzero(np.diff(row)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(row)]):
        if a < b:
            yield int(row[a]), column[a:b]


def _compare(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        """Links between the two leaves of a pair: per vector the links' count and one neighbour that spans its component."""
        side = table.column("side").to_numpy()
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        v = _vectors(table.column("v"))
        same = table.column("a")[0].as_py() == table.column("b")[0].as_py()
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "to": pa.array([], pa.int64())})
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for i, j in linked_pairs(v[left], v[right], cosine):
            i, j = left[i], right[j]
            other = i != j
            i, j = i[other], j[other]
            np.add.at(links, i, copies[j])
            if not same:
                np.add.at(links, j, copies[i])
            for a, b in set(zip(map(find, i.tolist()), map(find, j.tolist()))):
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
        has = np.flatnonzero(links)
        to = ids[[find(k) for k in has.tolist()]] if len(has) else ids[:0]
        return pa.table({"id": pa.array(ids[has], pa.int64()), "links": pa.array(links[has], pa.int64()), "to": pa.array(to, pa.int64())})

    return run


def _leaves(classes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Vectors with their leaf, and the tables of nodes level by level: node, parent, centre, radius."""
    rows = classes.select("id", "copies", "v", F.xxhash64("label", F.length("v")).alias("node"))
    levels = []
    for depth in range(DEPTH):
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LEAF)
        sizes = written(sizes, "sizes")
        if sizes.isEmpty():
            break
        picked = rows.join(sizes, "node").where(F.pmod(F.xxhash64("id", F.lit(depth)), F.col("n")) < SAMPLE)
        centres = picked.select("id", "v", "node", "n").groupBy("node").applyInArrow(_centres(depth), "node long, centres binary")
        split = rows.join(centres, "node").mapInArrow(
            _assign, "id long, copies long, v binary, node long, number int, far double, centre binary"
        )
        child = F.xxhash64("node", "number", F.lit(depth))
        split = written(split.select("id", "copies", "v", F.col("node").alias("parent"), child.alias("node"), "far", "centre"), "split")
        nodes = split.groupBy("node", "parent").agg(F.min("centre").alias("centre"), F.max("far").alias("radius"))
        levels.append(written(nodes, "nodes"))
        rest = rows.join(sizes, "node", "left_anti").select("id", "copies", "v", "node")
        rows = written(split.select("id", "copies", "v", "node").union(rest), "rows")
        if depth and RADIUS / 2**depth < 1 - COSINE:
            break
    return rows, levels


def _candidates(rows: DataFrame, levels: list[DataFrame], limit: float) -> DataFrame:
    """a, b (a <= b): leaf pairs that the covering radii do not rule out."""
    tops = rows.select("node")
    for nodes in levels:
        tops = tops.union(nodes.select(F.col("parent").alias("node")))
    tops = tops.distinct()
    for nodes in levels:
        tops = tops.join(nodes.select("node"), "node", "left_anti")
    pairs = tops.select(F.col("node").alias("a"), F.col("node").alias("b"))
    for nodes in levels:
        below = nodes.select(F.col("parent").alias("up"), "node", "centre", "radius")
        # nodes that were not split stand for themselves, without a bound
        one = below.select("up", F.struct("node", "centre", "radius").alias("x"))
        spread = (
            pairs.join(one.select(F.col("up").alias("a"), F.col("x").alias("xa")), "a", "left")
            .join(one.select(F.col("up").alias("b"), F.col("x").alias("xb")), "b", "left")
            .select(
                F.coalesce("xa.node", "a").alias("a"),
                F.coalesce("xb.node", "b").alias("b"),
                F.coalesce("xa.centre", "xb.centre").alias("ca"),
                F.coalesce("xb.centre", "xa.centre").alias("cb"),
                F.coalesce("xa.radius", F.lit(2.0)).alias("ra"),
                F.coalesce("xb.radius", F.lit(2.0)).alias("rb"),
            )
        )
        known = spread.where("ca is not null").mapInArrow(_apart, "a long, b long, ra double, rb double, gap double")
        kept = known.where(F.col("gap") <= F.col("ra") + F.col("rb") + limit + SLACK).select("a", "b")
        kept = kept.union(spread.where("ca is null").select("a", "b"))
        pairs = written(kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    return pairs


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of rows (vec_id, embedding, label)."""
    raw = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>"))
    unit = written(raw.mapInArrow(_unit, "id long, label string, v binary"), "unit")
    able = unit.where("v is not null and label is not null")
    # ids may be null or repeat: a class of equal vectors goes by its smallest id, or by its hash
    classes = able.groupBy("label", "v").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("rep"))
    classes = written(classes.withColumn("id", F.xxhash64("label", "v")), "classes")
    rows, levels = _leaves(classes)
    pairs = _candidates(rows, levels, math.sqrt(2 - 2 * cosine))
    # copies that no radius splits, and any large leaf, in blocks
    blocks = rows.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / (2 * LEAF)).cast("int").alias("blocks"))
    blocks = written(blocks, "blocks")
    numbers = blocks.select("node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    name = F.xxhash64("node", "k")
    left = numbers.select(F.col("node").alias("a"), name.alias("x"))
    right = numbers.select(F.col("node").alias("b"), name.alias("y"))
    tasks = pairs.join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    tasks = written(tasks, "tasks")
    placed = rows.join(blocks, "node").select(
        "id", "copies", "v", F.xxhash64("node", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int")).alias("block")
    )
    sides = tasks.select("a", "b", F.col("a").alias("block"), F.lit(0).alias("side")).union(
        tasks.where("a <> b").select("a", "b", F.col("b").alias("block"), F.lit(1).alias("side"))
    )
    dealt = sides.join(placed, "block").select("a", "b", "side", "id", "copies", "v")
    found = written(dealt.groupBy("a", "b").applyInArrow(_compare(cosine), "id long, links long, to long"), "found")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    named = (
        classes.select("id", "label", "v", "copies", "rep")
        .join(linked.withColumnRenamed("node", "id"), "id", "left")
        .join(counts, "id", "left")
        .withColumn("group", F.coalesce("component", "id"))
    )
    lowest = named.groupBy("group").agg(F.min("rep").alias("component_id"))
    named = named.join(lowest, "group").select("label", "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    joined = unit.join(named, ["label", "v"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return joined.select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


ORACLE = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL),
n AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS s FROM e),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (a.s * b.s) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id)::BIGINT AS n_links, c.c AS component_id, v.vec_id = c.c AS kept
FROM embeddings v JOIN c ON c.a = v.vec_id
"""
