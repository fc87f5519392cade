"""Exact Jaccard join of documents on word 5-grams by token-combination prefixes.

A document's set holds the hashes of its distinct runs of SHINGLE words; a shorter document is one shingle as a whole.  The
global order of shingles is ascending (document frequency, hash); shingles of one document only can be shared with nobody
and are never indexed, yet they fill the prefixes first.  Two sets of sizes a >= b with at least THRESHOLD in common
share a shingle among the first b - ceil(THRESHOLD * b) + 1 of either.  Shingles of more than FREQUENT documents form the
frequent class: they are dealt into hash classes, a pair may miss one per class, so the prefix is extended by the number of
classes it touches and combinations of two of a class are indexed; rare shingles are indexed alone.

Candidates are settled without listing all pairs of a group.  Every member of an index entry is compared with the entry's
pivot first: the member with the fewest shingles of its own, so the text the others were made from.  Two members of a
pivot that both link with it are connected already; two others can only link if the most they may share, as known from
what each shares with the pivot and what each has beside it, reaches the threshold, and only these are compared.  The
members of a pivot are cut into blocks, and pairs of blocks go to different tasks.

Nulls: a null text is empty; a document without words has n_shingles 0 and links with nothing.  Documents with equal sets
link and are joined once, by one representative.  Rows that share an id are one document as far as links go (of several
texts with one id, one is compared); a row whose id is null has a null component.  Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import components, grams, in_batches, mix, texts, word_hashes, written
from quaestor.llm.counting import distinct, to_keys, with_totals, words_in

SHINGLE = 5
#: Two sets link when DENOMINATOR * common >= NUMERATOR * union.
NUMERATOR, DENOMINATOR = 75, 100
FREQUENT = 64
BATCH_BYTES = 8 << 20
BLOCK = 256
SETS = "id long, n int, c1 long, c2 long, shared binary, often int"


def shingles(table: pa.Table, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of all distinct shingles of all rows, ascending."""
    rows, keys, at = [], [], 0
    for chunk in table.column("text").chunks:
        for first, hashes, counts, _, _ in word_hashes(chunk):
            row = np.repeat(np.arange(len(counts)), counts) + at + first
            if len(hashes) >= width:
                whole = row[width - 1 :] == row[: len(row) - width + 1]
                rows.append(row[: len(row) - width + 1][whole])
                keys.append(grams(hashes, width)[whole])
            start = np.cumsum(counts) - counts
            for n in range(1, width):
                short = np.flatnonzero(counts == n)
                if len(short):
                    rows.append(short + at + first)
                    keys.append(mix(grams(hashes, n)[start[short]] ^ np.uint64(n)))
        at += len(chunk)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])
    return row[new], key[new]


def _keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return distinct(to_keys(shingles(table)[1]))


def _sets(table: pa.Table, totals: np.ndarray) -> pa.Table:
    """Per document: set size, a digest of the set, its shared shingles in global order, how many of these are frequent."""
    row, key = shingles(table)
    _, code = np.unique(to_keys(key), return_inverse=True)
    df = totals[code] if len(code) else np.zeros(0, np.int64)
    order = np.lexsort((key, df, row))
    row, key, df = row[order], key[order], df[order]
    sizes = np.bincount(row, minlength=table.num_rows)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(key + np.uint64(s)))]) for s in (1, 2)]
    digest = [(s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums]
    alone = np.concatenate([[0], np.cumsum(df < 2)])
    frequent = np.concatenate([[0], np.cumsum(df > FREQUENT)])
    first = bounds[:-1] + alone[bounds[1:]] - alone[bounds[:-1]]
    return pa.table(
        {
            "id": table.column("id"),
            "n": pa.array(sizes, pa.int32()),
            "c1": pa.array(digest[0], pa.int64()),
            "c2": pa.array(digest[1], pa.int64()),
            "shared": pa.array([key[a:b].tobytes() for a, b in zip(first, bounds[1:])], pa.binary()),
            "often": pa.array(frequent[bounds[1:]] - frequent[bounds[:-1]], pa.int32()),
        }
    )


def least(n: int) -> int:
    """The fewest shingles a set of n must share with any set it links with."""
    return -(-NUMERATOR * n // DENOMINATOR)


def _level(n: int) -> int:
    """Size classes a factor DENOMINATOR / NUMERATOR apart: linked sets are of the same or of neighbouring levels."""
    return int(np.log(n) / np.log(DENOMINATOR / NUMERATOR))


def signatures(n: int, shared: np.ndarray, often: int) -> np.ndarray:
    """Index entries of a set of n shingles, of which shared (in global order) occur elsewhere, the last often frequently."""
    rare = len(shared) - often
    free = n - len(shared)  # the shingles of this document alone stand first
    prefix = n - least(n) + 1
    single = shared[: max(0, min(rare, prefix - free))]
    if n == 1:  # links with sets of one shingle only
        return shared.view(np.int64)
    if prefix - free <= rare:
        return single.view(np.int64)
    out = [single]
    # a linked set may be one level lower or higher; both sides must deal into the same number of classes
    for level in (_level(n), _level(n) + 1):
        # few enough that a set of this level always has the tokens by which its prefix must grow
        classes = max(1, int((DENOMINATOR / NUMERATOR) ** level / 8))
        common = shared[rare:]
        group = (mix(common) % np.uint64(classes)).astype(np.int64)
        seen, end, missable = set(), 0, 0
        for g in group.tolist():
            if free + rare + end - missable >= prefix:
                break
            end += 1
            if g not in seen:
                seen.add(g)
                missable += 1
        order = np.argsort(group[:end], kind="stable")
        g, s = group[:end][order], common[:end][order]
        for start, stop in zip(np.flatnonzero(np.diff(g, prepend=-1)), np.append(np.flatnonzero(np.diff(g)) + 1, len(g))):
            a, b = np.triu_indices(stop - start, 1)
            out.append(mix(s[start:stop][a] * np.uint64(3) + s[start:stop][b] * np.uint64(5) + np.uint64(level)))
    return np.concatenate(out).view(np.int64)


def _index(batches):
    for batch in batches:
        ids, sigs, alone = [], [], []
        for i, n, shared, often in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "shared", "often"))):
            found = signatures(n, np.frombuffer(shared, np.uint64), often) if shared else np.zeros(0, np.int64)
            ids.append(np.full(len(found), i))
            sigs.append(found)
            alone.append(np.full(len(found), n - len(shared) // 8))
        if ids:
            columns = zip((sigs, ids, alone), (pa.int64(), pa.int64(), pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in columns], ["sig", "id", "alone"])


def _overlaps(batches):
    for batch in batches:
        both = [
            len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
            for x, y in zip(batch.column("xs").to_pylist(), batch.column("ys").to_pylist())
        ]
        yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(both, pa.int32())], ["x", "y", "both"])


def overlaps(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """x, y, both: how many shingles the sets of each pair share."""
    xs = pairs.join(sets.select(F.col("id").alias("x"), F.col("shared").alias("xs")), "x")
    return written(
        xs.join(sets.select(F.col("id").alias("y"), F.col("shared").alias("ys")), "y")
        .select("x", "y", "xs", "ys")
        .mapInArrow(_overlaps, "x long, y long, both int"),
        name,
    )


def linked(both, nx, ny):
    """Expression or numbers: the pair reaches the threshold."""
    return both * (DENOMINATOR + NUMERATOR) >= (nx + ny) * NUMERATOR


def _open_pairs(table: pa.Table) -> pa.Table:
    """Pairs across two blocks of one pivot's members that what they share with the pivot does not settle."""
    col = {c: table.column(c).to_numpy() for c in ("id", "n", "m", "both", "ok", "block", "a", "b")}
    left, right = col["block"] == col["a"], col["block"] == col["b"]
    pick = lambda side: {c: col[c][side] for c in ("id", "n", "m", "both", "ok")}
    x, y, found = pick(left), pick(right), []
    for k in range(len(x["id"])):
        most = np.minimum(x["both"][k], y["both"]) + np.minimum(x["m"][k] - x["both"][k], y["m"] - y["both"])
        size = x["n"][k] + y["n"]
        may = (x["id"][k] < y["id"]) & ~(x["ok"][k] & y["ok"]) & linked(np.minimum(most, np.minimum(x["n"][k], y["n"])), 0, size)
        hits = y["id"][may]
        if len(hits):
            found.append((np.full(len(hits), x["id"][k]), hits))
    if col["a"][0] != col["b"][0]:  # ids ascend across the blocks only by chance: the other half
        for k in range(len(y["id"])):
            most = np.minimum(y["both"][k], x["both"]) + np.minimum(y["m"][k] - y["both"][k], x["m"] - x["both"])
            size = y["n"][k] + x["n"]
            may = (y["id"][k] < x["id"]) & ~(y["ok"][k] & x["ok"]) & linked(np.minimum(most, np.minimum(y["n"][k], x["n"])), 0, size)
            hits = x["id"][may]
            if len(hits):
                found.append((np.full(len(hits), y["id"][k]), hits))
    xs = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    ys = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    return pa.table({"x": pa.array(xs, pa.int64()), "y": pa.array(ys, pa.int64())})


def links(reps: DataFrame) -> DataFrame:
    """a, b: links between representatives that connect exactly what all links connect.  reps: id, n, shared, often."""
    index = written(reps.mapInArrow(_index, "sig long, id long, alone int").distinct(), "index")
    # the pivot has the fewest shingles of its own: the text the others were made from, where there is one
    rank = F.col("alone") + F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    entries = index.groupBy("sig").agg(F.min_by("id", rank).alias("pivot"), F.count(F.lit(1)).alias("members"))
    entries = written(entries.where("members > 1"), "entries")
    members = index.join(entries, "sig")
    sizes = reps.select("id", "n", (F.octet_length("shared") / 8).cast("int").alias("m"))
    stars = members.where("id <> pivot").select(F.col("id").alias("x"), F.col("pivot").alias("y")).distinct()
    known = overlaps(stars, reps, "stars")
    sized = (
        known.join(sizes.select(F.col("id").alias("x"), F.col("n").alias("nx"), "m"), "x")
        .join(sizes.select(F.col("id").alias("y"), F.col("n").alias("ny")), "y")
        .select("x", "y", "nx", "m", "both", linked(F.col("both"), F.col("nx"), F.col("ny")).alias("ok"))
    )
    sized = written(sized, "sized")
    # what is left: members of one pivot's entries that do not all link with it
    mixed = sized.groupBy("y").agg(F.count(F.lit(1)).alias("members"), F.bool_and("ok").alias("all")).where("members > 1 and not all")
    dealt = (
        sized.join(mixed.select("y", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), "y")
        .withColumn("block", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.col("y").alias("pivot"),
            F.col("x").alias("id"),
            F.col("nx").alias("n"),
            *("m", "both", "ok", "block"),
            F.least("block", "other").alias("a"),
            F.greatest("block", "other").alias("b"),
        )
    )
    rest = dealt.groupBy("pivot", "a", "b").applyInArrow(_open_pairs, "x long, y long").distinct()
    more = overlaps(rest, reps, "rest")
    sized_more = (
        more.join(sizes.select(F.col("id").alias("x"), F.col("n").alias("nx")), "x")
        .join(sizes.select(F.col("id").alias("y"), F.col("n").alias("ny")), "y")
        .where(linked(F.col("both"), F.col("nx"), F.col("ny")))
    )
    return sized.where("ok").select(F.col("x").alias("a"), F.col("y").alias("b")).union(
        sized_more.select(F.col("x").alias("a"), F.col("y").alias("b"))
    )


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    rows = texts(docs)
    sets = written(with_totals(in_batches(rows, BATCH_BYTES), _keys, _sets, SETS, words_in(rows)), "sets")
    classes = sets.where("n > 0").groupBy("c1", "c2", "n").agg(F.min("id").alias("rep"))
    # one set per id, should an id come with several texts
    chosen = classes.groupBy("rep").agg(F.min(F.struct("c1", "c2", "n")).alias("s")).select(F.col("rep").alias("id"), "s.*")
    reps = sets.join(chosen, ["id", "c1", "c2", "n"], "left_semi").dropDuplicates(["id"])
    reps = written(reps.select("id", "n", "shared", "often"), "reps")
    found = components(links(reps.where("length(shared) > 0")))
    classes = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "c1", "c2", "n", F.coalesce("component", "rep").alias("component")
    )
    return sets.join(classes, ["c1", "c2", "n"], "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
    )


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws,
  unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""
