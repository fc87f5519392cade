"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

The terms of a text are its words in lower case, weighted by how often they occur.  Sample d of a text draws, for every
term, r and c from Gamma(2, 1) and b uniformly, all from hashes of (term, d); with t = floor(ln(weight) / r + b) the term
that minimises ln(c) - r * (t - b + 1) is chosen, and (term, t) is the sample.  Two texts agree in a sample with a
probability equal to their generalised Jaccard similarity, the sum of the smaller over the sum of the larger weights.

Nulls: a null text is empty; a text without words has the empty word as its only term, so all such texts are alike.  The
next document is the one of the next lower id (after the last: the first); null ids stand last, texts of one id go by
their hash, and repeated rows are one document with one result, returned once per row.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.llm.common import texts, written

#: Samples per fingerprint: GROUPS rows of WIDTH.
GROUPS, WIDTH = 4, 8
SAMPLES = GROUPS * WIDTH
BLANKS = r"[ \t\n\x0B\f\r]+"


def _unit(h: Column, shift: int) -> Column:
    """A number in (0, 1) from 32 bits of a hash."""
    bits = F.shiftrightunsigned(h, shift) if shift else h
    return (bits.bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(0.5)) * F.lit(2.0**-32)


def term_weights(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, term (a hash), log_weight.  Rows stand in the table `copies` times each."""
    found = F.filter(F.split(F.lower(text), BLANKS), lambda w: w != "")
    terms = F.when(F.length(F.trim(F.translate(text, "\t\n\x0b\f\r", "     "))) > 0, found).otherwise(F.array(F.lit("")))
    return (
        rows.select(*keys, "copies", F.explode(terms).alias("word"))
        .select(*keys, "copies", F.xxhash64("word").alias("term"))
        .groupBy(*keys, "term")
        .agg((F.count(F.lit(1)) / F.max("copies")).alias("weight"))
        .select(*keys, "term", F.log("weight").alias("log_weight"))
    )


def samples(weights: DataFrame, keys: list[str]) -> DataFrame:
    """keys, samples (array of SAMPLES ints)."""
    rows = weights.select(*keys, "term", "log_weight", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))).alias("part"))
    chosen = []
    for k in range(WIDTH):
        h1 = F.xxhash64("term", "part", F.lit(k))
        h2, h3 = F.xxhash64(h1, F.lit(1)), F.xxhash64(h1, F.lit(2))
        r = -F.log(_unit(h1, 0) * _unit(h1, 32))
        log_c = F.log(-F.log(_unit(h2, 0) * _unit(h2, 32)))
        b = _unit(h3, 0)
        t = F.floor(F.col("log_weight") / r + b)
        rank = log_c - r * (t - b + F.lit(1.0))
        chosen.append(F.min_by(F.hash("term", t), rank).alias(f"s{k}"))
    parts = rows.groupBy(*keys, "part").agg(*chosen)
    packed = F.struct("part", F.array(*[f"s{k}" for k in range(WIDTH)]).alias("s"))
    return parts.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(packed)), lambda p: p["s"])).alias("samples"))


def likeness(a: str, b: str) -> Column:
    """Share of equal samples: an estimate of the generalised Jaccard similarity."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.lit(float(SAMPLES))


def as_string(column: str) -> Column:
    """Eight hexadecimal digits per sample."""
    return F.array_join(F.transform(column, lambda s: F.right(F.lpad(F.lower(F.hex(s)), 8, "0"), F.lit(8))), "")


def chain(keys: DataFrame) -> DataFrame:
    """The keys' own columns with next_o, next_nt of the key that follows in descending (o, nt) order (after the last: the first).

    Keys are range-partitioned; inside a partition the next key is the next row, and only each partition's first key goes
    into one small window.
    """
    ranged = written(keys.repartitionByRange(F.desc("o"), F.desc("nt")).withColumn("pid", F.spark_partition_id()), "keys")
    inside = Window.partitionBy("pid").orderBy(F.desc("o"), F.desc("nt"))
    firsts = ranged.groupBy("pid").agg(F.max(F.struct("o", "nt")).alias("first"))
    by_pid = Window.orderBy("pid")  # one row per partition
    following = firsts.select(
        "pid",
        F.coalesce(F.lead("first").over(by_pid), F.first("first").over(by_pid)).alias("beyond"),
    )
    return (
        ranged.withColumn("next", F.lead(F.struct("o", "nt")).over(inside))
        .join(following, "pid")
        .select("o", "nt", "n", "copies", F.coalesce("next", "beyond").alias("next"))
        .select("o", "nt", "n", "copies", F.col("next.o").alias("next_o"), F.col("next.nt").alias("next_nt"))
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    base = texts(docs).select(
        "id",
        "text",
        F.coalesce("id", F.lit(-(1 << 63))).alias("o"),
        F.bitwise_not(F.xxhash64("text")).alias("nt"),
    )
    keys = base.groupBy("o", "nt", F.length("text").alias("n")).agg(F.count(F.lit(1)).alias("copies"))
    links = written(chain(keys), "chain")
    wanted = links.select(F.col("o").alias("ro"), F.col("nt").alias("rnt"), "n", "copies", F.col("next_o").alias("o"), F.col("next_nt").alias("nt"))
    third = F.floor(F.col("n") / 3).cast("int")
    one = base.select("o", "nt", "text")  # repeated rows share their key, and are told apart only at the end
    heads = (
        one.join(wanted, ["o", "nt"])
        .select(F.col("ro").alias("o"), F.col("rnt").alias("nt"), "n", "copies", F.substring("text", F.lit(1), third).alias("head"))
        .groupBy("o", "nt")
        .agg(F.max("n").alias("n"), F.max("copies").alias("copies"), F.max("head").alias("head"))
    )
    both = one.join(heads, ["o", "nt"]).select(
        "o", "nt", "copies", "text", F.concat(F.substring("text", F.lit(1), F.col("n") - third), "head").alias("edited")
    )
    either = F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("t"))))
    rows = both.select("o", "nt", "copies", either.alias("e")).select("o", "nt", "copies", F.col("e.v").alias("v"), F.col("e.t").alias("text"))
    keyed = ["o", "nt", "v"]
    signs = samples(term_weights(rows, keyed), keyed)
    own = signs.groupBy("o", "nt").agg(
        F.max(F.when(F.col("v") == 0, F.col("samples"))).alias("own"), F.max(F.when(F.col("v") == 1, F.col("samples"))).alias("edited")
    )
    shas = both.groupBy("o", "nt").agg(F.max(F.sha2(F.col("edited").cast("binary"), 256)).alias("edited_sha256"))
    found = written(own.join(shas, ["o", "nt"]).select("o", "nt", "own", "edited", "edited_sha256"), "samples")
    following = found.select(F.col("o").alias("next_o"), F.col("nt").alias("next_nt"), F.col("own").alias("next"))
    done = (
        found.join(links, ["o", "nt"])
        .join(following, ["next_o", "next_nt"])
        .select(
            "o",
            "nt",
            F.col("n").cast("long").alias("n_chars"),
            "edited_sha256",
            as_string("own").alias("fingerprint"),
            as_string("edited").alias("edited_fingerprint"),
            likeness("own", "edited").alias("near_edited"),
            likeness("own", "next").alias("near_next"),
        )
    )
    return base.select(F.col("id").alias("doc_id"), "o", "nt").join(done, ["o", "nt"]).drop("o", "nt")
