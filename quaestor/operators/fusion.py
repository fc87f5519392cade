"""Fusing ranked lists.  A ranked list is query_id, doc_id, score, rank."""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions import text as X
from quaestor.operators.lexical import top_k

RRF_K = 60


def rrf(*lists: DataFrame, k: int = 50, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion: sum of 1 / (rrf_k + rank).

    raw_score is the score before fusion; where several lists hold a document the last list's copy wins.
    """
    ranked = reduce(
        DataFrame.unionByName,
        [r.select("query_id", "doc_id", "rank", F.struct(F.lit(i).alias("i"), "score").alias("raw")) for i, r in enumerate(lists)],
    )
    fused = ranked.groupBy("query_id", "doc_id").agg(
        F.sum(1.0 / (F.col("rank") + rrf_k)).alias("score"), F.max("raw").alias("raw")
    )
    return top_k(fused, k).withColumn("raw_score", F.col("raw.score")).drop("raw")


def best_per_doc(hits: DataFrame) -> DataFrame:
    """Several passages of a document count once, with their best score."""
    return hits.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def dedupe_docs(hits: DataFrame) -> DataFrame:
    """First sighting of each document in list order (position), then renumbered by score."""
    first = Window.partitionBy("query_id", "doc_id").orderBy("position")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "position")
    return (
        hits.withColumn("_n", F.row_number().over(first))
        .where("_n = 1")
        .withColumn("rank", F.row_number().over(order))
        .drop("_n")
    )


def round_robin(lists: DataFrame, k: int) -> DataFrame:
    """Interleave lists (list_no, rank) and keep the first k distinct documents per query."""
    seen = lists.groupBy("query_id", "doc_id").agg(F.min(F.struct("rank", "list_no")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at.rank", "at.list_no")
    return (
        seen.withColumn("position", F.row_number().over(w))
        .where(F.col("position") <= k)
        .select("query_id", "doc_id", "position", F.col("at.list_no").alias("list_no"))
    )


def merge_fallback(fallback: DataFrame, original: DataFrame) -> DataFrame:
    """All of the fallback list, then the originals it lacks."""
    extra = original.join(fallback, ["query_id", "doc_id"], "left_anti").withColumn("origin", F.lit("original"))
    both = fallback.withColumn("origin", F.lit("fallback")).unionByName(extra)
    w = Window.partitionBy("query_id").orderBy("origin", "rank")
    return both.withColumn("position", F.row_number().over(w))


def anchored_fusion(anchored: DataFrame, general: DataFrame, k: int = 50, default: float = 0.5) -> DataFrame:
    """Utility-anchored hits get 1.5 x their score, capped at .95, and win ties."""
    s = F.coalesce(F.col("score"), F.lit(default))
    a = anchored.select("query_id", "doc_id", F.least(s * 1.5, F.lit(0.95)).alias("weighted"), F.lit(1).alias("anchored"))
    g = general.select("query_id", "doc_id", s.alias("weighted"), F.lit(0).alias("anchored"))
    w = Window.partitionBy("query_id").orderBy(F.desc("weighted"), F.desc("anchored"), "doc_id")
    return (
        a.unionByName(g)
        .withColumn("weighted", F.round("weighted", 9))
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
    )


def calibrate(score: Column, idx: Column) -> Column:
    """Weight by index (1.2 main), then lift API scores towards the others."""
    weighted = score * F.when(idx == "api", 1.0).otherwise(1.2)
    return F.when(idx == "api", F.least(weighted * 2.5, F.lit(0.95))).otherwise(weighted)


def comparison_merge(sides: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """sides: query_id, side (1 or 2), doc_id, rank.  Side 1 gets 10 % more; both sides show up in the first six."""
    score = 1.0 / (F.col("rank") + rrf_k) * F.when(F.col("side") == 1, 1.1).otherwise(1.0)
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "side", "doc_id")
    per_query = Window.partitionBy("query_id")
    merged = sides.withColumn("score", F.round(score, 9)).withColumn("position", F.row_number().over(by_score))
    missing = F.when(
        F.max(F.when((F.col("position") <= 6) & (F.col("side") == 1), 1).otherwise(0)).over(per_query) == 0, 1
    ).when(F.max(F.when((F.col("position") <= 6) & (F.col("side") == 2), 1).otherwise(0)).over(per_query) == 0, 2)
    merged = merged.withColumn("_missing", missing)
    # the best later hit of the missing side takes slot six as well; the hit that held it is gone
    stand_in = F.min(F.when((F.col("side") == F.col("_missing")) & (F.col("position") > 6), F.col("position"))).over(
        per_query
    )
    merged = merged.withColumn("_stand_in", stand_in)
    kept = merged.where(~((F.col("position") == 6) & F.col("_stand_in").isNotNull()))
    swapped = merged.where(F.col("position") == F.col("_stand_in")).withColumn("position", F.lit(6))
    return kept.unionByName(swapped).drop("_missing", "_stand_in")


def comparison_confidence(sides: DataFrame, queries: DataFrame) -> DataFrame:
    """sides: query_id, side, score, mentioned.  queries: query_id of every comparison, hits or none."""
    side = {n: F.col("side") == n for n in (1, 2)}
    agg = sides.groupBy("query_id").agg(
        *[F.count_if(side[n]).alias(f"n{n}") for n in (1, 2)],
        *[F.avg(F.when(side[n], F.col("score"))).alias(f"avg{n}") for n in (1, 2)],
        F.count_if("mentioned").alias("mentions"),
    )
    n1, n2 = F.coalesce("n1", F.lit(0)), F.coalesce("n2", F.lit(0))
    value = (
        F.when((n1 == 0) | (n2 == 0), 0.2)
        .when((n1 < 2) | (n2 < 2), 0.4)
        .otherwise(F.least(F.col("mentions") / (n1 + n2) + (F.col("avg1") + F.col("avg2")) / 2, F.lit(1.0)))
    )
    return queries.select("query_id").join(agg, "query_id", "left").select("query_id", value.alias("confidence"))


def time_decay(score: Column, updated_at: Column, as_of, half_life_days: float = 120) -> Column:
    age = F.datediff(F.lit(as_of).cast("date"), updated_at)
    return score * F.pow(F.lit(0.5), age / half_life_days)


# ------------------------------------------------------------------------------------------------ diversity
def term_vectors(docs: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    """doc_id, terms map<string,int>: what the diversity selection compares, built once per document."""
    t = docs.select("doc_id", F.explode(X.index_tokens(F.concat_ws(" ", F.col(title), F.col(text)))).alias("term"))
    counts = t.groupBy("doc_id", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    return counts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("terms"))


ONE_SIDED = 1.0 + 0.4054651081081644  # 1 + ln(1.5): the weight of a term that only one of two texts has


#: Terms of the matrix that similarities are made from at a time.
TERMS_AT_ONCE = 4096


def similarities(maps: list) -> np.ndarray:
    """TF-IDF cosine of every two texts of a list when the two are the whole collection.

    A term that both have weighs 1, one of a single text ONE_SIDED, so two products over the terms that at least two texts
    share give all pairs: of the frequencies, and of their squares with the other text's presence.
    """
    number: dict[str, int] = {}
    parts = []
    for i, t in enumerate(maps):
        t = t if isinstance(t, dict) else dict(t)
        terms = np.fromiter((number.setdefault(w, len(number)) for w in t), np.int64, len(t))
        parts.append((np.full(len(t), i), terms, np.fromiter(t.values(), np.float64, len(t))))
    row, term, tf = (np.concatenate(x) for x in zip(*parts))
    total = np.bincount(row, tf * tf, minlength=len(maps))
    used = np.bincount(term, minlength=len(number))
    place = np.cumsum(used > 1) - 1
    shared = used[term] > 1
    row, term, tf = row[shared], place[term[shared]], tf[shared]
    dot, own = np.zeros((len(maps), len(maps))), np.zeros((len(maps), len(maps)))
    for at in range(0, int((used > 1).sum()), TERMS_AT_ONCE):
        here = (term >= at) & (term < at + TERMS_AT_ONCE)
        m = np.zeros((len(maps), TERMS_AT_ONCE))
        m[row[here], term[here] - at] = tf[here]
        dot += m @ m.T
        own += (m * m) @ (m > 0).T.astype(np.float64)
    weighted = own + (total[:, None] - own) * ONE_SIDED**2
    return np.divide(dot, np.sqrt(weighted * weighted.T), out=np.zeros_like(dot), where=dot > 0)


def _greedy(candidates: pd.DataFrame, k: int, weight: float) -> pd.DataFrame:
    c = candidates.sort_values("rank")
    sims = similarities(c["terms"].tolist())
    nearest = np.zeros(len(c))  # similarity of each hit to the most similar chosen one
    n, rows = 0, []
    for i, (doc, rank, rrf_score, rel) in enumerate(zip(c["doc_id"], c["rank"], c["score"], c["relevance"])):
        if n >= k:
            break
        sim = float(nearest[i])
        value = weight * rel + 0.3 * rrf_score - (1 - weight) * sim
        keep = value > 0 or n < 3
        if keep:
            n += 1
            nearest = np.maximum(nearest, sims[i])
        rows.append((c["query_id"].iloc[0], doc, int(rank), round(sim, 6), round(value, 6), bool(keep)))
    return pd.DataFrame(rows, columns=["query_id", "doc_id", "rank", "max_sim", "mmr", "selected"])


def mmr(candidates: DataFrame, k: int = 36, weight: float = 0.75) -> DataFrame:
    """Greedy diversity selection.  candidates: query_id, doc_id, rank, score, relevance, terms.

    The choice at one position depends on all earlier ones, so a query is one group; a group is a fused list and
    therefore no longer than the two lists it came from.
    """
    id_type = candidates.schema["query_id"].dataType.simpleString()
    return candidates.groupBy("query_id").applyInPandas(
        lambda pdf: _greedy(pdf, k, weight),
        f"query_id {id_type}, doc_id long, rank int, max_sim double, mmr double, selected boolean",
    )


def nearest_better(candidates: DataFrame) -> DataFrame:
    """For each hit the most similar better-ranked hit of its (bounded) list."""

    def run(pdf):
        c = pdf.sort_values("rank")
        sims = np.round(similarities(c["terms"].tolist()), 6)
        docs = c["doc_id"].tolist()
        best = [int(np.argmax(sims[i, :i])) for i in range(1, len(docs))]  # the first of equals is the better-ranked
        rows = [(c["query_id"].iloc[0], docs[i], docs[j], float(sims[i, j])) for i, j in enumerate(best, 1)]
        return pd.DataFrame(rows, columns=["query_id", "doc_id", "nearest_doc_id", "similarity"])

    id_type = candidates.schema["query_id"].dataType.simpleString()
    return candidates.groupBy("query_id").applyInPandas(
        run, f"query_id {id_type}, doc_id long, nearest_doc_id long, similarity double"
    )


def tfidf_pairs(pairs: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """TF-IDF cosine of given (query, document) pairs, as term joins."""
    q = queries.select("query_id", F.explode(X.index_tokens(F.col("query"))).alias("term"))
    q = q.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("tf_q"))
    ids = pairs.select("query_id", "doc_id")
    d = ids.join(docs.select("doc_id", "text"), "doc_id").select(
        "query_id", "doc_id", F.explode(X.index_tokens(F.col("text"))).alias("term")
    )
    d = d.groupBy("query_id", "doc_id", "term").agg(F.count(F.lit(1)).alias("tf_d"))
    both = d.join(ids.join(q, "query_id"), ["query_id", "doc_id", "term"], "full")
    tq, td = F.coalesce("tf_q", F.lit(0)), F.coalesce("tf_d", F.lit(0))
    shared = (tq > 0) & (td > 0)
    w = F.when(shared, 1.0).otherwise(ONE_SIDED)
    return both.groupBy("query_id", "doc_id").agg(
        (
            F.sum(tq * td * w * w) / F.nullif(F.sqrt(F.sum(tq * tq * w * w)) * F.sqrt(F.sum(td * td * w * w)), F.lit(0.0))
        ).alias("similarity")
    )
