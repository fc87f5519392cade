"""Ranking policies over scored hits: gates, cuts, re-ranking."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions import text as X


def by_score(*extra):
    return Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"), *extra)


def skip_lexical_gate(vector_hits: DataFrame, top: int = 8, minimum: float = 0.8) -> DataFrame:
    """query_id, n_hits, avg_score, skip: vector search alone suffices when its best eight are close enough."""
    return (
        vector_hits.groupBy("query_id")
        .agg(
            F.count(F.lit(1)).alias("n_hits"),
            F.round(F.avg(F.when(F.col("rank") <= top, F.col("score"))), 6).alias("avg_score"),
        )
        .withColumn("skip", (F.col("n_hits") >= top) & (F.col("avg_score") > minimum))
    )


def rerank_policy(
    queries: DataFrame, hits: DataFrame, max_candidates: int = 12, min_return: int = 3
) -> DataFrame:
    """Re-sort the best candidates by pair score, unless the policy says otherwise.

    hits: query_id, doc_id, rank, pair_score.  Result: query_id, doc_id, rank, reason, used_scores.
    """
    sizes = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.least(F.col("n"), F.lit(max_candidates))
    reasons = (
        queries.select("query_id", X.is_definitional(F.col("query")).alias("definitional"))
        .join(sizes, "query_id")
        .select(
            "query_id",
            F.when(F.col("definitional"), "skipped_definitional")
            .when(n < 2, "insufficient_candidates")
            .when(n < min_return, "collapse")
            .otherwise("ok")
            .alias("reason"),
        )
    )
    # a query's hits are a bounded list, so this join has no hot key
    out = hits.join(reasons, "query_id").where((F.col("reason") != "ok") | (F.col("rank") <= max_candidates))
    key = F.when(F.col("reason") == "ok", -F.col("pair_score")).otherwise(F.lit(0.0))
    w = Window.partitionBy("query_id").orderBy(key, "rank")
    return out.select(
        "query_id", "doc_id", F.row_number().over(w).alias("rank"), "reason", (F.col("reason") == "ok").alias("used_scores")
    )


def rerank_select(
    hits: DataFrame, min_score: float = 0.1, top_k: int = 8, min_required: int = 6, relaxed: float = 0.005
) -> DataFrame:
    """Adaptive cut.  hits: query_id, doc_id, score, is_empty.  Kept hits are a prefix of the score order."""
    q = Window.partitionBy("query_id")
    h = (
        hits.withColumn("_n", F.count(F.lit(1)).over(q))
        .withColumn("_max", F.max("score").over(q))
        .withColumn("_empty", F.sum(F.col("is_empty").cast("int")).over(q))
        .withColumn("rank", F.row_number().over(by_score()))
    )
    low = (F.col("_empty") > F.col("_n") * 0.3) | (F.col("_max") < 2 * min_score)
    threshold = F.when(low, min(min_score, relaxed)).otherwise(min_score)
    sure = F.least(F.greatest(F.lit(3), F.floor(F.col("_n") / 3)), F.lit(top_k), F.col("_n"))
    h = h.withColumn("threshold", threshold).withColumn(
        "_by_rule", (F.col("rank") <= top_k) & ((F.col("score") >= F.col("threshold")) | (F.col("rank") <= sure))
    )
    # whatever falls short of the minimum is topped up from the best of the rest
    return h.where(F.col("_by_rule") | (F.col("rank") <= min_required)).select(
        "query_id", "doc_id", "score", "rank", "threshold"
    )


def rerank_stats(hits: DataFrame, kept: DataFrame) -> DataFrame:
    """query_id, n, dropped, avg_score, best three scores."""
    before = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("score").alias("avg_score"),
    )
    top = (
        hits.withColumn("r", F.row_number().over(by_score()))
        .where("r <= 3")
        .groupBy("query_id")
        .agg(*[F.max(F.when(F.col("r") == i, F.col("score"))).alias(f"top{i}") for i in (1, 2, 3)])
    )
    after = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("kept"))
    return (
        before.join(top, "query_id")
        .join(after, "query_id", "left")
        .select("query_id", "n", (F.col("n") - F.coalesce("kept", F.lit(0))).alias("dropped"), "avg_score", "top1", "top2", "top3")
    )


def thin_queries(hits: DataFrame, minimum: int) -> DataFrame:
    """Queries with fewer distinct documents than the minimum."""
    return hits.groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_docs")).where(F.col("n_docs") < minimum)


def context_budget(hits: DataFrame, budget: int = 8000) -> DataFrame:
    """Prefix of each ranked list whose rendered size stays within the budget: the first overflow ends it."""
    block = F.concat(
        F.lit("[Source "), F.col("rank").cast("string"), F.lit(": "), F.col("title"), F.lit("]\n"), X.strip(F.col("text")),
        F.lit("\n"),
    )
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sized = hits.withColumn("block", block).withColumn("used", F.sum(F.length("block")).over(w))
    fits = sized.where(F.col("used") <= budget)
    return fits.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda b: b["block"]), "\n").alias(
            "context"
        ),
        F.count(F.lit(1)).alias("n_sources"),
    )


def previous_turn(turns: DataFrame, back: int, *columns: str) -> DataFrame:
    """Columns of the turn some positions earlier, prefixed p<back>_.

    Turns are numbered without gaps, so the earlier turn is an equality join.  Its key is unique, which keeps a
    conversation of any length from landing in one task the way a window would.
    """
    earlier = turns.select(
        "conv_id", (F.col("turn") + back).alias("turn"), *[F.col(c).alias(f"p{back}_{c}") for c in columns]
    )
    return turns.join(earlier, ["conv_id", "turn"], "left")


def condense_turns(turns: DataFrame, limit: int = 200) -> DataFrame:
    """Prefix each user turn with the beginning of the turn before it."""
    head = X.strip(F.substring("p1_text", 1, limit))
    question = F.when(
        F.coalesce(head, F.lit("")) != "",
        F.concat(F.lit("Given context: "), head, F.lit("... Current question: "), F.col("text")),
    ).otherwise(F.col("text"))
    return previous_turn(turns, 1, "text").where(F.col("role") == "user").withColumn("question", question)


def recent_context(turns: DataFrame, limit: int = 100) -> DataFrame:
    """The two turns before each one, questions whole and answers clipped."""
    line = F.when(F.col("role") == "user", F.concat(F.lit("Q: "), F.col("text"))).otherwise(
        F.concat(F.lit("A: "), X.clip(F.col("text"), limit))
    )
    lines = turns.select("conv_id", "turn", line.alias("line"))
    one = previous_turn(lines, 1, "line")
    two = lines.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("line").alias("p2_line"))
    return one.join(two, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.concat_ws("\n", "p2_line", "p1_line").alias("context")
    )
