"""Coverage evaluation and answer verification."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions import rules as R
from quaestor.functions import text as X
from quaestor.functions.vectors import sigmoid

TAU, ALPHA, GATE_RECALL, GATE_NDCG, MIN_ACTIONABLE = 0.25, 0.5, 0.60, 0.40, 3


# -------------------------------------------------------------------------------------------------- coverage
def subqueries(queries: DataFrame) -> DataFrame:
    """query_id, subq_id, subquery."""
    return queries.select("query_id", F.posexplode(X.decompose(F.col("query"))).alias("subq_id", "subquery"))


def answerability(subqs: DataFrame, passages: DataFrame, scored: bool = True) -> DataFrame:
    """query_id, subq_id, doc_id, rank, a: how well each passage answers each subquery, in 0..1.

    passages: query_id, doc_id, rank, text.  The pair score is the lexical relevance unless a column pair_score is
    supplied by a model; without any scorer only the action features count.
    """
    # at most six subqueries times the bounded hit list of one query
    p = passages.select("query_id", "doc_id", "rank")
    pairs = subqs.select("query_id", "subq_id").join(p, "query_id")
    docs = passages.select("doc_id", "text").dropDuplicates(["doc_id"])
    if scored:
        queries = subqs.select("query_id", "subq_id", F.col("subquery").alias("query"))
        pairs = X.pair_relevance(pairs, queries, docs, ["query_id", "subq_id"], "_ce")
    pairs = pairs.join(docs.select("doc_id", X.action_weight(F.col("text")).alias("_w")), "doc_id")
    if scored:
        a = sigmoid(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_ce"))) + F.col("_w"))
    else:
        a = sigmoid(F.col("_w") * 0.5)
    return pairs.select("query_id", "subq_id", "doc_id", "rank", F.round(a, 6).alias("a"))


def aspect_recall(matrix: DataFrame, tau: float = TAU) -> DataFrame:
    best = matrix.groupBy("query_id", "subq_id").agg(F.max("a").alias("best"))
    return best.groupBy("query_id").agg(F.avg((F.col("best") >= tau).cast("double")).alias("recall"))


def alpha_ndcg(matrix: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """query_id, ndcg: gains shrink with every earlier passage that already touched the aspect."""
    before = Window.partitionBy("query_id", "subq_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    log2 = F.log2(F.col("rank") + 1)
    seen = F.coalesce(F.sum((F.col("a") > 0).cast("int")).over(before), F.lit(0))
    dcg = (
        matrix.withColumn("g", F.pow(F.lit(1 - alpha), seen) * F.col("a") / log2)
        .groupBy("query_id")
        .agg(F.sum("g").alias("dcg"), F.countDistinct("rank").alias("n"), F.countDistinct("subq_id").alias("m"))
    )
    by_best = Window.partitionBy("query_id").orderBy(F.desc("best"), "subq_id")
    ideal = (
        matrix.groupBy("query_id", "subq_id")
        .agg(F.max("a").alias("best"))
        .withColumn("i", F.row_number().over(by_best) - 1)
    )
    # ideal list: aspects by their best value, again and again, one per rank
    steps = (
        ideal.join(dcg.select("query_id", "n", "m"), "query_id")
        .where(F.col("i") < F.col("n"))
        .withColumn("r", F.explode(F.sequence(F.col("i") + 1, F.col("n"), F.col("m"))))
        .withColumn("round", F.floor((F.col("r") - 1) / F.col("m")))
        .groupBy("query_id")
        .agg(F.sum(F.pow(F.lit(1 - alpha), F.col("round")) * F.col("best") / F.log2(F.col("r") + 1)).alias("idcg"))
    )
    idcg = F.coalesce(F.nullif("idcg", F.lit(0.0)), F.lit(1.0))
    return dcg.join(steps, "query_id", "left").select("query_id", (F.col("dcg") / idcg).alias("ndcg"))


def aspect_picks(matrix: DataFrame, tau: float = TAU, top: int = 1) -> DataFrame:
    w = Window.partitionBy("query_id", "subq_id").orderBy(F.desc("a"), "rank")
    return (
        matrix.withColumn("n", F.row_number().over(w))
        .where((F.col("n") <= top) & (F.col("a") >= tau))
        .select("query_id", "subq_id", "doc_id", "rank", "a")
    )


def coverage_gate(matrix: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, recall, ndcg, n_actionable, gate_pass, n_selected."""
    acts = passages.groupBy("query_id").agg(F.count_if(X.is_actionable(F.col("text"))).alias("n_actionable"))
    picked = aspect_picks(matrix).groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_selected"))
    j = (
        aspect_recall(matrix)
        .join(alpha_ndcg(matrix), "query_id")
        .join(acts, "query_id")
        .join(picked, "query_id", "left")
        .withColumn("n_selected", F.coalesce("n_selected", F.lit(0)))
    )
    return j.withColumn(
        "gate_pass",
        ((F.round("recall", 9) >= GATE_RECALL) | (F.round("ndcg", 9) >= GATE_NDCG))
        & (F.col("n_actionable") >= MIN_ACTIONABLE),
    )


# ---------------------------------------------------------------------------------------------- verification
def long_words(c: Column, n: int) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(rf"[\p{{L}}\p{{N}}_]{{{n},}}"), 0))


def verify_answers(answers: DataFrame) -> DataFrame:
    """Five checks per (answer, context, query) row and their share."""
    a = answers.withColumns(
        {
            "_ac": long_words(F.col("answer"), 4),
            "_cc": long_words(F.col("context"), 4),
            "_aq": long_words(F.col("answer"), 3),
            "_qq": long_words(F.col("query"), 3),
            "_s": X.strip(F.col("answer")),
        }
    )
    low = F.lower("answer")
    shared_context, shared_query = F.size(F.array_intersect("_cc", "_ac")), F.size(F.array_intersect("_qq", "_aq"))
    tail = F.substring(F.lower("_s"), -50, 50)
    checks = {
        "has_content": F.length("_s") > 10,
        "not_error": ~X.contains_any(low, R.ERROR_PHRASES),
        "contextual": (F.length("context") >= 50) & (shared_context >= F.greatest(F.lit(3.0), F.size("_cc") * 0.1)),
        "relevant": shared_query >= F.greatest(F.lit(1.0), F.size("_qq") * 0.3),
        "complete": ~((F.length("_s") < 20) | X.contains_any(tail, R.TRUNCATION_MARKS)),
    }
    passed = reduce(lambda x, y: x + y, [F.col(n).cast("int") for n in checks])
    return (
        a.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in checks.items()})
        .withColumn("confidence", passed / 5.0)
        .drop("_ac", "_cc", "_aq", "_qq", "_s")
    )


def count_in(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a fixed word."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word))


def utility_relevance(answer: Column, utility: Column) -> Column:
    """Mentions of the utility, its acronym and its topics per 20 words, plus a bonus for the full name.

    Names compare without case.  A name without topics of its own still counts by name and acronym; 1 if there is none.
    """
    low, name = F.lower(answer), F.lower(F.trim(utility))
    initials = F.array_join(F.transform(F.split(name, r"\s+"), lambda w: F.substring(w, 1, 1)), "")

    def count_of(word: Column) -> Column:
        left = F.length(F.replace(low, word, F.lit("")))
        return F.floor((F.length(low) - left) / F.greatest(F.length(word), F.lit(1)))

    direct = count_of(name)
    topics = [
        (name == known.lower(), reduce(lambda x, y: x + y, [count_in(low, t) for t in terms]))
        for known, terms in R.UTILITY_TOPICS.items()
    ]
    mentions = direct + count_of(initials) + X.first_case(topics, F.lit(0))
    base = F.least(mentions / F.greatest(F.size(X.words(answer)) / 20, F.lit(1.0)), F.lit(1.0))
    score = F.least(base + F.when(direct > 0, 0.3).otherwise(0.0), F.lit(1.0))
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit(1.0)).otherwise(score)


def anchor_terms_in(c: Column) -> Column:
    """Number of procedural terms in a path or section name."""
    return reduce(lambda x, y: x + y, [F.coalesce(F.lower(c).contains(t).cast("int"), F.lit(0)) for t in R.ANCHOR_TERMS])


def anchor_check(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, n_anchors, passed: citations with a procedural #fragment, or such terms in the top three hits.

    answers: query_id, answer.  hits: query_id, rank, path.
    """
    cited = F.filter(
        X.citations(F.col("answer")),
        lambda c: c.contains("#")
        & X.contains_any(F.lower(F.substring(c, F.locate("#", c) + 1, F.length(c))), R.ANCHOR_TERMS),
    )
    in_hits = (
        hits.where(F.col("rank") <= 3).groupBy("query_id").agg(F.sum(anchor_terms_in(F.col("path"))).alias("in_hits"))
    )
    return (
        answers.select("query_id", F.size(cited).alias("in_citations"))
        .join(in_hits, "query_id", "left")
        .select("query_id", (F.col("in_citations") + F.coalesce("in_hits", F.lit(0))).alias("n_anchors"))
        .withColumn("passed", F.col("n_anchors") > 0)
    )


def grounding(answers: DataFrame, hits: DataFrame, top: int = 5, head: int | None = None) -> DataFrame:
    """query_id, grounding: share of the answer's words found among the words (or the first `head`) of the top hits.

    Hits that carry their answer meet its words where their text is, so only the words in common are gathered by query.
    """
    words = F.array_distinct(X.words(F.lower("text")) if head is None else F.slice(X.words(F.lower("text")), 1, head))
    aw = F.array_distinct(X.words(F.lower("answer")))
    words = F.array_intersect(aw, words) if "answer" in hits.columns else words
    per_hit = hits.where(F.col("rank") <= top).select("query_id", words.alias("ws"))
    seen = per_hit.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("ws"))).alias("ws"))
    return (
        answers.select("query_id", aw.alias("aw"))
        .join(seen, "query_id", "left")
        .select(
            "query_id",
            (
                F.size(F.array_intersect("aw", F.coalesce("ws", F.array().cast("array<string>"))))
                / F.greatest(F.size("aw"), F.lit(1))
            ).alias("grounding"),
        )
    )


def verify_citations(answers: DataFrame, hits: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Weighted verification of cited answers.

    answers: query_id, answer, utility (null for none), how_to.  hits: query_id, rank, text, path and,
    to gather less, answer.
    """
    a = answers.withColumn("_c", X.citations(F.col("answer"))).withColumn(
        "_s", X.verification_sentences(F.col("answer"))
    )
    cited = F.size(F.filter("_s", lambda s: F.exists("_c", lambda c: s.contains(c))))
    a = a.withColumns(
        {
            "has_citations": F.size("_c") > 0,
            "coverage": cited / F.greatest(F.size("_s"), F.lit(1)),
            "utility_score": utility_relevance(F.col("answer"), F.col("utility")),
        }
    )
    a = a.join(grounding(answers, hits), "query_id").join(anchor_check(answers, hits), "query_id")
    ok = ~F.col("how_to") | F.col("passed")
    cov, ground, util = F.col("coverage"), F.col("grounding"), F.col("utility_score")
    score = (
        0.25 * F.col("has_citations").cast("int")
        + 0.30 * cov
        + 0.20 * F.when(ok, 1.0).otherwise(0.5)
        + 0.15 * F.least(ground * 2, F.lit(1.0))
        + 0.10 * util
    )
    a = a.withColumn("score", F.round(score, 6)).withColumn("anchor_ok", ok)
    advice = F.array_compact(
        F.array(
            F.when(~F.col("has_citations"), "Add citations to support claims").when(
                cov < threshold,
                F.format_string(
                    "Improve citation coverage: only %s%% of sentences have citations (need ≥%s%%)",
                    X.one_decimal(cov * 100), F.lit(f"{threshold * 100:.1f}"),
                ),
            ),
            F.when(~F.col("anchor_ok"), "Include procedural anchors (setup/onboarding/configuration sections)"),
            F.when(ground < 0.3, "Improve answer grounding to retrieved content"),
            F.when(util < 0.7, "Ensure answer focuses on the specific utility mentioned"),
        )
    )
    return a.select(
        "query_id", "answer", "score", "has_citations", "coverage", "grounding", "utility_score", "anchor_ok",
        ((F.col("score") < 0.65) | (cov < threshold) | ~F.col("anchor_ok")).alias("needs_improvement"),
        advice.alias("suggestions"),
    )
