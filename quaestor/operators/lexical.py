"""Lexical retrieval: BM25 over documents or sections.

Shape of the plan: the query table is small next to the corpus, so its terms are broadcast once their size is checked.
A published index is read by its terms: the broadcast prunes the folders of other terms, stored frequencies and lengths
stand in for counts, and only postings of query terms are shuffled, once, by document.  Filters narrow candidates by a
semi-join on that same key.  A table without an index is exploded to tokens and cut down to query terms map-side, in the
same single shuffle.  Per-section scores and per-document scores are then local to a partition, and the window that keeps
the best k per query prunes inside each partition before it shuffles k rows per query.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions import rules as R
from quaestor.functions import text as X
from quaestor.session import settle, text_bytes
from quaestor.sources.index import Index, bucket, unpack

BROADCAST_BYTES = 16 << 20  # query text that may be broadcast; terms take no more rows than the text has bytes


def query_terms(queries: DataFrame, expand: bool = True) -> DataFrame:
    """query_id, term, weight.  A recognised utility name adds boosted clauses for its acronym."""
    q = F.lower(F.col("query"))
    clauses = [F.struct(F.col("query").alias("text"), F.lit(1.0).alias("boost"))]
    if expand:
        for name, acronym in R.CLAUSE_UTILITIES:
            for suffix, boost in R.CLAUSE_BOOSTS:
                clause = F.struct(F.lit(acronym + suffix).alias("text"), F.lit(boost).alias("boost"))
                clauses.append(F.when(q.contains(name.lower()), clause))
    return (
        queries.select("query_id", F.explode(F.array_compact(F.array(*clauses))).alias("c"))
        .select("query_id", F.explode(X.index_tokens(F.col("c.text"))).alias("term"), F.col("c.boost").alias("boost"))
        .groupBy("query_id", "term")
        .agg(F.sum("boost").alias("weight"))
    )


def corpus_stats(units: DataFrame, text: str = "unit_text") -> DataFrame:
    """One row: n_units with at least one term, avg_len."""
    n = F.size(X.index_tokens(F.col(text)))
    return (
        units.select(n.alias("unit_len"))
        .where("unit_len > 0")
        .agg(F.count(F.lit(1)).alias("n_units"), F.avg("unit_len").alias("avg_len"))
    )


def postings(units: DataFrame, text: str = "unit_text") -> DataFrame:
    """doc_id, unit_no, unit_len, term, tf of every term: the table to store when many query sets are run."""
    t = units.select("doc_id", "unit_no", X.index_tokens(F.col(text)).alias("toks"))
    return (
        t.select("doc_id", "unit_no", F.size("toks").alias("unit_len"), F.explode("toks").alias("term"))
        .groupBy("doc_id", "unit_no", "unit_len", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def bm25_units(units: DataFrame, queries: DataFrame, text: str = "unit_text", expand: bool = True) -> DataFrame:
    """query_id, doc_id, unit_no, score of every section that shares a term with a query.

    Where units carry a column keep, only kept ones are scored; collection statistics still cover all of them, as
    filters narrow the candidates of a search and not its index.
    """
    keep = [c for c in units.columns if c == "keep"]
    terms = query_terms(queries, expand)
    _, size = text_bytes(queries, "query")
    small = size <= BROADCAST_BYTES

    def send(df: DataFrame) -> DataFrame:
        # Beyond the bound the join is left to the planner: a shuffle join whose skewed terms AQE splits.
        return F.broadcast(df) if small else df

    # One pass over the corpus serves scores, document frequencies and collection statistics: besides its query terms
    # every section sends one marker row, the empty term, that carries its length.  The three uses share one shuffle.
    vocabulary = terms.select("term").distinct().union(terms.sparkSession.range(1).select(F.lit("").alias("term")))
    tokens = units.select("doc_id", "unit_no", *keep, X.index_tokens(F.col(text)).alias("toks")).select(
        "doc_id",
        "unit_no",
        *keep,
        F.size("toks").alias("unit_len"),
        F.explode(F.when(F.size("toks") > 0, F.array_append("toks", F.lit("")))).alias("term"),
    )
    found = (
        tokens.join(send(vocabulary), "term", "left_semi")
        .repartition("doc_id")
        .groupBy("doc_id", "unit_no", *keep, "unit_len", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    marker = F.col("term") == ""
    stats = found.agg(
        F.count_if(marker).alias("n_units"), F.avg(F.when(marker, F.col("unit_len"))).alias("avg_len")
    )  # one row
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = _weights(terms.join(send(df), "term").crossJoin(F.broadcast(stats)))
    return _scores((found.where("keep") if keep else found).join(send(weights), "term"), [])


def _weights(terms: DataFrame) -> DataFrame:
    """What a query term adds at most: its boost by its rarity."""
    rarity = F.log(1 + (F.col("n_units") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return terms.withColumn("w", F.col("weight") * rarity * (R.BM25_K1 + 1)).drop("weight", "n_units", "df")


def _scores(matched: DataFrame, scope: list[str]) -> DataFrame:
    tf = F.col("tf").cast("double")
    norm = R.BM25_K1 * (1 - R.BM25_B + R.BM25_B * F.col("unit_len") / F.col("avg_len"))
    return matched.groupBy("query_id", *scope, "doc_id", "unit_no").agg(F.sum(F.col("w") * tf / (tf + norm)).alias("score"))


def index_units(
    index: Index,
    queries: DataFrame,
    expand: bool = True,
    field: str = "section",
    kept: DataFrame | None = None,
    k: int | None = None,
    boost: float = 1.0,
) -> DataFrame:
    """As bm25_units, from a published index; kept holds the doc_ids that a filter leaves as candidates.

    Queries with a column idx are answered from that index alone, by its own statistics; others from all.  With k, the
    units of all documents that may be among the best k of a query come, and few others: tasks score their documents and keep
    a running best k, so pairs of query and unit are made for the best documents only.  Scores are multiplied by boost.
    """
    scope = [c for c in queries.columns if c == "idx"]
    terms = query_terms(queries.select("query_id", "query").distinct() if scope else queries, expand)
    if scope:
        terms = terms.join(queries.select("query_id", *scope), "query_id")
    _, size = text_bytes(queries, "query")
    small = size <= BROADCAST_BYTES

    def send(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    n = index.buckets
    terms = settle(terms.withColumn("bucket", bucket(F.col("term"), n)))
    vocabulary = terms.select("bucket", "term", *scope).distinct()
    needed = F.col("bucket").isin([r[0] for r in terms.select("bucket").distinct().collect()])  # numbers of folders
    lengths = index.lengths(field).groupBy(*scope).agg(F.sum("n_units").alias("n_units"), F.sum("n_terms").alias("n_terms"))
    lengths = lengths.select(*scope, "n_units", (F.col("n_terms") / F.col("n_units")).alias("avg_len"))
    df = index.terms(field).where(needed).join(send(vocabulary), ["bucket", "term", *scope], "left_semi")
    df = df.groupBy("term", *scope).agg(F.sum("df").alias("df"))
    joined = terms.drop("bucket").join(send(df), ["term", *scope])
    weights = _weights(joined.join(F.broadcast(lengths), scope) if scope else joined.crossJoin(F.broadcast(lengths)))
    weights = weights.withColumn("w", F.col("w") * boost) if boost != 1.0 else weights
    found = unpack(index.packed(field).where(needed).join(send(vocabulary), ["bucket", "term", *scope], "left_semi"))
    found = found.select("doc_id", "unit_no", *scope, "unit_len", "term", "tf")
    if kept is not None:
        found = found.join(kept.select("doc_id"), "doc_id", "left_semi")
    if k is None or not small:
        return _scores(found.repartition("doc_id").join(send(weights), ["term", *scope]), scope)
    from quaestor.operators import sweep  # which needs this module

    weights = settle(weights)
    best = settle(sweep.candidates(found, weights, scope, k + 5))  # sums of another order may swap neighbours
    doc = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc")  # null is a document like others
    few = found.withColumn("doc", doc).join(best.select("doc").distinct(), "doc", "left_semi").repartition("doc_id")
    pairs = few.join(send(weights), ["term", *scope]).join(best, ["query_id", *scope, "doc"], "left_semi")
    return _scores(pairs, scope)


def top_k(scored: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """Best k per key (and idx, where scores carry one).  Scores are kept to six places, so ties do not depend on the
    order of summation."""
    w = Window.partitionBy(by, *(c for c in scored.columns if c == "idx")).orderBy(F.desc("score"), F.asc("doc_id"))
    return (
        scored.withColumn("score", F.round("score", 6))
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
    )


def bm25(
    units: DataFrame, queries: DataFrame, k: int = 50, score_mode: str = "max", text: str = "unit_text", expand=True
) -> DataFrame:
    """query_id, doc_id, score, rank.  score_mode says how sections make up their document: max, avg or sum."""
    return top_k(per_document(bm25_units(units, queries, text, expand), score_mode), k)


def per_document(per_unit: DataFrame, score_mode: str = "max") -> DataFrame:
    fold = {"max": F.max, "avg": F.avg, "sum": F.sum}[score_mode]
    keys = [c for c in ("query_id", "idx", "doc_id") if c in per_unit.columns]
    return per_unit.groupBy(*keys).agg(fold("score").alias("score"))


def inner_hits(per_unit: DataFrame, hits: DataFrame, n: int = 5) -> DataFrame:
    """The best n sections of each hit: query_id, doc_id, unit_no, score, unit_rank."""
    w = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), F.asc("unit_no"))
    return (
        per_unit.withColumn("score", F.round("score", 6))
        .join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
        .withColumn("unit_rank", F.row_number().over(w))
        .where(F.col("unit_rank") <= n)
    )


def multi_match(index: Index, queries: DataFrame, k: int = 50) -> DataFrame:
    """Flat fields: the better of 2 x content and 6 x title decides."""
    parts = []
    for field, boost in (("text", R.CONTENT_BOOST), ("title", R.TITLE_BOOST)):
        scored = index_units(index, queries, expand=False, field=field, k=k, boost=boost)
        parts.append(scored.select("query_id", "doc_id", "score"))
    return top_k(per_document(reduce(DataFrame.unionByName, parts)), k)


def by_group(scored: DataFrame, groups: DataFrame, k: int, group: str) -> DataFrame:
    """Best k per (query, group of the document), e.g. per content type."""
    w = Window.partitionBy("query_id", group).orderBy(F.desc("score"), F.asc("doc_id"))
    return (
        scored.withColumn("score", F.round("score", 6))
        .join(groups.select("doc_id", group), "doc_id")
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
    )
