"""Document and hit filters.  Filters go before ranking so that they reach the scan and never drop ranked rows."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions import rules as R
from quaestor.functions import text as X


@dataclass(frozen=True)
class Filters:
    acl_hash: str | None = None
    space_key: str | None = None
    content_type: str | None = None
    utility_name: str | None = None
    updated_after: str | None = None
    updated_before: str | None = None

    def predicate(self) -> Column:
        """Conjunction of all given filters; dates are compared by day and both ends belong to the range."""
        parts = [F.lit(True)]
        for name in ("acl_hash", "space_key", "content_type", "utility_name"):
            value = getattr(self, name)
            if value is not None:
                parts.append(F.col(name) == value)
        if self.updated_after is not None:
            parts.append(F.to_date("updated_at") >= F.lit(self.updated_after).cast("date"))
        if self.updated_before is not None:
            parts.append(F.to_date("updated_at") <= F.lit(self.updated_before).cast("date"))
        return reduce(lambda a, b: a & b, parts)


def apply_filters(docs: DataFrame, filters: Filters) -> DataFrame:
    return docs.where(filters.predicate())


def any_section(docs: DataFrame, word: str) -> DataFrame:
    """Documents one of whose sections holds the word (nested-array filter)."""
    return docs.where(F.exists(F.split("text", "\n"), lambda s: F.lower(s).contains(word)))


def intent_filter(intent: Column) -> Column:
    """Default content type of an intent; null for none."""
    return F.element_at(X.literal_map(R.INTENT_CONTENT_TYPE), intent)


def merge_filters(*maps: Column) -> Column:
    """Later maps win.  Null maps count as empty."""
    empty = F.create_map().cast("map<string,string>")
    merged = reduce(
        lambda a, b: F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b),
        [F.coalesce(m, empty) for m in maps],
    )
    return F.map_filter(merged, lambda k, v: v.isNotNull() & (v != ""))


def soft_matches(view: str) -> Column:
    """How many of a view's soft conditions a document meets."""
    _, conditions = R.SOFT_FILTERS[view]
    ts = {"title": F.col("_title_tokens"), "text": F.col("_text_tokens")}

    def met(field, value):
        if field == "content_type":
            return F.col("content_type") == value
        return F.arrays_overlap(ts[field], F.array(*[F.lit(w) for w in value.split()]))

    return reduce(lambda a, b: a + b, [F.coalesce(met(f, v).cast("int"), F.lit(0)) for f, v in conditions])


def soft_filter(docs: DataFrame, view: str) -> DataFrame:
    """Add the soft score; drop documents only where the view requires a match."""
    minimum, _ = R.SOFT_FILTERS[view]
    scored = (
        docs.withColumn("_title_tokens", X.tokens(F.col("title")))
        .withColumn("_text_tokens", X.tokens(F.col("text")))
        .withColumn("soft_score", soft_matches(view))
        .drop("_title_tokens", "_text_tokens")
    )
    return scored.where(F.col("soft_score") >= minimum)


def parse_iso(c: Column) -> Column:
    """ISO date-time, 'Z' accepted, null when malformed."""
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"
    return F.when(c.rlike(shape), F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00")))


def passage_length(passages: DataFrame, low: int = 80, high: int = 1200) -> DataFrame:
    clean = passages.withColumn("text", X.collapse(F.col("text")))
    return clean.where(F.length("text").between(low, high))


def drop_metadata_only(hits: DataFrame, suffix: str = "api") -> DataFrame:
    """API hits without passages and without any content field."""
    bare = F.col("idx").endswith(suffix) & (F.coalesce(F.col("n_passages"), F.lit(0)) == 0)
    empty = F.coalesce(F.trim("body"), F.lit("")) == ""
    return hits.where(~(bare & empty))


def no_answer_gate(queries: DataFrame, hits: DataFrame, minimum: float = 0.1) -> DataFrame:
    """query_id, reason: why a query gets no answer; null reason when it does."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("top"))
    return (
        queries.select("query_id")
        .join(best, "query_id", "left")
        .select(
            "query_id",
            F.when(F.col("top").isNull(), "no_documents_found")
            .when(F.col("top") < minimum, F.format_string("low_score_%.3f", F.col("top")))
            .alias("reason"),
        )
    )


def validate_documents(docs: DataFrame) -> DataFrame:
    """Add errors: what is wrong with each document (empty array when nothing is)."""

    def bad(cond, message):
        return F.when(F.coalesce(cond, F.lit(True)), message)

    checks = [
        bad(X.strip(F.col("doc_id").cast("string")) == "", "missing id"),
        bad(X.strip(F.col("title")) == "", "missing title"),
        bad(X.strip(F.col("text")) == "", "missing body"),
        bad(F.col("metadata").isNull(), "metadata is not a map"),
        bad(parse_iso(F.col("updated_at")).isNull(), "bad date"),
    ]
    return docs.withColumn("errors", F.array_compact(F.array(*checks)))


def quality_filter(hits: DataFrame, thresholds: DataFrame, default: float = 0.10) -> DataFrame:
    """Keep hits at or above the threshold of their query and index."""
    return hits.join(thresholds, ["query_id", "idx"], "left").where(
        F.col("score") >= F.coalesce("threshold", F.lit(default))
    )


def pin_first(states: DataFrame) -> DataFrame:
    """First filter state of each request wins: req_id, ts, state -> req_id, state."""
    return states.groupBy("req_id").agg(F.min_by("state", F.struct("ts", "event_id")).alias("state"))


def answered(queries: DataFrame, hits: DataFrame, yes: bool = True) -> DataFrame:
    return queries.join(hits, "query_id", "left_semi" if yes else "left_anti")


def first_ranked(hits: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
