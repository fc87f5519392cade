"""Score statistics per index and learned content paths."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.functions import rules as R
from quaestor.functions import text as X


def index_stats(hits: DataFrame, api_threshold: float = 0.05, other_threshold: float = 0.15) -> DataFrame:
    """Per query and index: count, mean, median, extremes, how many reach the threshold."""
    threshold = F.when(F.col("idx").contains("api"), api_threshold).otherwise(other_threshold)
    return (
        hits.groupBy("query_id", "idx")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("score").alias("avg_score"),
            F.median("score").alias("median_score"),
            F.min("score").alias("min_score"),
            F.max("score").alias("max_score"),
            F.count_if(F.col("score") >= threshold).alias("n_above"),
        )
        .withColumn("retention_pct", F.col("n_above") / F.col("n") * 100)
    )


def score_balance(hits: DataFrame, warn: float = 3.0) -> DataFrame:
    """Mean main score over mean API score; flagged when one side dominates."""
    api = F.col("idx") == "api"
    return (
        hits.groupBy("query_id")
        .agg(
            F.coalesce(F.avg(F.when(~api, F.col("score"))), F.lit(0.0)).alias("main_avg"),
            F.coalesce(F.avg(F.when(api, F.col("score"))), F.lit(0.0)).alias("api_avg"),
        )
        .withColumn("ratio", F.when(F.col("api_avg") > 0, F.col("main_avg") / F.col("api_avg")).otherwise(0.0))
        .withColumn("imbalanced", (F.col("main_avg") > 0) & (F.col("api_avg") > 0) & (F.col("ratio") > warn))
    )


def content_path(has_inner, has_sections, body_field, n_passages):
    """Which part of a hit its passages came from."""
    return (
        F.when(n_passages == 0, "no_content")
        .when(has_inner, "inner_hits")
        .when(has_sections, "sections.content")
        .otherwise(F.coalesce(body_field, F.lit("unknown")))
    )


def path_counts(observations: DataFrame) -> DataFrame:
    """idx, path, n: the only shuffle over observations; a hot index is summed map-side."""
    return observations.groupBy("idx", "path").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("has_inner_hits").alias("inner"),
        F.max("ts").alias("last_seen"),
    )


def schema_profile(observations: DataFrame) -> DataFrame:
    """idx, samples, inner_hits_seen, paths map, top_path, last_seen."""
    real = F.col("path") != "no_content"
    return (
        path_counts(observations)
        .groupBy("idx")
        .agg(
            F.sum("n").alias("samples"),
            F.sum("inner").alias("inner_hits_seen"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "n")))).alias("paths"),
            F.max("last_seen").alias("last_seen"),
            F.coalesce(
                F.min_by(F.when(real, F.col("path")), F.when(real, F.struct(-F.col("n"), F.col("path")))),
                F.lit("no_content"),
            ).alias("top_path"),
        )
    )


def reliable(profile: DataFrame, min_rate: float = 0.6, min_samples: int = 5) -> DataFrame:
    rate = F.col("inner_hits_seen") / F.col("samples")
    return profile.select(
        "idx", rate.alias("rate"), ((F.col("samples") >= min_samples) & (rate >= min_rate)).alias("reliable")
    )


def preferred_paths(profile: DataFrame, min_samples: int = 5) -> DataFrame:
    """Learned paths by count, then the defaults not seen; the defaults alone for thin profiles."""
    defaults = F.array(*[F.lit(p) for p in R.DEFAULT_PATHS])
    ranked = F.transform(
        F.array_sort(
            F.transform(F.map_entries("paths"), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("path")))
        ),
        lambda e: e["path"],
    )
    learned = F.filter(ranked, lambda p: p != "no_content")
    return profile.select(
        "idx",
        F.when(F.col("samples") < min_samples, defaults)
        .otherwise(F.array_distinct(F.concat(learned, defaults)))
        .alias("preferred"),
    )


def extraction_report(profile: DataFrame) -> DataFrame:
    """Label of the inner-hit rate and whether an API index should be read again with nested sections."""
    rate = F.col("inner_hits_seen") / F.col("samples")
    label = (
        F.when(F.col("samples") < 5, "insufficient")
        .when(rate >= 0.8, "high")
        .when(rate >= 0.6, "medium")
        .otherwise("low")
    )
    return profile.select(
        "idx",
        "samples",
        rate.alias("rate"),
        label.alias("reliability"),
        (F.col("idx").endswith("api") & (F.col("samples") >= 5) & (rate < 0.6)).alias("retry_nested"),
    )


def text_retry(hits: DataFrame) -> DataFrame:
    """Retry when under half of a query's hits have passages, or none of its first three has."""
    filled = F.col("n_passages") > 0
    return (
        hits.groupBy("query_id")
        .agg(
            F.avg(filled.cast("double")).alias("rate"),
            F.max(F.when(F.col("rank") <= 3, filled.cast("int")).otherwise(0)).alias("top"),
        )
        .withColumn("retry", (F.col("rate") < 0.5) | (F.col("top") == 0))
    )


def list_values(docs: DataFrame, field: str, limit: int | None = None) -> DataFrame:
    """Distinct values in key order with their counts; a report may ask for the first few only."""
    values = docs.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ordered = values.orderBy("value")
    return ordered if limit is None else ordered.limit(limit)


def generic_penalties(hits: DataFrame) -> DataFrame:
    section, title = F.lower(F.coalesce("section", F.lit(""))), F.lower(F.coalesce("title", F.lit("")))
    generic = X.contains_any(section, R.GENERIC_SECTIONS) | X.contains_any(title, R.GENERIC_TITLES)
    return hits.groupBy("query_id").agg(F.count_if(generic).alias("penalties"))
