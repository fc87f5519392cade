"""The data model: documents, sections, queries, vectors and telemetry as DataFrames.

The tables of a deployment are read as they are; what a table lacks (access group, space, utility, update date, page
address, procedural lines) is derived from its own columns with fixed rules, so every row takes part.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions import text as X
from quaestor.session import spread

# Lines appended to a document, by doc_id modulo their number.  They make the procedural rules fire.
SNIPPETS = [
    "1. Create a Jira ticket in project key ABC\n2. Submit the intake form",
    "POST /api/v1/items to create an item with the rest api",
    "Contact the Billing team via email",
    "Overview of fields\n| name | value |\n|---|---|\n| a | b |\nend of table",
    "Step 1: open a ServiceNow request REQ1234567 in the catalog item",
    "owner: Payments platform\nemail: owner@example.com",
    "See https://docs.example.com/api/docs and the OpenAPI spec of the transaction utility",
    "How to onboard: first join the Teams channel general, then request access to ABC",
    "error: failed to resolve issue ABC-123, not working",
    "Before you start, schedule a Teams meeting once done\nSend an email to support team",
    "",
    "- first item of the list of options\n- next item then finish",
]
# Content types by doc_id modulo their number.
CONTENT_TYPES = ["confluence", "api_spec", "runbook", "guide", "swagger"]
# Utility names by doc_id modulo their number; the last is "none".
UTILITIES = [
    "Customer Interaction Utility",
    "Enhanced Transaction Utility",
    "Account Utility",
    "Customer Summary Utility",
    "Digital Events",
    None,
]
# Query templates by (7 * conv_id + turn) modulo their number; {} is the whole user turn.
QUERY_TEMPLATES = [
    "{}",
    "what is CIU",
    "define {}",
    "how do I setup CIU for {}",
    "list all available APIs",
    "CIU vs ETU",
    "difference between account utility and customer summary",
    "compare CSU with PCU",
    "GET /api/v1/users endpoint {}",
    "rest api documentation for {}",
    "steps to onboard to Customer Interaction Utility",
    "API",
    "show me products",
    "what APGs exist",
    "which fields does {} take",
    "fix error in transaction utility: {}",
    "AU",
    "enable Payment API for {}",
    "docs help for config of digev",
    "Given context: {}... Current question: what is ETU?",
    "what does GCP meaning stand for",
    "tutorial on-board {}",
    "  customer summary   setup  ",
    "apg de {}",
    "how many utilities {}",
    "issue with account management {}",
    "card utility guide for {}",
    "what api available {}",
    "ciu customer interaction data {}",
]
# Prefixes of the search queries by item_id modulo their number.
SEARCH_PREFIXES = ["Account Utility ", "how to setup Customer Interaction Utility ", "what is ", ""]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(values, key: Column) -> Column:
    """values[key mod n]"""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, idx, title, text, acl_hash, space_key, content_type, utility_name, updated_at, page_url."""
    d = spread(table(spark, folder, "documents"))
    i = F.col("doc_id")
    text = F.concat(F.col("text"), F.lit("\n"), pick(SNIPPETS, i))
    return d.select(
        i,
        F.when(i % 3 == 0, "api").otherwise("main").alias("idx"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"),
        text.alias("text"),
        F.concat(F.lit("grp_"), (i % 5).cast("string")).alias("acl_hash"),
        F.col("lang").alias("space_key"),
        pick(CONTENT_TYPES, i).alias("content_type"),
        pick(UTILITIES, i).alias("utility_name"),
        F.date_add(F.lit("2024-01-01").cast("date"), (i % 365).cast("int")).alias("updated_at"),
        F.concat(F.lit("https://docs.example.com/"), F.col("source"), F.lit("/"), i.cast("string")).alias("page_url"),
    )


def sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per non-blank line: doc_id, unit_no, unit_text (positions count blank lines too).

    A column keep, which marks the documents a search may return, is carried along.
    """
    keep = [c for c in docs.columns if c == "keep"]
    return docs.select(
        "doc_id", *keep, F.posexplode(F.split(F.col(text), "\n")).alias("unit_no", "unit_text")
    ).where(X.strip(F.col("unit_text")) != "")


def query_log(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, query: every user turn, whole, inside a query template."""
    c = table(spark, folder, "conversations").where(F.col("role") == "user")
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"),
        F.replace(pick(QUERY_TEMPLATES, F.col("conv_id") * 7 + F.col("turn")), F.lit("{}"), F.col("text")).alias(
            "query"
        ),
    )


def search_queries(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, query: every benchmark item, whole."""
    b = table(spark, folder, "benchmark")
    return b.select(
        F.col("item_id").alias("query_id"),
        F.concat(pick(SEARCH_PREFIXES, F.col("item_id")), F.col("text")).alias("query"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def query_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, embedding: the vector that carries the item's number."""
    q = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"))
    return q.join(vectors(spark, folder).withColumnRenamed("doc_id", "query_id"), "query_id")


def telemetry(spark: SparkSession, folder: str) -> DataFrame:
    """event_id, ts, user_id, req_id (user and day), stage, event, ms, props."""
    return telemetry_columns(table(spark, folder, "events"))


def telemetry_columns(e: DataFrame) -> DataFrame:
    """Event rows -> telemetry rows; works on batch and streaming input."""
    ts = F.col("ts").cast("timestamp")
    return e.select(
        "event_id",
        ts.alias("ts"),
        "user_id",
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format(ts, "yyyyMMdd")).alias("req_id"),
        X.normalize_stage(F.col("event_type")).alias("stage"),
        F.when(F.col("event_type") == "error", "error")
        .when(F.col("event_id") % 2 == 0, "start")
        .otherwise("success")
        .alias("event"),
        (F.col("value") * 10).alias("ms"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
