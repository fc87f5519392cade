"""Assembling evidence: sections, briefings, cards, source lists."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions import rules as R
from quaestor.functions import text as X


def classify_sections(hits: DataFrame) -> DataFrame:
    """One row per hit and section it supports.  hits: query_id, doc_id, title, text, score."""
    both = F.concat(F.lower(F.coalesce("title", F.lit(""))), F.lit(" "), F.lower("text"))
    h = hits.where(F.coalesce("text", F.lit("")) != "").withColumn("_both", both)
    found = F.array_compact(
        F.array(*[F.when(X.contains_any(F.col("_both"), ws), F.lit(s)) for s, ws in R.SECTION_WORDS.items()])
    )
    labels = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("info")))
    return h.withColumn("section", F.explode(labels)).drop("_both")


def evidence_sections(classified: DataFrame, min_n: int = 1, min_avg: float = 0.005, top: int = 4) -> DataFrame:
    """query_id, section, n, avg_score, strength, strategy of the sections that pass the gate."""
    w = Window.partitionBy("query_id").orderBy(F.desc("strength"), F.desc("section"))
    kept = (
        classified.groupBy("query_id", "section")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("avg_score"))
        .where((F.col("n") >= min_n) & (F.col("avg_score") >= min_avg))
        .withColumn("strength", F.round(F.col("n") * F.col("avg_score"), 6))
        .withColumn("section_rank", F.row_number().over(w))
        .where(F.col("section_rank") <= top)
    )
    names = F.collect_set("section").over(Window.partitionBy("query_id"))  # at most five names
    strategy = (
        F.when(F.size(names) == 1, "single_section")
        .when(F.array_contains(names, "api") & F.array_contains(names, "procedure"), "api_procedure")
        .when(F.array_contains(names, "troubleshoot"), "troubleshooting_focused")
        .otherwise("multi_section")
    )
    return kept.withColumn("strategy", strategy)


def section_texts(classified: DataFrame, kept: DataFrame, top: int = 3, limit: int = 500) -> DataFrame:
    """query_id, section, body: the best passages of each section, joined in order."""
    w = Window.partitionBy("query_id", "section").orderBy(F.desc("score"), F.asc("doc_id"))
    best = (
        classified.join(kept, ["query_id", "section"], "left_semi")
        .withColumn("n", F.row_number().over(w))
        .where(F.col("n") <= top)
    )
    block = F.concat(F.lit("**"), F.col("title"), F.lit(":**\n"), X.clip(X.strip(F.col("text")), limit))
    return best.groupBy("query_id", "section").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))), lambda s: s["b"]), "\n\n"
        ).alias("body")
    )


def briefing(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, markdown; queries without evidence get the standard sentence."""
    classified = classify_sections(hits)
    kept = evidence_sections(classified)
    texts = section_texts(classified, kept)
    order = F.array_position(F.array(*[F.lit(s) for s in R.SECTION_ORDER]), F.col("section"))
    title = F.element_at(X.literal_map(R.SECTION_TITLES), F.col("section"))
    part = F.struct(order.alias("o"), F.concat(F.lit("## "), title, F.lit("\n\n"), F.col("body"), F.lit("\n")).alias("t"))
    merged = texts.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda s: s["t"]), "\n").alias("markdown")
    )
    return (
        queries.select("query_id")
        .join(merged, "query_id", "left")
        .select(
            "query_id",
            F.coalesce("markdown", F.lit("No sufficient evidence found to compose a structured briefing.")).alias("markdown"),
        )
    )


def compose_card(sections: DataFrame, queries: DataFrame, budgets: dict = R.PLAN_BUDGETS) -> DataFrame:
    """One card per query.  sections: query_id, aspect, position, doc_id, title, url, text (few rows per aspect)."""
    a = F.col("aspect")

    def ordered(cond, value, limit=None):
        rows = F.array_sort(F.collect_list(F.when(cond, F.struct("position", value.alias("v")))))
        values = F.transform(rows, lambda r: r["v"])
        return F.slice(values, 1, limit) if limit else values

    step_text = X.trim_text(F.col("text"), min(180, budgets["steps"] // 5))
    card = sections.groupBy("query_id").agg(
        F.get(ordered(a == "overview", X.trim_text(F.col("text"), budgets["overview"])), F.lit(0)).alias("overview"),
        F.filter(ordered(a == "steps", step_text), lambda t: t != "").alias("_steps"),
        ordered(
            a == "api", F.struct(F.coalesce(F.nullif("title", F.lit("")), F.lit("API")).alias("name"), F.col("url")), 5
        ).alias("apis"),
        ordered(a == "troubleshoot", F.col("url"), 2).alias("links"),
    )
    q = queries.select("query_id", X.first_utility_token(F.col("query")).alias("utility"))
    j = q.join(card, "query_id", "left")
    steps = F.transform(F.coalesce("_steps", F.array()), lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t))
    unknown = F.array_compact(
        F.array(
            F.when(F.col("overview").isNull(), "overview"),
            F.when(F.size(F.coalesce("_steps", F.array())) == 0, "onboarding_steps"),
            F.when(F.coalesce(F.size("apis"), F.lit(0)) <= 0, "apis"),
        )
    )
    return j.select(
        "query_id", "utility", "overview", steps.alias("onboarding_steps"), "apis", "links", unknown.alias("unknown_fields")
    )


def list_answer(values: DataFrame) -> DataFrame:
    """list_type, answer.  values: list_type, value; a list is a report of at most 1,000 values."""
    kind = F.col("list_type")
    items = F.array_sort(F.collect_list("value"))
    prefixes = X.literal_map(R.LIST_PREFIXES)
    lines = F.transform(
        F.col("items"),
        lambda v, i: F.concat(
            F.when(kind == "apis", F.concat((i + 1).cast("string"), F.lit(". "))).otherwise(
                F.coalesce(F.element_at(prefixes, kind), F.lit("- "))
            ),
            v,
            F.lit("\n"),
        ),
    )
    heading = F.coalesce(
        F.element_at(X.literal_map(R.LIST_HEADINGS), kind), F.concat(F.lit("Available "), kind, F.lit(":\n\n"))
    )
    follow_up = F.coalesce(F.element_at(X.literal_map(R.LIST_FOLLOW_UPS), kind), F.lit(""))
    return values.groupBy("list_type").agg(items.alias("items")).select(
        "list_type", F.concat(heading, F.array_join(lines, ""), follow_up).alias("answer")
    )


def no_results(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Suggestions for queries without hits."""
    q = F.col("query")
    return queries.join(hits, "query_id", "left_anti").select(
        "query_id",
        F.concat(
            F.lit('No relevant documentation found. Try these searches: "'), q, F.lit(' setup documentation" | "'),
            q, F.lit(' API reference" | "'), q, F.lit(' integration guide"'),
        ).alias("answer"),
    )


def results_context(hits: DataFrame, top: int = 6, limit: int = 400) -> DataFrame:
    """query_id, context: [doc]: text of the best hits."""
    block = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("]: "), X.clip(F.col("text"), limit))
    return (
        hits.where(F.col("rank") <= top)
        .groupBy("query_id")
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda s: s["b"]), "\n\n"
            ).alias("context")
        )
    )


def sources(hits: DataFrame, top: int = 10) -> DataFrame:
    """The source list under an answer.  hits: query_id, doc_id, rank, title, page_url, text."""
    name = F.concat(F.lit("Document "), F.col("rank").cast("string"))
    address = F.concat(F.lit("#doc-"), F.col("doc_id").cast("string"))
    return hits.where(F.col("rank") <= top).select(
        "query_id",
        "rank",
        "doc_id",
        F.coalesce(F.nullif("title", F.lit("")), name).alias("title"),
        F.coalesce(F.nullif("page_url", F.lit("")), address).alias("url"),
        F.coalesce(F.nullif(X.clip(F.col("text"), 200), F.lit("")), F.lit("No content available")).alias("excerpt"),
    )


def append_sources(answer: Column, has_citations: Column, top_sources: Column) -> Column:
    """Add the first three sources to an answer that cites nothing."""
    return F.when(
        ~has_citations & (F.size(top_sources) > 0),
        F.concat(
            answer,
            F.lit("\n\n**Sources:**\n"),
            F.array_join(
                F.transform(
                    F.slice(top_sources, 1, 3),
                    lambda s: F.concat(F.lit("- ["), s["doc_id"].cast("string"), F.lit("] "), s["title"], F.lit("\n")),
                ),
                "",
            ),
        ),
    ).otherwise(answer)
