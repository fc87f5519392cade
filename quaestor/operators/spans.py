"""Actionable spans: suite confidence, extraction, de-overlapping, scores and the choice of presenter."""

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions import rules as R
from quaestor.functions import text as X
from quaestor.operators.literals import Screen

SPAN_SCHEMA = (
    "doc_id long, rule_no int, suite string, capability string, type string, weight double, text string, url string, "
    "offset int, attrs map<string,string>"
)
SUITES = list(R.SUITES)


def rule_rows(suites: dict | None = None) -> list[tuple]:
    """(rule_no, suite, name, capability, weight, pattern) of every pattern, suites first, global ones last."""
    rows = []
    for suite, manifest in (suites or R.SUITES).items():
        for name, capability, weight, patterns, _, _ in manifest["extractors"]:
            rows += [(len(rows) + i, suite, name, capability, weight, p) for i, p in enumerate(patterns)]
    rows += [(len(rows) + i, "global", c, c, R.GLOBAL_CONFIDENCE, p) for i, (c, p) in enumerate(R.GLOBAL_PATTERNS)]
    return rows


def suite_registry(rules: DataFrame) -> DataFrame:
    """suite, keywords (patterns without regex syntax), url_patterns, hints: one row per suite of a rule table."""
    plain = F.filter(F.flatten("extractors.patterns"), lambda p: ~p.rlike(r"[\[\](){}*+?|^$\\]"))
    return rules.select(
        "suite", F.transform(plain, F.lower).alias("keywords"), F.flatten("extractors.url_patterns").alias("url_patterns"), "hints"
    )


def hint_hits(text: Column, hints: list[str]) -> Column:
    """How many of a suite's hints a text meets."""
    return sum((F.coalesce(X.has(text, h).cast("int"), F.lit(0)) for h in hints), F.lit(0))


def suite_confidence(passages: DataFrame, head: int | None = None, suites: dict | None = None) -> DataFrame:
    """query_id, suite, confidence: twice the share of (hint, passage) pairs that match, at most 1.

    The hint counts of all suites are measured in one pass and summed per query before they become rows.  Texts count
    whole unless `head` says how many characters do.  A suite without hints counts as half sure.
    """
    suites = suites or R.SUITES
    text = F.col("text") if head is None else F.substring("text", 1, head)
    probe = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("page_url", F.lit("")), text)
    p = passages.withColumn("_probe", probe)
    sums = p.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(hint_hits(F.col("_probe"), m["hints"])).alias(s) for s, m in suites.items()]
    )
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(s).alias("suite"), F.col(s).alias("hits"), F.lit(len(m["hints"])).alias("hints"))
                for s, m in suites.items()
            ]
        )
    )
    share = 2.0 * F.col("s.hits") / (F.nullif(F.col("s.hints"), F.lit(0)) * F.col("n"))
    sure = F.when(F.col("s.hints") == 0, 0.5).otherwise(F.least(F.lit(1.0), share))
    return sums.select("query_id", "n", pairs.alias("s")).select("query_id", "s.suite", sure.alias("confidence"))


_OPEN_RUN = r"(?i)([\w\s-]+)"
_RUN = re.compile(r"[\w\s-]+")


def _matches(rx, text: str):
    """All matches, left to right.

    A pattern that opens with a run of words would be tried at every character of every run.  If it matches anywhere
    in a run it matches from the run's start, so one attempt per run finds the same spans in linear time.
    """
    if not rx.pattern.startswith(_OPEN_RUN):
        yield from rx.finditer(text)
        return
    pos = 0
    while run := _RUN.search(text, pos):
        m = rx.match(text, run.start())
        if m:
            yield m
        pos = m.end() if m else run.end()


def _extractor(suites: dict | None = None):
    suites = suites or R.SUITES
    urls, attrs, rules = {}, {}, []
    for suite, manifest in suites.items():
        for name, _, _, _, attr_rules, url_rules in manifest["extractors"]:
            attrs[suite, name] = [(k, re.compile(v)) for k, v in attr_rules.items()]
            urls[suite, name] = [re.compile(u) for u in url_rules]
    rows = rule_rows(suites)
    for no, suite, name, capability, weight, p in rows:
        kind = R.CAPABILITY_TYPES.get(capability, "endpoint") if suite != "global" else capability
        rules.append((suite, name, no, capability, kind, weight, re.compile(p)))
    screen: list[Screen] = []  # made inside the task: an automaton does not travel
    any_url = re.compile(r"https?://[^\s]+")

    def best_url(suite, name, match, page_url):
        for u in urls.get((suite, name), []):
            m = u.search(match)
            if m:
                return m.group(1)
        m = any_url.search(match) if suite != "global" else None
        return m.group(0) if m else page_url

    def attributes(suite, name, match):
        found = {}
        for key, rx in attrs.get((suite, name), []):
            m = rx.search(match)
            if m and m.group(1) is not None:
                found[key] = m.group(1).strip()
        return found

    def scan(doc, title, body, url):
        text = f"{title or ''}\n{body or ''}"
        for i in screen[0].candidates(text):
            suite, name, no, capability, kind, weight, rx = rules[i]
            for m in _matches(rx, text):
                s = m.group(0)
                where = best_url(suite, name, s, url)
                yield doc, no, suite, capability, kind, weight, s.strip(), where, m.start(), attributes(suite, name, s)

    columns = ["doc_id", "rule_no", "suite", "capability", "type", "weight", "text", "url", "offset", "attrs"]

    def run(batches):
        if not screen:
            screen.append(Screen([r[5] for r in rows]))
        for pdf in batches:
            docs = zip(pdf["doc_id"], pdf["title"], pdf["text"], pdf["page_url"])
            yield pd.DataFrame([row for d in docs for row in scan(*d)], columns=columns)

    return run


def extract_spans(docs: DataFrame, suites: dict | None = None) -> DataFrame:
    """Every match of every rule, once per document.  docs: doc_id, title, text, page_url.

    Offsets of matches are what Spark's regex functions do not give, hence the Arrow batches.  A document is scanned
    once however many queries it answers: one pass for the literals that the patterns need, then only the patterns whose
    literals are there.  suites are the rules of rule files (see sources.rules), the built-in ones by default.
    """
    return docs.select("doc_id", "title", "text", "page_url").mapInPandas(_extractor(suites), SPAN_SCHEMA)


def spans_for_queries(hits: DataFrame, spans: DataFrame, confidence: DataFrame, minimum: float = 0.1) -> DataFrame:
    """Spans of each query's documents with their confidence; suites without support are left out."""
    c = F.when(F.col("suite") == "global", F.col("weight")).otherwise(
        F.least(F.lit(1.0), F.col("confidence") * F.col("weight"))
    )
    return (
        hits.select("query_id", "doc_id")
        .join(spans, "doc_id")
        .join(confidence, ["query_id", "suite"], "left")
        .where((F.col("suite") == "global") | (F.col("confidence") >= minimum))
        .withColumn("confidence", c)
    )


def _keep(gap: int, back: int):
    """Task function over spans sorted by query, document, offset and rule: only the last kept ones are remembered."""

    def run(batches):
        document, kept = None, []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("query_id", "doc_id", "offset", "suite")))
            keep = []
            for query, doc, offset, suite in keys:
                if (query, doc) != document:
                    document, kept = (query, doc), []
                new = not any(s == suite and abs(offset - o) < gap for o, s in kept)
                if new:
                    kept = [*kept[1 - back :], (offset, suite)] if back > 1 else [(offset, suite)]
                keep.append(new)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def dedupe_spans(spans: DataFrame, gap: int = 50, back: int = 3) -> DataFrame:
    """Drop a span when one of the last three kept ones is of the same suite and starts within the gap.

    The check never looks across documents: spans are sorted by (query, document) and pass by in order, so a document
    with very many spans takes linear time and no memory.
    """
    columns = ["query_id", "doc_id", "offset", "rule_no", "suite", "capability", "type", "confidence", "text", "url", "attrs"]
    order = ["query_id", "doc_id", "offset", "rule_no"]
    s = spans.select(columns)
    return s.repartition("query_id", "doc_id").sortWithinPartitions(*order).mapInArrow(_keep(gap, back), s.schema)


def actionable(spans: DataFrame) -> DataFrame:
    """query_id, score, n_actions: weight x confidence, halved for repeats of a capability; tables do not count."""
    w = Window.partitionBy("query_id", "capability").orderBy(F.desc("confidence"), "doc_id", "offset", "rule_no")
    weight = F.coalesce(
        F.element_at(X.literal_map(R.CAPABILITY_WEIGHTS), F.col("capability")), F.lit(R.DEFAULT_CAPABILITY_WEIGHT)
    )
    worth = weight * F.col("confidence") * F.when(F.row_number().over(w) > 1, 0.5).otherwise(1.0)
    return (
        spans.withColumn("worth", worth)
        .groupBy("query_id")
        .agg(F.round(F.round(F.sum("worth"), 9), 2).alias("score"), F.count_if(F.col("type") != "table").alias("n_actions"))
    )


def counts(spans: DataFrame, by: str) -> DataFrame:
    return spans.groupBy("query_id", by).agg(F.count(F.lit(1)).alias("n"))


def analysis_set(views: DataFrame, top: int = 8) -> DataFrame:
    """Passages to analyse: procedure view before info view, re-ranked before fused.

    views: query_id, view, stage (reranked or fused), doc_id, rank.
    """
    priority = F.when(F.col("view") == "procedure", 0).otherwise(2) + F.when(F.col("stage") == "reranked", 0).otherwise(1)
    v = views.where(F.col("rank") <= top).withColumn("priority", priority)
    best = v.groupBy("query_id").agg(F.min("priority").alias("priority"))
    return v.join(best, ["query_id", "priority"], "left_semi")


def choose_presenter(
    queries: DataFrame, views: DataFrame, actions: DataFrame, min_score: float = 2.0, min_actions: int = 2
) -> DataFrame:
    """query_id, presenter, reason, score, n_actions."""
    seen = views.groupBy("query_id").agg(
        F.max((F.col("view") == "procedure").cast("int")).alias("proc"),
        F.count_if((F.col("view") == "info") & (F.col("stage") == "reranked")).alias("info_r"),
        F.count_if((F.col("view") == "info") & (F.col("stage") == "fused") & (F.col("rank") <= 8)).alias("info_f"),
    )
    j = queries.select("query_id").join(seen, "query_id", "left").join(actions, "query_id", "left")
    score, n = F.coalesce("score", F.lit(0.0)), F.coalesce("n_actions", F.lit(0))
    n_info = F.when(F.col("info_r") > 0, F.col("info_r")).otherwise(F.col("info_f"))
    procedure = (F.coalesce("proc", F.lit(0)) == 1) & (score >= min_score) & (n >= min_actions)
    info = F.coalesce(n_info, F.lit(0)) > 0
    return j.select(
        "query_id",
        F.when(procedure, "procedure").when(info, "info").otherwise("fallback").alias("presenter"),
        F.when(procedure, F.format_string("actionable_score=%s, spans=%d", X.one_decimal(score), n))
        .when(info, F.format_string("info_available=%d, low_actionability=%s", n_info, X.one_decimal(score)))
        .otherwise("insufficient_results_both_views")
        .alias("reason"),
        score.alias("score"),
        n.alias("n_actions"),
    )


def tune_knobs(knobs: DataFrame) -> DataFrame:
    """Adjust knn_k, bm25_size and timeout_s to a query's specificity, suite affinity, urgency and trouble flag."""
    spec = F.col("specificity_level")
    strong = F.coalesce(F.col("suite_score"), F.lit(0.0)) >= 0.6
    return knobs.withColumns(
        {
            "knn_k": F.when(spec == "high", F.least("knn_k", F.lit(24)))
            .when(spec == "low", F.greatest("knn_k", F.lit(36)))
            .otherwise(F.col("knn_k")),
            "bm25_size": F.when(spec == "high", F.least("bm25_size", F.lit(40)))
            .when(spec == "low", F.greatest("bm25_size", F.lit(60)))
            .otherwise(F.col("bm25_size")),
            "timeout_s": F.col("timeout_s") * F.when(F.col("urgency") == "hard", 0.6).otherwise(1.0),
            "skip_rerank": F.col("urgency") == "hard",
            "suite_boost": F.when(strong, F.least(1.0 + F.col("suite_score") * 0.5, F.lit(1.5))),
            "trouble_boost": F.when(F.col("troubleshoot"), 1.3),
        }
    )


def build_procedure_view(c: DataFrame) -> DataFrame:
    """Whether the procedure view is worth building."""
    wanted = F.array(*[F.lit(a) for a in ("endpoint", "ticket", "form", "runbook")])
    return c.withColumn(
        "build",
        F.col("doish")
        | (F.col("intent") == "mixed")
        | (F.col("actionability") >= 1.0)
        | (F.coalesce(F.array_max(F.map_values("suite_affinity")), F.lit(0.0)) >= 0.6)
        | F.arrays_overlap("artifacts", wanted),
    )


def materialize(decisions: DataFrame, spans: DataFrame, passages: DataFrame) -> DataFrame:
    """The presenter's content, one row per query.  passages: query_id, doc_id, rank, title, text, page_url.

    The lists are bounded by the top passages of a query (procedure: their spans; info: six; fallback: three).
    """
    cite = F.concat(F.lit("["), F.col("title"), F.lit(" ▸ "), F.lit("Overview"), F.lit("]"))

    def listed(df, kind, text, order, citation, url, cta=None):
        return df.select(
            "query_id",
            F.lit(kind).alias("kind"),
            F.struct(
                *order, text.alias("text"), citation.alias("citation"), url.alias("url"),
                (cta if cta is not None else F.lit(None).cast("string")).alias("cta"),
            ).alias("item"),
        )

    p = passages.join(decisions.select("query_id", "presenter"), "query_id")
    pos = [F.col("rank").cast("long").alias("o1"), F.lit(0).cast("long").alias("o2"), F.lit(0).alias("o3")]
    # the reference's procedure decision keeps no passages, so prerequisites come from the analysed ones
    prereq = X.contains_any(F.lower("text"), ["prereq", "requirement", "before", "first"])
    proc, info = F.col("presenter") == "procedure", F.col("presenter") == "info"
    parts = [
        listed(p.where(proc & prereq), "prerequisites", X.clip(F.col("text"), 200), pos, cite, F.col("page_url")),
        listed(p.where(info & (F.col("rank") == 1)), "definition", X.clip(F.col("text"), 300), pos, cite, F.col("page_url")),
        listed(
            p.where(info & F.col("rank").between(2, 5)), "key_facts", X.clip(F.col("text"), 150), pos, cite, F.col("page_url")
        ),
        listed(
            p.where((F.col("presenter") == "fallback") & (F.col("rank") <= 3)),
            "paragraphs", X.clip(F.col("text"), 400), pos, cite, F.col("page_url"),
        ),
    ]
    titles = passages.select("query_id", "doc_id", "title")
    s = (
        spans.join(decisions.where(proc).select("query_id"), "query_id", "left_semi")
        .join(titles, ["query_id", "doc_id"], "left")
        .withColumn("title", F.coalesce("title", F.lit("Document")))
    )
    at = [
        F.floor(-F.col("confidence") * 1e6).alias("o1"),
        F.col("doc_id").alias("o2"),
        F.col("offset").alias("o3"),
    ]
    step = F.col("type") == "step"
    parts.append(
        listed(
            s.where(step), "steps", F.col("text"), at, F.concat(F.lit("["), F.col("title"), F.lit(" ▸ Step]")), F.col("url")
        )
    )
    act = F.concat(F.lit("["), F.col("title"), F.lit(" ▸ "), F.col("capability"), F.lit("]"))
    parts.append(
        listed(
            s.where(~step), "suite_actions",
            F.concat_ws(": ", X.suite_name(F.col("suite")), F.col("text"), F.nullif(X.format_attrs(F.col("attrs")), F.lit(""))),
            at, act, F.col("url"), X.call_to_action(F.col("suite"), F.col("capability")),
        )
    )
    items = parts[0]
    for more in parts[1:]:
        items = items.unionByName(more)
    lists = items.groupBy("query_id", "kind").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return decisions.join(lists, "query_id", "left").select("query_id", "presenter", "kind", "items")
