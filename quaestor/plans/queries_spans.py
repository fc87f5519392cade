"""Registered queries: actionable spans, the presenter, tuning."""


from pyspark.sql import functions as F

from quaestor.functions import rules as R
from quaestor.functions import text as X
from quaestor.operators import nearest
from quaestor.operators import spans as SP
from quaestor.plans import oracle as O
from quaestor.plans.queries_search import lex_hits
from quaestor.plans.registry import query
from quaestor.session import settle
from quaestor.sources import corpus as C
from quaestor.sources import rules as RF

# ------------------------------------------------------------------------------------------------ extraction
O.cte(
    "c_st",
    f"SELECT doc_id, page_url, o, {O.plain('o')} AS t FROM (SELECT doc_id, page_url, title || chr(10) || text AS o FROM c_corpus)",
)


def _rule_sql(no, suite, _name, capability, weight, p) -> str:
    kind = capability if suite == "global" else R.CAPABILITY_TYPES.get(capability, "endpoint")
    return f"""SELECT doc_id, page_url, o, CAST({no} AS BIGINT) AS rule_no, '{suite}' AS suite, '{capability}' AS capability, '{kind}' AS type,
    {weight} AS weight, string_split(regexp_replace(t, {O.s("(" + p + ")")}, chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts
    FROM c_st WHERE regexp_matches(t, {O.s(p)})"""


O.cte("c_marked", " UNION ALL ".join(_rule_sql(*r) for r in SP.rule_rows()))
O.cte(
    "c_spans",
    f"""SELECT doc_id, rule_no, suite, capability, type, CAST(weight AS DOUBLE) AS weight, {O.strip("m")} AS text,
    CASE WHEN suite <> 'global' AND regexp_matches(m, 'https?://[^\\s]+') THEN regexp_extract(m, 'https?://[^\\s]+')
    ELSE page_url END AS url, off AS span_offset FROM (SELECT *, substr(o, off + 1, n) AS m FROM (SELECT doc_id, page_url, o, rule_no,
    suite, capability, type, weight, CAST(list_sum(list_transform(list_slice(parts, 1, i - 1), lambda x:
    length(replace(x, chr(2), '')))) AS BIGINT) AS off, length(split_part(parts[i], chr(2), 1)) AS n FROM (SELECT *,
    unnest(range(2, len(parts) + 1)) AS i FROM c_marked)))""",
)


def docs_with_spans(spark, folder):
    return SP.extract_spans(C.corpus(spark, folder))


@query("extract_spans", O.sql("SELECT doc_id, rule_no, suite, capability, type, text, url, span_offset FROM c_spans"))
def extract_spans(spark, folder):
    s = docs_with_spans(spark, folder)
    return s.select("doc_id", "rule_no", "suite", "capability", "type", "text", "url", F.col("offset").alias("span_offset"))


@query(
    "span_counts",
    O.sql("SELECT suite, capability, type, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM c_spans GROUP BY ALL"),
)
def span_counts(spark, folder):
    return docs_with_spans(spark, folder).groupBy("suite", "capability", "type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs")
    )


@query(
    "span_cta",
    O.sql(
        f"""SELECT suite, capability, {O.lookup(R.SUITE_NAMES, "suite")} AS suite_name, coalesce(
        {O.lookup({f"{a}/{b}": t for (a, b), t in R.CTA.items()}, "suite || '/' || capability")}, 'Open link') AS cta,
        count(*) AS n FROM c_spans GROUP BY ALL"""
    ),
)
def span_cta(spark, folder):
    s = docs_with_spans(spark, folder)
    name, cta = X.suite_name(F.col("suite")), X.call_to_action(F.col("suite"), F.col("capability"))
    return s.groupBy("suite", "capability", name.alias("suite_name"), cta.alias("cta")).agg(F.count(F.lit(1)).alias("n"))


@query("span_attrs")
def span_attrs(spark, folder):
    """Attributes of the spans as shown to a reader."""
    s = docs_with_spans(spark, folder).where(F.size("attrs") > 0)
    return s.groupBy("suite", "capability", X.format_attrs(F.col("attrs")).alias("attrs")).agg(F.count(F.lit(1)).alias("n"))


_hits_of = {suite: [O.has("p", h) for h in m["hints"]] for suite, m in R.SUITES.items()}


@query(
    "suite_rules",
    O.sql(
        " UNION ALL ".join(
            f"""SELECT '{suite}' AS suite, CAST({len(m["hints"])} AS BIGINT) AS n_hints,
            CAST({sum(len(e[5]) for e in m["extractors"])} AS BIGINT) AS n_url_patterns, count(*) FILTER
            ({" OR ".join(_hits_of[suite])}) AS n_docs FROM (SELECT {O.plain("text")} AS p FROM c_corpus)"""
            for suite, m in R.SUITES.items()
        )
    ),
)
def suite_rules(spark, folder):
    """The rule files with the number of documents that meet any hint of each suite, from one pass."""
    docs, rules = C.corpus(spark, folder), RF.read_suites(spark, RF.built_in(spark).suites)
    suites = RF.suites_of(rules)
    met = docs.select(*[(SP.hint_hits(F.col("text"), m["hints"]) > 0).cast("int").alias(s) for s, m in suites.items()])
    sums = met.agg(*[F.sum(s).alias(s) for s in suites])
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("suite"), F.col(s).alias("n_docs")) for s in suites]))
    n = sums.select(rows.alias("r")).select("r.*")
    reg = SP.suite_registry(rules)
    return reg.join(n, "suite").select(
        "suite", F.size("hints").alias("n_hints"), F.size("url_patterns").alias("n_url_patterns"), "n_docs"
    )


# -------------------------------------------------------------------------------------------- views, analysis
# The procedure view is the lexical list, the info view the vector list.
O.cte(
    "c_views",
    """SELECT query_id, 'procedure' AS view_name, CASE WHEN query_id % 2 = 0 THEN 'reranked' ELSE 'fused' END AS stage,
    doc_id, rank FROM c_bm25 UNION ALL SELECT query_id, 'info', CASE WHEN query_id % 3 = 0 THEN
    'reranked' ELSE 'fused' END, doc_id, rank FROM c_knn JOIN c_corpus USING (doc_id)""",
)


def views(spark, folder):
    q = F.col("query_id")
    lex = lex_hits(spark, folder)
    docs = C.corpus(spark, folder).select("doc_id")
    vec = nearest.knn(C.vectors(spark, folder), C.query_vectors(spark, folder)).join(docs, "doc_id", "left_semi")
    a = lex.select(
        q, F.lit("procedure").alias("view"), F.when(q % 2 == 0, "reranked").otherwise("fused").alias("stage"), "doc_id", "rank"
    )
    b = vec.select(q, F.lit("info").alias("view"), F.when(q % 3 == 0, "reranked").otherwise("fused").alias("stage"), "doc_id", "rank")
    return a.unionByName(b)


O.cte(
    "c_aset",
    """SELECT query_id, view_name, stage, doc_id, rank FROM (SELECT *, min(prio) OVER (PARTITION BY query_id) AS best FROM
    (SELECT *, CASE WHEN view_name = 'procedure' THEN 0 ELSE 2 END + CASE WHEN stage = 'reranked' THEN 0 ELSE 1 END AS prio
    FROM c_views WHERE rank <= 8)) WHERE prio = best""",
)


@query("analysis_set", O.sql("SELECT query_id, view_name, stage, doc_id, rank FROM c_aset"))
def analysis_set(spark, folder):
    a = SP.analysis_set(views(spark, folder))
    return a.select("query_id", F.col("view").alias("view_name"), "stage", "doc_id", "rank")


_hint_rows = " UNION ALL ".join(
    f"""SELECT query_id, '{suite}' AS suite, least(1.0, 2.0 * sum({" + ".join(f"CAST({h} AS INT)" for h in hs)}) /
    (count(*) * {len(hs)})) AS confidence FROM c_probe GROUP BY query_id"""
    for suite, hs in _hits_of.items()
)
O.cte(
    "c_probe",
    f"""SELECT query_id, {O.plain("title || ' ' || page_url || ' ' || text")} AS p FROM c_aset
    JOIN c_corpus USING (doc_id)""",
)
O.cte("c_conf", _hint_rows)


def analysed(spark, folder):
    v = settle(views(spark, folder))
    a = SP.analysis_set(v).select("query_id", "doc_id", "rank")
    docs = C.corpus(spark, folder)
    return v, a.join(docs, "doc_id"), docs


@query("suite_confidence", O.sql("SELECT query_id, suite, round(confidence, 6) AS confidence FROM c_conf"))
def suite_confidence(spark, folder):
    _, p, _ = analysed(spark, folder)
    return SP.suite_confidence(p).withColumn("confidence", F.round("confidence", 6))


O.cte(
    "c_qspans",
    """SELECT query_id, doc_id, rule_no, suite, capability, type, text, url, span_offset, CASE WHEN suite = 'global' THEN weight
    ELSE least(1.0, c.confidence * weight) END AS confidence FROM (SELECT DISTINCT query_id, doc_id FROM c_aset) JOIN c_spans
    USING (doc_id) LEFT JOIN c_conf c USING (query_id, suite) WHERE suite = 'global' OR c.confidence >= 0.1""",
)
O.cte(
    "c_dd",
    """SELECT s.* FROM c_qspans s JOIN (SELECT query_id, doc_id, unnest(list_reduce(list([{'o': span_offset, 'r': rule_no,
    's': suite}] ORDER BY span_offset, rule_no), lambda acc, x: CASE WHEN len(list_filter(list_slice(acc,
    greatest(len(acc) - 2, 1), len(acc)), lambda k: k.s = x[1].s AND abs(k.o - x[1].o) < 50)) > 0 THEN acc
    ELSE list_concat(acc, x) END)) AS k FROM c_qspans GROUP BY query_id, doc_id) d ON d.query_id = s.query_id
    AND d.doc_id = s.doc_id AND d.k.o = s.span_offset AND d.k.r = s.rule_no""",
)


def query_spans(spark, folder):
    v, p, docs = analysed(spark, folder)
    needed = docs.join(p.select("doc_id").distinct(), "doc_id", "left_semi")
    found = SP.spans_for_queries(p, SP.extract_spans(needed), SP.suite_confidence(p))
    return v, p, settle(SP.dedupe_spans(settle(found)))


@query(
    "dedupe_spans",
    O.sql(
        """SELECT query_id, doc_id, suite, capability, type, span_offset, round(confidence, 6) AS confidence, text, url
        FROM c_dd"""
    ),
)
def dedupe_spans(spark, folder):
    s = query_spans(spark, folder)[2]
    return s.select(
        "query_id", "doc_id", "suite", "capability", "type", F.col("offset").alias("span_offset"),
        F.round("confidence", 6).alias("confidence"), "text", "url",
    )


O.cte(
    "c_score",
    f"""SELECT query_id, round(round(sum(cw * confidence * CASE WHEN n > 1 THEN 0.5 ELSE 1 END), 9), 2) AS score,
    count(*) FILTER (type <> 'table') AS n_actions FROM (SELECT *, row_number() OVER (PARTITION BY query_id, capability
    ORDER BY confidence DESC, doc_id, span_offset, rule_no) AS n, CAST(coalesce({O.lookup(R.CAPABILITY_WEIGHTS, "capability")}, 0.3)
    AS DOUBLE) AS cw FROM c_dd) GROUP BY query_id""",
)


@query("actionable_score", O.sql("SELECT query_id, score, n_actions FROM c_score"))
def actionable_score(spark, folder):
    return SP.actionable(query_spans(spark, folder)[2])


@query(
    "suite_counts",
    O.sql(
        """SELECT query_id, 'suite' AS kind, suite AS name, count(*) AS n FROM c_dd GROUP BY ALL UNION ALL
        SELECT query_id, 'capability', capability, count(*) FROM c_dd GROUP BY ALL"""
    ),
)
def suite_counts(spark, folder):
    """Both counts from one grouping over (suite, capability)."""
    s = query_spans(spark, folder)[2]
    pairs = s.groupBy("query_id", "suite", "capability").agg(F.count(F.lit(1)).alias("n"))
    kinds = F.array(
        F.struct(F.lit("suite").alias("kind"), F.col("suite").alias("name")),
        F.struct(F.lit("capability").alias("kind"), F.col("capability").alias("name")),
    )
    return pairs.select("query_id", "n", F.explode(kinds).alias("k")).groupBy("query_id", "k.kind", "k.name").agg(F.sum("n").alias("n"))


@query(
    "presenter",
    O.sql(
        """SELECT query_id, CASE WHEN p THEN 'procedure' WHEN i THEN 'info' ELSE 'fallback' END AS presenter, CASE WHEN p THEN
        printf('actionable_score=%.1f, spans=%d', score, n) WHEN i THEN printf('info_available=%d, low_actionability=%.1f',
        n_info, score) ELSE 'insufficient_results_both_views' END AS reason, score, n AS n_actions FROM (SELECT *, proc > 0 AND
        score >= 2.0 AND n >= 2 AS p, n_info > 0 AS i FROM (SELECT query_id, coalesce(score, CAST(0 AS DOUBLE)) AS score,
        coalesce(n_actions, 0) AS n, coalesce(proc, 0) AS proc, coalesce(CASE WHEN ir > 0 THEN ir ELSE inf END, 0) AS n_info
        FROM c_sq LEFT JOIN c_score USING (query_id) LEFT JOIN (SELECT query_id, count(*) FILTER (view_name = 'procedure')
        AS proc, count(*) FILTER (view_name = 'info' AND stage = 'reranked') AS ir, count(*) FILTER (view_name = 'info' AND
        stage = 'fused' AND rank <= 8) AS inf FROM c_views GROUP BY 1) USING (query_id)))"""
    ),
)
def presenter(spark, folder):
    v, _, s = query_spans(spark, folder)
    return SP.choose_presenter(C.search_queries(spark, folder), v, SP.actionable(s))


@query("materialize_answer")
def materialize_answer(spark, folder):
    v, p, s = query_spans(spark, folder)
    decisions = SP.choose_presenter(C.search_queries(spark, folder), v, SP.actionable(s))
    m = SP.materialize(decisions.select("query_id", "presenter"), s, p)
    lines = F.transform("items", lambda i: F.concat_ws(" | ", i["text"], i["citation"], i["url"], i["cta"]))
    return m.select("query_id", "presenter", "kind", F.size("items").alias("n_items"), F.array_join(lines, "\n").alias("content"))


# ---------------------------------------------------------------------------------------------------- tuning
O.cte(
    "c_colors",
    """SELECT doc_id, list_extract(['high', 'med', 'low'], CAST(doc_id % 3 + 1 AS INT)) AS lvl, (doc_id % 11) / 10.0 AS jira,
    (doc_id % 7) / 10.0 AS api, CASE WHEN doc_id % 4 = 0 THEN 'hard' ELSE 'none' END AS urgency, contains(text, 'error') AS
    trouble, 30 + doc_id % 20 AS kk, 35 + doc_id % 40 AS bb, doc_id % 9 = 0 AS doish, CASE WHEN doc_id % 8 = 0 THEN 'mixed'
    ELSE 'info' END AS intent, (doc_id % 13) / 10.0 AS act, CASE WHEN doc_id % 6 = 0 THEN ['form', 'chat'] ELSE ['chat'] END
    AS arts FROM c_corpus""",
)


def colors(spark, folder):
    i = F.col("doc_id")
    return C.corpus(spark, folder).select(
        i,
        C.pick(["high", "med", "low"], i).alias("specificity_level"),
        F.create_map(F.lit("jira"), (i % 11) / 10.0, F.lit("api"), (i % 7) / 10.0).alias("suite_affinity"),
        F.when(i % 4 == 0, "hard").otherwise("none").alias("urgency"),
        F.col("text").contains("error").alias("troubleshoot"),
        (30 + i % 20).alias("knn_k"),
        (35 + i % 40).alias("bm25_size"),
        F.lit(1.8).alias("timeout_s"),
        (i % 9 == 0).alias("doish"),
        F.when(i % 8 == 0, "mixed").otherwise("info").alias("intent"),
        ((i % 13) / 10.0).alias("actionability"),
        F.when(i % 6 == 0, F.array(F.lit("form"), F.lit("chat"))).otherwise(F.array(F.lit("chat"))).alias("artifacts"),
    )


@query(
    "tune_knobs",
    O.sql(
        """SELECT doc_id, CASE lvl WHEN 'high' THEN least(kk, 24) WHEN 'low' THEN greatest(kk, 36) ELSE kk END AS knn_k,
        CASE lvl WHEN 'high' THEN least(bb, 40) WHEN 'low' THEN greatest(bb, 60) ELSE bb END AS bm25_size,
        round(CAST(CASE WHEN urgency = 'hard' THEN 1.08 ELSE 1.8 END AS DOUBLE), 6) AS timeout_s, urgency = 'hard' AS skip_rerank,
        round(CAST(CASE WHEN jira >= 0.6 THEN least(1 + jira * 0.5, 1.5) END AS DOUBLE), 6) AS suite_boost,
        CAST(CASE WHEN trouble THEN 1.3 END AS DOUBLE) AS trouble_boost FROM c_colors"""
    ),
)
def tune_knobs(spark, folder):
    """The first suite of the affinity map is the one that may be boosted."""
    c = colors(spark, folder).withColumn("suite_score", F.element_at(F.map_values("suite_affinity"), 1))
    t = SP.tune_knobs(c)
    return t.select(
        "doc_id", "knn_k", "bm25_size", F.round("timeout_s", 6).alias("timeout_s"), "skip_rerank",
        F.round("suite_boost", 6).alias("suite_boost"), "trouble_boost",
    )


@query(
    "build_procedure_view",
    O.sql(
        """SELECT doc_id, doish OR intent = 'mixed' OR act >= 1.0 OR greatest(jira, api) >= 0.6 OR list_has_any(arts,
        ['endpoint', 'ticket', 'form', 'runbook']) AS build FROM c_colors"""
    ),
)
def build_procedure_view(spark, folder):
    return SP.build_procedure_view(colors(spark, folder)).select("doc_id", "build")
