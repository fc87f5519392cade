"""Registered queries: filters, ranking policies, aggregates, passage extraction."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.functions import rules as R
from quaestor.functions import text as X
from quaestor.operators import evidence, fusion, nearest, passages, quality, ranking, scoring
from quaestor.operators import filters as FL
from quaestor.plans import oracle as O
from quaestor.plans import search as S
from quaestor.plans.queries_search import R_COLS, lex_hits
from quaestor.plans.queries_text import hints_sql
from quaestor.plans.registry import query
from quaestor.session import settle
from quaestor.sources import corpus as C

# --------------------------------------------------------------------------------------------------- filters
FILTERED = {
    "filter_acl": (FL.Filters(acl_hash="grp_1"), "acl_hash = 'grp_1'"),
    "filter_space": (FL.Filters(space_key="en"), "space_key = 'en'"),
    "filter_content_type": (FL.Filters(content_type="runbook"), "content_type = 'runbook'"),
    "filter_updated_range": (
        FL.Filters(updated_after="2024-03-01", updated_before="2024-06-30"),
        "updated_at BETWEEN DATE '2024-03-01' AND DATE '2024-06-30'",
    ),
    "filter_utility": (FL.Filters(utility_name="Account Utility"), "utility_name = 'Account Utility'"),
    "filter_all": (
        FL.Filters(acl_hash="grp_1", space_key="en", updated_after="2024-02-01"),
        "acl_hash = 'grp_1' AND space_key = 'en' AND updated_at >= DATE '2024-02-01'",
    ),
}


def _register_filter(name, filters, condition):
    ranked = O.ranked(f"(SELECT * FROM c_bd JOIN c_corpus USING (doc_id) WHERE {condition})", 10)

    @query(name, O.sql(f"SELECT query_id, doc_id, score, rank FROM ({ranked})"))
    def run(spark, folder):
        """Filtered lexical search: the filter narrows the candidates, the index statistics stay whole."""
        c = S.Collection.load(spark, folder)
        return S.lexical_search(c, C.search_queries(spark, folder), 10, filters).select(R_COLS)


for _name, (_f, _cond) in FILTERED.items():
    _register_filter(_name, _f, _cond)


@query(
    "filter_knn",
    O.sql(
        f"""SELECT query_id, doc_id, score, rank FROM ({O.ranked(
            "(SELECT * FROM c_knn_all JOIN c_corpus USING (doc_id) WHERE space_key = 'en')", 10)})"""
    ),
)
def filter_knn(spark, folder):
    """Filters hold for vector search as well."""
    c = S.Collection.load(spark, folder)
    return S.vector_search(c, C.query_vectors(spark, folder), 10, FL.Filters(space_key="en")).select(R_COLS)


@query(
    "filter_nested_any",
    O.sql(
        """SELECT doc_id, title FROM c_corpus WHERE len(list_filter(string_split(text, chr(10)),
        lambda x: contains(lower(x), 'teams channel'))) > 0"""
    ),
)
def filter_nested_any(spark, folder):
    return FL.any_section(C.corpus(spark, folder), "teams channel").select("doc_id", "title")


@query(
    "intent_filters",
    O.sql(
        f"""SELECT content_type, intent, count(*) AS n FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'confluence'
        WHEN 1 THEN 'swagger' WHEN 2 THEN 'api_spec' ELSE 'other' END AS intent, content_type FROM c_corpus)
        WHERE {O.lookup(R.INTENT_CONTENT_TYPE, "intent")} IS NULL
        OR content_type = {O.lookup(R.INTENT_CONTENT_TYPE, "intent")} GROUP BY ALL"""
    ),
)
def intent_filters(spark, folder):
    """Documents that pass the default filter of their intent."""
    d = C.corpus(spark, folder).withColumn("intent", C.pick(["confluence", "swagger", "api_spec", "other"], F.col("doc_id")))
    wanted = FL.intent_filter(F.col("intent"))
    return d.where(wanted.isNull() | (F.col("content_type") == wanted)).groupBy("content_type", "intent").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "merge_filters",
    O.sql(
        """SELECT doc_id, 'grp_' || (doc_id % 5) AS acl_hash, CASE WHEN doc_id % 2 = 0 THEN 'user' ELSE lang END
        AS space_key, CASE WHEN doc_id % 3 = 0 THEN 'plan' WHEN doc_id % 2 = 0 THEN 'guide' ELSE source END
        AS content_type FROM documents"""
    ),
)
def merge_filters(spark, folder):
    """Per request: state, then user filters, then plan filters; the later wins."""
    d = C.table(spark, folder, "documents")
    i = F.col("doc_id")

    def entry(cond, **kv):
        m = F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v if not isinstance(v, str) else F.lit(v))])
        return F.when(cond, m) if cond is not None else m

    acl = F.concat(F.lit("grp_"), (i % 5).cast("string"))
    state = entry(None, acl_hash=acl, space_key=F.col("lang"), content_type=F.col("source"))
    user = entry(i % 2 == 0, space_key="user", content_type="guide")
    plan = entry(i % 3 == 0, content_type="plan")
    m = d.select("doc_id", FL.merge_filters(state, user, plan).alias("m"))
    return m.select("doc_id", *[F.element_at("m", k).alias(k) for k in ("acl_hash", "space_key", "content_type")])


def soft_sql(view: str) -> str:
    _, conditions = R.SOFT_FILTERS[view]

    def met(field, value):
        if field == "content_type":
            return f"content_type = {O.s(value)}"
        return f"list_has_any({'tt' if field == 'title' else 'xt'}, {O.lst(value.split())})"

    return " + ".join(f"CAST({met(f, v)} AS BIGINT)" for f, v in conditions)


@query(
    "soft_filters",
    O.sql(
        " UNION ALL ".join(
            f"""SELECT '{v}' AS view_name, doc_id, soft_score FROM (SELECT doc_id, {soft_sql(v)} AS soft_score FROM
            (SELECT *, {O.tokens("title")} AS tt, {O.tokens("text")} AS xt FROM c_corpus))
            WHERE soft_score >= {R.SOFT_FILTERS[v][0]}"""
            for v in R.SOFT_FILTERS
        )
    ),
)
def soft_filters(spark, folder):
    docs = C.corpus(spark, folder)
    parts = [
        FL.soft_filter(docs, v).select(F.lit(v).alias("view_name"), "doc_id", F.col("soft_score").cast("long").alias("soft_score"))
        for v in R.SOFT_FILTERS
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "filter_pinning",
    O.sql(
        """SELECT req_id, arg_min(stage || '/' || event, (ts, event_id)) AS state, count(*) AS n_calls FROM c_tel
        GROUP BY req_id"""
    ),
)
def filter_pinning(spark, folder):
    """The first filter state of a request holds for all of its calls."""
    t = C.telemetry(spark, folder).withColumn("state", F.concat_ws("/", "stage", "event"))
    n = t.groupBy("req_id").agg(F.count(F.lit(1)).alias("n_calls"))
    return FL.pin_first(t).join(n, "req_id")


@query(
    "parse_ts",
    f"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
    WHEN 1 THEN strftime(ts, '%Y-%m-%d 00:00:00') WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed FROM events""",
)
def parse_ts(spark, folder):
    e = C.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    forms = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss"]
    raw = X.first_case(
        [(F.col("event_id") % 5 == i, F.date_format("ts", f)) for i, f in enumerate(forms)]
        + [(F.col("event_id") % 5 == 3, F.lit("not a date"))],
        F.date_format("ts", "yyyy-'13'-dd"),
    )
    return e.select("event_id", F.date_format(FL.parse_iso(raw), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query(
    "passage_length",
    O.sql(
        f"""SELECT doc_id, unit_no, CAST(length(t) AS BIGINT) AS n FROM
        (SELECT doc_id, unit_no, {O.collapse("unit_text")} AS t FROM c_units) WHERE length(t) BETWEEN 80 AND 1200"""
    ),
)
def passage_length(spark, folder):
    units = C.sections(C.corpus(spark, folder)).withColumnRenamed("unit_text", "text")
    return FL.passage_length(units).select(
        "doc_id", F.col("unit_no").cast("long").alias("unit_no"), F.length("text").cast("long").alias("n")
    )


@query(
    "drop_metadata_only",
    O.sql(
        """SELECT doc_id, idx FROM (SELECT doc_id, idx, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 2 END AS n_passages,
        CASE WHEN doc_id % 4 = 0 THEN '' ELSE text END AS body FROM c_corpus)
        WHERE NOT (idx = 'api' AND n_passages = 0 AND trim(body) = '')"""
    ),
)
def drop_metadata_only(spark, folder):
    i = F.col("doc_id")
    hits = C.corpus(spark, folder).select(
        i, "idx", F.when(i % 2 == 0, 0).otherwise(2).alias("n_passages"), F.when(i % 4 == 0, "").otherwise(F.col("text")).alias("body")
    )
    return FL.drop_metadata_only(hits).select("doc_id", "idx")



def _scaled(spark, folder):
    """Hits with scores brought to 0..1 by their query's best score, so that thresholds bite."""
    h = settle(lex_hits(spark, folder, 50, "idx", "title", "text", "page_url"))
    top = h.groupBy("query_id").agg(F.max("score").alias("top"))
    return h.join(top, "query_id").withColumn("score", F.round(F.col("score") / F.col("top"), 6)).drop("top")


O.cte(
    "c_scaled",
    """SELECT query_id, query, doc_id, rank, idx, title, text, page_url,
    round(score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM c_hits""",
)


@query(
    "quality_filter",
    O.sql(
        """SELECT query_id, doc_id, idx, score FROM c_scaled
        WHERE score >= CASE WHEN query_id % 2 = 0 THEN 0.10 WHEN idx = 'api' THEN 0.55 ELSE 0.7 END"""
    ),
)
def quality_filter(spark, folder):
    """Thresholds per (query, index) where there are any, the default elsewhere."""
    q = C.search_queries(spark, folder).where(F.col("query_id") % 2 == 1)
    t = q.select("query_id", F.explode(F.array(F.lit("main"), F.lit("api"))).alias("idx")).withColumn(
        "threshold", F.when(F.col("idx") == "api", 0.55).otherwise(0.7)
    )
    return FL.quality_filter(_scaled(spark, folder), t).select("query_id", "doc_id", "idx", "score")


@query(
    "no_answer_gate",
    O.sql(
        """SELECT query_id, CASE WHEN top IS NULL THEN 'no_documents_found' WHEN top < 20 THEN
        printf('low_score_%.3f', top) END AS reason FROM c_sq LEFT JOIN (SELECT query_id, max(score) AS top FROM (SELECT query_id,
        doc_id, round(score, 6) AS score FROM c_bd) JOIN c_corpus USING (doc_id) WHERE space_key = 'fr' AND content_type = 'guide'
        AND acl_hash = 'grp_3' GROUP BY 1) USING (query_id)"""
    ),
)
def no_answer_gate(spark, folder):
    """A search confined to a few documents, which have good answers, poor ones or none."""
    narrow = FL.Filters(space_key="fr", content_type="guide", acl_hash="grp_3")
    hits = S.lexical_search(S.Collection.load(spark, folder), C.search_queries(spark, folder), 50, narrow)
    return FL.no_answer_gate(C.search_queries(spark, folder), hits, minimum=20.0)


@query(
    "validate_docs",
    """SELECT doc_id, CAST(len(e) AS BIGINT) AS n_errors, array_to_string(e, ', ') AS errors FROM (SELECT doc_id,
    list_filter([CASE WHEN doc_id % 7 = 0 THEN 'missing title' END, CASE WHEN doc_id % 5 = 0 THEN 'missing body' END,
    CASE WHEN doc_id % 4 = 0 THEN 'metadata is not a map' END, CASE WHEN doc_id % 3 = 0 THEN 'bad date' END],
    lambda x: x IS NOT NULL) AS e FROM documents) WHERE len(e) > 0""",
)
def validate_docs(spark, folder):
    i = F.col("doc_id")
    d = C.corpus(spark, folder).select(
        "doc_id",
        F.when(i % 7 == 0, " ").otherwise(F.concat(F.lit("t"), F.col("title"))).alias("title"),
        F.when(i % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("b"), F.col("text"))).alias("text"),
        F.when(i % 4 != 0, F.create_map(F.lit("lang"), F.col("space_key"))).alias("metadata"),
        F.when(i % 3 == 0, "soon").otherwise(F.col("updated_at").cast("string")).alias("updated_at"),
    )
    v = FL.validate_documents(d).where(F.size("errors") > 0)
    return v.select("doc_id", F.size("errors").cast("long").alias("n_errors"), F.array_join("errors", ", ").alias("errors"))


@query(
    "sanitize_queries",
    f"""SELECT query_id, nullif({O.strip("t")}, '') AS clean FROM (SELECT conv_id || '-' || turn AS query_id,
    CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN '  it''s ' || text ELSE '' END AS t FROM conversations)""",
)
def sanitize_queries(spark, folder):
    """Turns with escapes and control characters put in come out as they were; empty ones are null."""
    t = F.col("text")
    dirty = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("\\\\"), t, F.lit("\x07")))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit("  it\\'s "), t, F.lit("\x01 ")))
        .otherwise(F.lit(" \\\\ "))
    )
    c = C.table(spark, folder, "conversations")
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"),
        X.strip(X.sanitize(dirty)).alias("clean"),
    ).withColumn("clean", F.nullif("clean", F.lit("")))


# --------------------------------------------------------------------------------------------------- ranking
@query(
    "unanswered_queries",
    O.sql(
        """SELECT query_id, 'No relevant documentation found. Try these searches: "' || query
        || ' setup documentation" | "' || query || ' API reference" | "' || query || ' integration guide"' AS answer
        FROM c_sq WHERE query_id NOT IN (SELECT query_id FROM c_bm25 JOIN c_corpus USING (doc_id)
        WHERE space_key = 'de')"""
    ),
)
def unanswered_queries(spark, folder):
    hits = lex_hits(spark, folder, 50, "space_key").where(F.col("space_key") == "de")
    return evidence.no_results(C.search_queries(spark, folder), hits)


@query(
    "compress_results",
    O.sql(f"SELECT query_id, doc_id, rank, {O.clip('text', 400)} AS text FROM c_hits WHERE rank <= 5"),
)
def compress_results(spark, folder):
    h = lex_hits(spark, folder, 5, "text")
    return h.select("query_id", "doc_id", "rank", X.clip(F.col("text"), 400).alias("text"))


@query(
    "sources",
    O.sql(
        f"""SELECT query_id, rank, doc_id, CASE WHEN title = '' THEN 'Document ' || rank ELSE title END AS title,
        CASE WHEN doc_id % 2 = 0 THEN page_url ELSE '#doc-' || doc_id END AS url, {O.clip("text", 200)} AS excerpt
        FROM c_hits WHERE rank <= 10"""
    ),
)
def sources(spark, folder):
    h = lex_hits(spark, folder, 12, "title", "page_url", "text")
    return evidence.sources(h.withColumn("page_url", F.when(F.col("doc_id") % 2 == 0, F.col("page_url"))))


@query(
    "context_budget",
    O.sql(
        f"""SELECT query_id, string_agg(block, chr(10) ORDER BY rank) AS context, count(*) AS n_sources FROM
        (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM (SELECT query_id, rank,
        '[Source ' || rank || ': ' || title || ']' || chr(10) || {O.strip("text")} || chr(10) AS block FROM c_hits
        WHERE rank <= 12)) WHERE used <= 8000 GROUP BY query_id"""
    ),
)
def context_budget(spark, folder):
    return ranking.context_budget(lex_hits(spark, folder, 12, "title", "text"))


@query(
    "rerank_select",
    O.sql(
        """SELECT query_id, doc_id, score, rank, CAST(threshold AS DOUBLE) AS threshold FROM (SELECT *, CASE WHEN ne > n * 0.3 OR mx < 0.2 THEN 0.005
        ELSE 0.1 END AS threshold, least(greatest(3, n // 3), 8, n) AS sure FROM (SELECT query_id, doc_id, score,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, count(*) OVER q AS n,
        max(score) OVER q AS mx, sum(CAST(doc_id % 4 = 0 AS INT)) OVER q AS ne FROM (SELECT query_id, doc_id,
        relevance AS score FROM c_rel) WINDOW q AS (PARTITION BY query_id)))
        WHERE (rank <= 8 AND (score >= threshold OR rank <= sure)) OR rank <= 6"""
    ),
)
def rerank_select(spark, folder):
    h = scoring.score_pairs(lex_hits(spark, folder, 50, "text"))
    h = h.select(
        "query_id", "doc_id", F.round("pair_score", 6).alias("score"), (F.col("doc_id") % 4 == 0).alias("is_empty")
    )
    return ranking.rerank_select(h)


O.cte(
    "c_rr",
    f"""SELECT h.query_id, h.doc_id, round(relevance + {hints_sql(O.plain("text"), O.plain("title"))}, 6) AS score
    FROM c_hits h JOIN c_rel USING (query_id, doc_id)""",
)


@query(
    "rerank",
    O.sql(
        """SELECT query_id, doc_id, CAST(score AS DOUBLE) AS score, rank FROM (SELECT *, CASE WHEN mx < 0.2 THEN 0.005
        ELSE 0.1 END AS threshold, least(greatest(3, n // 3), 8, n) AS sure FROM (SELECT query_id, doc_id, score,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, count(*) OVER q AS n,
        max(score) OVER q AS mx FROM c_rr WINDOW q AS (PARTITION BY query_id)))
        WHERE (rank <= 8 AND (score >= threshold OR rank <= sure)) OR rank <= 6"""
    ),
)
def rerank(spark, folder):
    return scoring.rerank(lex_hits(spark, folder, 50, "title", "text")).select(R_COLS)


@query(
    "rerank_stats",
    O.sql(
        """SELECT query_id, n, n - least(n, 6) AS dropped, round(avg_score, 6) AS avg_score, tops[1] AS top1,
        tops[2] AS top2, tops[3] AS top3 FROM (SELECT query_id, count(*) AS n, avg(relevance) AS avg_score,
        list(relevance ORDER BY relevance DESC, doc_id) AS tops FROM c_rel GROUP BY query_id)"""
    ),
)
def rerank_stats(spark, folder):
    h = scoring.score_pairs(lex_hits(spark, folder, 50, "text"))
    h = settle(h.select("query_id", "doc_id", F.round("pair_score", 6).alias("score")))
    st = ranking.rerank_stats(h, FL.first_ranked(h, 6))
    return st.withColumn("avg_score", F.round("avg_score", 6))


O.cte("c_defi", f"SELECT query_id, {O.words('lower(query)')} AS ws FROM c_sq2")
O.cte("c_sq2", "SELECT query_id, CASE WHEN query_id % 5 = 0 THEN 'define ' || query ELSE query END AS query FROM c_sq")


@query(
    "rerank_policy",
    O.sql(
        """SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN reason = 'ok' THEN
        -relevance ELSE 0 END, rank) AS rank, reason, reason = 'ok' AS used_scores FROM (SELECT h.query_id, h.doc_id,
        h.rank, relevance, CASE WHEN len(ws) <= 3 OR (ws[1] = 'what' AND ws[2] IN ('is', 'are'))
        OR ws[1] IN ('define', 'definition') OR list_contains(ws, 'meaning') OR list_contains(ws, 'stands')
        THEN 'skipped_definitional' ELSE 'ok' END AS reason FROM c_hits h JOIN c_rel USING (query_id, doc_id)
        JOIN c_defi USING (query_id)) WHERE reason <> 'ok' OR rank <= 12"""
    ),
)
def rerank_policy(spark, folder):
    q = C.search_queries(spark, folder)
    h = settle(scoring.score_pairs(lex_hits(spark, folder, 50, "text")).withColumn("pair_score", F.round("pair_score", 6)))
    asked = q.withColumn(
        "query", F.when(F.col("query_id") % 5 == 0, F.concat(F.lit("define "), F.col("query"))).otherwise(F.col("query"))
    )
    return ranking.rerank_policy(asked, h.select("query_id", "doc_id", "rank", "pair_score"))


@query(
    "skip_bm25_gate",
    O.sql(
        """SELECT query_id, count(*) AS n_hits, round(avg(score) FILTER (rank <= 8), 6) AS avg_score,
        count(*) >= 8 AND round(avg(score) FILTER (rank <= 8), 6) > 0.7 AS skip FROM c_knn GROUP BY query_id"""
    ),
)
def skip_bm25_gate(spark, folder):
    vec = nearest.knn(C.vectors(spark, folder), C.query_vectors(spark, folder))
    return ranking.skip_lexical_gate(vec, minimum=0.7)


O.cte(
    "c_bmde",
    O.ranked(
        """(SELECT * FROM c_bd JOIN c_corpus USING (doc_id) WHERE space_key = 'de' AND content_type = 'guide'
        AND acl_hash = 'grp_3')""",
        50,
    ),
)
O.cte(
    "c_thin",
    f"""SELECT query_id FROM c_bmde JOIN c_sq USING (query_id) WHERE
    {O.contains_any("lower(query)", R.UTILITY_QUERY_TERMS)} GROUP BY query_id HAVING count(DISTINCT doc_id) < 20""",
)


@query(
    "recall_fallback",
    O.sql(
        f"""SELECT query_id, doc_id, origin, position FROM (SELECT query_id, doc_id, origin, row_number() OVER
        (PARTITION BY query_id ORDER BY origin, rank) AS position FROM (SELECT query_id, doc_id, rank, 'fallback' AS origin
        FROM c_bm25 WHERE query_id IN (SELECT query_id FROM c_thin) UNION ALL SELECT query_id, doc_id, rank, 'original'
        FROM c_bmde d WHERE query_id IN (SELECT query_id FROM c_thin) AND NOT EXISTS (SELECT 1 FROM c_bm25 b
        WHERE b.query_id = d.query_id AND b.doc_id = d.doc_id)))"""
    ),
)
def recall_fallback(spark, folder):
    """Utility queries that find too little in one space are searched again without the filter, and merged."""
    c, q = S.Collection.load(spark, folder), C.search_queries(spark, folder)
    narrow = settle(S.lexical_search(c, q, 50, FL.Filters(space_key="de", content_type="guide", acl_hash="grp_3")))
    utility = q.where(X.is_utility_query(F.col("query")))
    thin = ranking.thin_queries(narrow, 20).join(utility, "query_id", "left_semi").select("query_id")
    again = S.lexical_search(c, q.join(thin, "query_id", "left_semi"), 50)
    merged = fusion.merge_fallback(again.select(R_COLS), narrow.join(thin, "query_id", "left_semi").select(R_COLS))
    return merged.select("query_id", "doc_id", "origin", "position")


@query(
    "condense_turns",
    f"""SELECT conv_id, turn, CASE WHEN coalesce({O.strip("left(p, 200)")}, '') <> '' THEN 'Given context: ' ||
    {O.strip("left(p, 200)")} || '... Current question: ' || text ELSE text END AS question FROM (SELECT *,
    lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) WHERE role = 'user'""",
)
def condense_turns(spark, folder):
    return ranking.condense_turns(C.table(spark, folder, "conversations")).select("conv_id", "turn", "question")


@query(
    "recent_context",
    f"""SELECT conv_id, turn, coalesce(string_agg(line, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn
    ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS context FROM (SELECT conv_id, turn, CASE WHEN role = 'user'
    THEN 'Q: ' || text ELSE 'A: ' || {O.clip("text", 100)} END AS line FROM conversations)""",
)
def recent_context(spark, folder):
    return ranking.recent_context(C.table(spark, folder, "conversations"))


# ------------------------------------------------------------------------------------------------ aggregates
@query(
    "list_values",
    O.sql(
        """SELECT * FROM (SELECT utility_name AS value, count(*) AS n FROM c_corpus WHERE utility_name IS NOT NULL
        GROUP BY 1 ORDER BY 1)"""
    ),
)
def list_values(spark, folder):
    return quality.list_values(C.corpus(spark, folder), "utility_name")


@query(
    "index_stats",
    O.sql(
        """SELECT query_id, idx, count(*) AS n, round(avg(score), 6) AS avg_score, round(median(score), 6) AS median_score,
        min(score) AS min_score, max(score) AS max_score, count(*) FILTER (score >= CASE WHEN idx = 'api' THEN 0.05
        ELSE 0.15 END) AS n_above, round(count(*) FILTER (score >= CASE WHEN idx = 'api' THEN 0.05 ELSE 0.15 END) * 100.0
        / count(*), 6) AS retention_pct FROM c_scaled GROUP BY ALL"""
    ),
)
def index_stats(spark, folder):
    st = quality.index_stats(_scaled(spark, folder))
    return st.withColumns({c: F.round(c, 6) for c in ("avg_score", "median_score", "retention_pct")})


@query(
    "score_balance",
    O.sql(
        """SELECT query_id, round(m, 6) AS main_avg, round(a, 6) AS api_avg, round(CASE WHEN a > 0 THEN m / a ELSE 0 END, 6)
        AS ratio, m > 0 AND a > 0 AND m / a > 1.05 AS imbalanced FROM (SELECT query_id,
        coalesce(avg(score) FILTER (idx <> 'api'), 0) AS m, coalesce(avg(score) FILTER (idx = 'api'), 0) AS a
        FROM c_scaled GROUP BY query_id)"""
    ),
)
def score_balance(spark, folder):
    b = quality.score_balance(_scaled(spark, folder), warn=1.05)
    return b.withColumns({c: F.round(c, 6) for c in ("main_avg", "api_avg", "ratio")})


# One observation per document: which part of the hit its passages came from.
_OBS = """SELECT doc_id, source AS idx, updated_at AS ts, doc_id % 4 <> 0 AS has_inner_hits, doc_id % 6 = 0 AS has_sections,
    CASE WHEN doc_id % 5 = 0 THEN 'summary' WHEN doc_id % 3 = 0 THEN 'body' END AS body_field,
    CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 1 END AS n_passages FROM c_corpus JOIN documents USING (doc_id)"""
O.cte(
    "c_obs",
    f"""SELECT CASE WHEN idx IN ('src1', 'src2', 'src3') THEN idx || '-api' ELSE idx END AS idx, ts, has_inner_hits,
    CASE WHEN n_passages = 0 THEN 'no_content' WHEN has_inner_hits THEN 'inner_hits' WHEN has_sections THEN
    'sections.content' ELSE coalesce(body_field, 'unknown') END AS path FROM ({_OBS})""",
)
O.cte(
    "c_prof",
    """SELECT idx, CAST(sum(n) AS BIGINT) AS samples, CAST(sum(inner_n) AS BIGINT) AS inner_hits_seen,
    list({'path': path, 'n': n} ORDER BY n DESC, path) AS paths, max(seen) AS last_seen FROM (SELECT idx, path,
    count(*) AS n, count(*) FILTER (has_inner_hits) AS inner_n, max(ts) AS seen FROM c_obs GROUP BY ALL) GROUP BY idx""",
)


def observations(spark, folder):
    d = C.corpus(spark, folder).join(C.table(spark, folder, "documents").select("doc_id", "source"), "doc_id")
    i, src = F.col("doc_id"), F.col("source")
    path = quality.content_path(
        i % 4 != 0, i % 6 == 0, F.when(i % 5 == 0, "summary").when(i % 3 == 0, "body"), F.when(i % 11 == 0, 0).otherwise(1)
    )
    return d.select(
        F.when(src.isin("src1", "src2", "src3"), F.concat(src, F.lit("-api"))).otherwise(src).alias("idx"),
        F.col("updated_at").cast("timestamp").alias("ts"),
        (i % 4 != 0).alias("has_inner_hits"),
        path.alias("path"),
    )


@query(
    "schema_profile",
    O.sql(
        """SELECT idx, samples, inner_hits_seen, array_to_string(list_transform(list_sort(list_transform(paths, lambda p:
        p.path || '=' || p.n)), lambda x: x), '|') AS paths, strftime(last_seen, '%Y-%m-%d') AS last_seen,
        coalesce(list_extract(list_filter(paths, lambda p: p.path <> 'no_content'), 1).path, 'no_content') AS top_path
        FROM c_prof"""
    ),
)
def schema_profile(spark, folder):
    p = quality.schema_profile(observations(spark, folder))
    shown = F.transform(F.map_entries("paths"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return p.select(
        "idx", "samples", "inner_hits_seen", F.array_join(F.array_sort(shown), "|").alias("paths"),
        F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"), "top_path",
    )


@query(
    "reliable_sections",
    O.sql(
        """SELECT idx, round(inner_hits_seen / samples, 6) AS rate, samples >= 5 AND inner_hits_seen / samples >= 0.6
        AS reliable FROM c_prof"""
    ),
)
def reliable_sections(spark, folder):
    return quality.reliable(quality.schema_profile(observations(spark, folder))).withColumn("rate", F.round("rate", 6))


_defaults = O.lst(R.DEFAULT_PATHS)


@query(
    "preferred_paths",
    O.sql(
        f"""SELECT idx, array_to_string(CASE WHEN samples < 5 THEN {_defaults} ELSE list_concat(learned, list_filter(
        {_defaults}, lambda d: NOT list_contains(learned, d))) END, '|') AS preferred FROM (SELECT idx, samples,
        list_filter(list_transform(paths, lambda p: p.path), lambda x: x <> 'no_content') AS learned FROM c_prof)"""
    ),
)
def preferred_paths(spark, folder):
    p = quality.preferred_paths(quality.schema_profile(observations(spark, folder)))
    return p.select("idx", F.array_join("preferred", "|").alias("preferred"))


@query(
    "extraction_report",
    O.sql(
        """SELECT idx, samples, round(r, 6) AS rate, CASE WHEN samples < 5 THEN 'insufficient' WHEN r >= 0.8 THEN 'high'
        WHEN r >= 0.6 THEN 'medium' ELSE 'low' END AS reliability, idx LIKE '%api' AND samples >= 5 AND r < 0.6
        AS retry_nested FROM (SELECT *, inner_hits_seen / samples AS r FROM c_prof)"""
    ),
)
def extraction_report(spark, folder):
    p = quality.extraction_report(quality.schema_profile(observations(spark, folder)))
    return p.withColumn("rate", F.round("rate", 6))


@query(
    "unique_docs",
    O.sql(
        """SELECT query_id, count(DISTINCT doc_id) AS n_docs, count(DISTINCT doc_id) >= 70 AS rerank FROM
        (SELECT query_id, doc_id FROM c_bm25 UNION ALL SELECT query_id, doc_id FROM c_knn) GROUP BY query_id"""
    ),
)
def unique_docs(spark, folder):
    lex = lex_hits(spark, folder).select("query_id", "doc_id")
    vec = nearest.knn(C.vectors(spark, folder), C.query_vectors(spark, folder)).select("query_id", "doc_id")
    n = lex.union(vec).groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_docs"))
    return n.withColumn("rerank", F.col("n_docs") >= 70)


@query(
    "generic_penalties",
    O.sql(
        f"""SELECT query_id, count(*) FILTER ({O.contains_any("lower(section)", R.GENERIC_SECTIONS)}
        OR {O.contains_any("lower(title)", R.GENERIC_TITLES)}) AS penalties FROM (SELECT query_id, title,
        list_extract(['Global rules', 'Setup', 'Platform'], CAST(doc_id % 3 + 1 AS INT)) AS section FROM c_hits) GROUP BY query_id"""
    ),
)
def generic_penalties(spark, folder):
    h = lex_hits(spark, folder, 50, "title").withColumn("section", C.pick(["Global rules", "Setup", "Platform"], F.col("doc_id")))
    return quality.generic_penalties(h)


@query(
    "search_diagnostics",
    O.sql(
        """SELECT query_id, coalesce(b.n, 0) AS bm25_hits, coalesce(k.n, 0) AS knn_hits, coalesce(r.n, 0) AS rrf_count,
        coalesce(u.n, 0) AS unique_docs, coalesce(k.a > 0.7 AND k.n >= 8, false) AS bm25_skipped FROM c_sq
        LEFT JOIN (SELECT query_id, count(*) AS n FROM c_bm65 GROUP BY 1) b USING (query_id)
        LEFT JOIN (SELECT query_id, count(*) AS n, round(avg(score) FILTER (rank <= 8), 6) AS a FROM c_knn65 GROUP BY 1) k
        USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS n FROM c_rrf GROUP BY 1) r USING (query_id)
        LEFT JOIN (SELECT query_id, count(DISTINCT doc_id) AS n FROM (SELECT query_id, doc_id FROM c_bm65 UNION ALL
        SELECT query_id, doc_id FROM c_knn65) GROUP BY 1) u USING (query_id)"""
    ),
)
def search_diagnostics(spark, folder):
    c, q = S.Collection.load(spark, folder), C.search_queries(spark, folder)
    lex = S.lexical_search(c, q, 65)
    vec = nearest.knn(c.vectors, C.query_vectors(spark, folder), 65)
    gate = ranking.skip_lexical_gate(vec, minimum=0.7).select("query_id", "skip")
    # one pass over both lists gives all counts: a document counts once, the fused list is cut at 50
    tagged = lex.select("query_id", "doc_id", F.lit(1).alias("lex"), F.lit(0).alias("vec")).unionByName(
        vec.select("query_id", "doc_id", F.lit(0).alias("lex"), F.lit(1).alias("vec"))
    )
    per_doc = tagged.groupBy("query_id", "doc_id").agg(F.sum("lex").alias("lex"), F.sum("vec").alias("vec"))
    n = per_doc.groupBy("query_id").agg(
        F.sum("lex").alias("bm25_hits"), F.sum("vec").alias("knn_hits"), F.count(F.lit(1)).alias("unique_docs")
    )
    zero = F.lit(0).cast("long")
    return (
        q.select("query_id")
        .join(n, "query_id", "left")
        .join(gate, "query_id", "left")
        .select(
            "query_id",
            *[F.coalesce(c_, zero).alias(c_) for c_ in ("bm25_hits", "knn_hits", "unique_docs")],
            F.least(F.coalesce("unique_docs", zero), F.lit(50)).alias("rrf_count"),
            F.coalesce("skip", F.lit(False)).alias("bm25_skipped"),
        )
    )


@query(
    "text_retry",
    O.sql(
        """SELECT query_id, round(avg(CAST(f AS DOUBLE)), 6) AS rate, avg(CAST(f AS DOUBLE)) < 0.5 OR
        max(CASE WHEN rank <= 3 AND f THEN 1 ELSE 0 END) = 0 AS retry FROM (SELECT query_id, rank,
        (doc_id + query_id) % 3 <> 0 AND doc_id % 2 = 0 AS f FROM c_bm25) GROUP BY query_id"""
    ),
)
def text_retry(spark, folder):
    filled = ((F.col("doc_id") + F.col("query_id")) % 3 != 0) & (F.col("doc_id") % 2 == 0)
    h = lex_hits(spark, folder).withColumn("n_passages", filled.cast("int"))
    return quality.text_retry(h).select("query_id", F.round("rate", 6).alias("rate"), "retry")


# --------------------------------------------------------------------------------------- responses, passages
def hit_struct():
    """A document as a raw search hit: inner hits, sections or plain fields, by doc_id."""
    i = F.col("doc_id")
    lines = F.filter(F.split("text", "\n"), lambda t: X.strip(t) != "")
    null = F.lit(None).cast("string")

    def section(t, n):
        return F.struct(
            F.when(n % 2 == 0, F.concat(F.lit("Section "), (n + 1).cast("string"))).alias("title"),
            F.concat(F.lit("Heading "), (n + 1).cast("string")).alias("heading"),
            F.when(n % 3 == 0, "").otherwise(t).alias("content"),
            t.alias("text"),
        )

    secs = F.transform(lines, section)
    inner = F.transform(
        secs, lambda s, n: F.struct((1.0 / (n + 1)).alias("_score"), s.alias("_source"))
    )
    return F.struct(
        i.cast("string").alias("_id"),
        F.col("idx").alias("_index"),
        F.lit(0.5).alias("_score"),
        F.struct(
            F.col("title"), null.alias("api_name"), F.col("utility_name"), F.col("page_url"), F.col("content_type"),
            F.col("updated_at").cast("string").alias("updated_at"),
            F.when(i % 3 == 2, F.when(i % 2 == 0, F.col("text")).otherwise("")).alias("body"),
            F.when(i % 3 == 2, F.col("text")).alias("content"),
            null.alias("text"), null.alias("description"), null.alias("summary"),
            F.when(i % 3 == 1, secs).alias("sections"),
        ).alias("_source"),
        F.struct(F.struct(F.struct(F.when(i % 3 == 0, inner).alias("hits")).alias("hits")).alias("matched_sections")).alias("inner_hits"),
    )


def raw_hits(spark, folder):
    return C.corpus(spark, folder).select(hit_struct().alias("hit"))


_sect = """SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY unit_no) - 1 AS n FROM c_units"""
O.cte(
    "c_pass",
    f"""SELECT doc_id, passage_no, {O.collapse("t")} AS text, section_title, score, path, idx FROM (
    SELECT doc_id, n AS passage_no, unit_text AS t, CASE WHEN n % 2 = 0 THEN 'Section ' || (n + 1) ELSE 'Heading ' || (n + 1)
    END AS section_title, 1.0 / (n + 1) AS score, 'inner_hits' AS path, idx FROM ({_sect}) JOIN c_corpus USING (doc_id)
    WHERE doc_id % 3 = 0 AND n < 5
    UNION ALL SELECT doc_id, n, unit_text, CASE WHEN n % 2 = 0 THEN 'Section ' || (n + 1) ELSE 'Heading ' || (n + 1) END,
    0.5, 'sections.content', idx FROM ({_sect}) JOIN c_corpus USING (doc_id) WHERE doc_id % 3 = 1 AND n < 3
    UNION ALL SELECT doc_id, 0, text, NULL, 0.5, CASE WHEN doc_id % 2 = 0 THEN 'body' ELSE 'content' END, idx FROM c_corpus
    WHERE doc_id % 3 = 2) WHERE length({O.collapse("t")}) BETWEEN 80 AND 1200""",
)


@query(
    "extract_passages",
    O.sql(
        """SELECT CAST(doc_id AS VARCHAR) AS doc_id, passage_no, text, section_title, round(CAST(score AS DOUBLE), 6) AS score,
        path FROM c_pass"""
    ),
)
def extract_passages(spark, folder):
    p = passages.extract_passages(raw_hits(spark, folder))
    return p.select(
        "doc_id", F.col("passage_no").cast("long").alias("passage_no"), "text", "section_title",
        F.round("score", 6).alias("score"), "path",
    )


@query(
    "extract_paths",
    O.sql("SELECT idx, path, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM c_pass GROUP BY ALL"),
)
def extract_paths(spark, folder):
    """What the extraction feeds into the schema profile: passages per index and path."""
    p = passages.extract_passages(raw_hits(spark, folder))
    return p.groupBy("idx", "path").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query(
    "parse_hits",
    O.sql(
        """SELECT query_id, CAST(CASE WHEN query_id % 2 = 0 THEN 10 ELSE 7 END AS BIGINT) AS total, rank - 1 AS pos,
        CAST(doc_id AS VARCHAR) AS doc_id, idx, score, title, page_url FROM c_hits WHERE rank <= 10"""
    ),
)
def parse_hits(spark, folder):
    """Search responses as JSON text, read back: total as number or object, one row per hit."""
    h = lex_hits(spark, folder, 10, "idx", "title", "page_url")
    hit = F.struct(
        F.col("doc_id").cast("string").alias("_id"), F.col("idx").alias("_index"), F.col("score").alias("_score"),
        F.struct("title", "page_url").alias("_source"),
    )
    lists = h.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", hit.alias("h")))).alias("l"))
    body = F.to_json(F.transform("l", lambda x: x["h"]))
    total = F.when(F.col("query_id") % 2 == 0, '{"value":10,"relation":"eq"}').otherwise("7")
    responses = lists.select(
        "query_id",
        F.concat(F.lit('{"hits":{"total":'), total, F.lit(',"hits":'), body, F.lit("}}")).alias("response"),
    )
    p = passages.parse_response(responses)
    return p.select(
        "query_id", "total", F.col("pos").cast("long").alias("pos"), F.col("hit._id").alias("doc_id"),
        F.col("hit._index").alias("idx"), F.col("hit._score").alias("score"), F.col("hit._source.title").alias("title"),
        F.col("hit._source.page_url").alias("page_url"),
    )


@query(
    "full_body",
    O.sql(
        """SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 AND length(title) > 100 THEN title WHEN doc_id % 3 = 0 THEN text
        ELSE title || CASE WHEN title = '' THEN '' ELSE ' ' END || 'short note' END) AS body_md5 FROM c_corpus"""
    ),
)
def full_body(spark, folder):
    i, null = F.col("doc_id"), F.lit(None).cast("string")
    d = C.corpus(spark, folder)
    body = passages.full_body(
        {
            "body": F.when(i % 2 == 0, F.col("title")),
            "content": F.when(i % 3 == 0, F.col("text")),
            "text": F.when(i % 3 != 0, "short note"),
            "title": F.when(i % 3 != 0, F.col("title")).otherwise(null),
        }
    )
    return d.select("doc_id", F.md5(body).alias("body_md5"))


# ---------------------------------------------------------------------------------------------------- corpus
@query(
    "scan_corpus",
    O.sql(
        """SELECT idx, content_type, space_key, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_sections,
        CAST(sum(len_) AS BIGINT) AS n_chars FROM c_corpus JOIN (SELECT doc_id, count(*) AS n, sum(length(unit_text)) AS len_
        FROM c_units GROUP BY 1) USING (doc_id) GROUP BY ALL"""
    ),
)
def scan_corpus(spark, folder):
    """Documents, sections and characters per partition of the corpus, section counts taken inside each row."""
    lines = F.filter(F.split("text", "\n"), lambda t: X.strip(t) != "")
    d = C.corpus(spark, folder).withColumn("lines", lines)
    size = F.aggregate("lines", F.lit(0), lambda acc, t: acc + F.length(t))
    return d.groupBy("idx", "content_type", "space_key").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("lines")).alias("n_sections"), F.sum(size).alias("n_chars")
    )
