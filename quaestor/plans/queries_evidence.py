"""Registered queries: fusion variants, evidence assembly, evaluation and verification."""

from pyspark.sql import functions as F

from quaestor.functions import rules as R
from quaestor.functions import text as X
from quaestor.operators import evaluate, evidence, fusion
from quaestor.plans import oracle as O
from quaestor.plans import search as S
from quaestor.plans.queries_rank import _scaled
from quaestor.plans.queries_search import R_COLS, lex_hits
from quaestor.plans.queries_text import decompose_sql, relevance_sql, utility_case
from quaestor.plans.registry import query
from quaestor.session import settle
from quaestor.sources import corpus as C


def fused(spark, folder):
    c = S.Collection.load(spark, folder)
    return c, S.hybrid_search(c, C.search_queries(spark, folder), C.query_vectors(spark, folder))


# ---------------------------------------------------------------------------------------------------- fusion
O.cte("c_named", f"SELECT query_id, query, {utility_case('lower(query)', O.plain('lower(query)'))} AS utility FROM c_sq")


@query(
    "anchored_fusion",
    O.sql(
        """SELECT query_id, doc_id, anchored, weighted, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY weighted DESC, anchored DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, 1 AS anchored,
        round(least(score * 1.5, 0.95), 9) AS weighted FROM c_scaled JOIN (SELECT query_id, utility FROM c_named)
        USING (query_id) JOIN (SELECT doc_id, utility_name FROM c_corpus) USING (doc_id) WHERE utility_name = utility UNION ALL
        SELECT query_id, doc_id, 0, score FROM c_scaled)) WHERE rank <= 20""".replace("1 AS anchored", "CAST(1 AS BIGINT) AS anchored")
    ),
)
def anchored_fusion(spark, folder):
    """Hits on documents of the utility that the query names are the anchored ones."""
    h = _scaled(spark, folder)
    named = C.search_queries(spark, folder).select("query_id", X.recognize_utility(F.col("query")).alias("utility"))
    own = C.corpus(spark, folder).select("doc_id", F.col("utility_name").alias("utility"))
    anchored = h.join(named, "query_id").join(own, ["doc_id", "utility"], "left_semi")
    return fusion.anchored_fusion(anchored, h, 20)


@query(
    "calibrated_merge",
    O.sql(
        """SELECT query_id, doc_id, source, calibrated, row_number() OVER (PARTITION BY query_id ORDER BY calibrated DESC,
        doc_id) AS rank, count(*) OVER (PARTITION BY query_id, source) AS n_in_source FROM (SELECT query_id, doc_id,
        CASE WHEN idx = 'api' THEN title || ' (API Docs)' ELSE title END AS source, round(CASE WHEN idx = 'api' THEN
        least(score * 0.3 * 2.5, 0.95) ELSE score * 0.3 * 1.2 END, 9) AS calibrated, CASE WHEN idx = 'api'
        THEN score * 0.3 ELSE score * 0.3 * 1.2 END AS weighted, idx FROM c_scaled)
        WHERE round(weighted, 6) >= CASE WHEN idx = 'api' THEN 0.05 ELSE 0.15 END"""
    ),
)
def calibrated_merge(spark, folder):
    from pyspark.sql import Window

    h = _scaled(spark, folder).withColumn("score", F.col("score") * 0.3)
    api = F.col("idx") == "api"
    weighted = F.col("score") * F.when(api, 1.0).otherwise(1.2)
    kept = h.where(F.round(weighted, 6) >= F.when(api, 0.05).otherwise(0.15)).withColumn(
        "calibrated", F.round(fusion.calibrate(F.col("score"), F.col("idx")), 9)
    )
    source = F.when(api, F.concat(F.col("title"), F.lit(" (API Docs)"))).otherwise(F.col("title"))
    order = Window.partitionBy("query_id").orderBy(F.desc("calibrated"), "doc_id")
    return kept.select(
        "query_id", "doc_id", source.alias("source"), "calibrated", F.row_number().over(order).alias("rank")
    ).withColumn("n_in_source", F.count(F.lit(1)).over(Window.partitionBy("query_id", "source")))


O.cte(
    "c_sides",
    """SELECT query_id, CAST(1 + doc_id % 2 AS BIGINT) AS side, doc_id, row_number() OVER
    (PARTITION BY query_id, doc_id % 2 ORDER BY rank) + CASE WHEN query_id % 3 = 0 AND doc_id % 2 = 1 THEN 20 ELSE 0 END AS rank,
    score, text FROM c_scaled""",
)


def comparison_sides(spark, folder):
    """Two sides per query: even and odd documents; one side of every third query starts far down."""
    from pyspark.sql import Window

    h = _scaled(spark, folder)
    w = Window.partitionBy("query_id", F.col("doc_id") % 2).orderBy("rank")
    late = F.when((F.col("query_id") % 3 == 0) & (F.col("doc_id") % 2 == 1), 20).otherwise(0)
    return h.select(
        "query_id", (1 + F.col("doc_id") % 2).alias("side"), "doc_id", (F.row_number().over(w) + late).alias("rank"),
        "score", "text",
    )


def comparison_merge_sql(name: str, sides: str) -> str:
    """SQL of the merge of sides(query_id, side, doc_id, rank); name is that of its intermediate expression."""
    O.cte(
        name,
        f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, side, doc_id) AS position FROM (SELECT query_id,
        side, doc_id, round(1.0 / (rank + 60) * CASE WHEN side = 1 THEN 1.1 ELSE 1 END, 9) AS score FROM {sides})""",
    )
    missing = f"""SELECT *, CASE WHEN count(*) FILTER (position <= 6 AND side = 1) OVER (PARTITION BY query_id) = 0 THEN 1
        WHEN count(*) FILTER (position <= 6 AND side = 2) OVER (PARTITION BY query_id) = 0 THEN 2 END AS missing FROM {name}"""
    swap = f"""SELECT *, min(position) FILTER (side = missing AND position > 6) OVER (PARTITION BY query_id) AS sub FROM ({missing})"""
    return f"""SELECT query_id, side, doc_id, score, position FROM ({swap}) WHERE NOT (position = 6 AND sub IS NOT NULL) UNION ALL
        SELECT query_id, side, doc_id, score, 6 FROM ({swap}) WHERE position = sub"""


@query("comparison_merge", O.sql(comparison_merge_sql("c_cmerge", "c_sides")))
def comparison_merge(spark, folder):
    m = fusion.comparison_merge(comparison_sides(spark, folder))
    return m.select("query_id", "side", "doc_id", "score", "position")


@query(
    "time_decay",
    O.sql(
        """SELECT query_id, doc_id, round(score * pow(0.5, date_diff('day', updated_at, DATE '2025-01-01') / 120.0), 6)
        AS decayed FROM c_hits"""
    ),
)
def time_decay(spark, folder):
    h = lex_hits(spark, folder, 50, "updated_at")
    return h.select(
        "query_id", "doc_id", F.round(fusion.time_decay(F.col("score"), F.col("updated_at"), "2025-01-01"), 6).alias("decayed")
    )


@query(
    "tfidf_pair",
    O.sql(
        f"""SELECT query_id, doc_id, round(sum(a * b * w * w) / (sqrt(sum(a * a * w * w)) * sqrt(sum(b * b * w * w))), 6)
        AS similarity FROM (SELECT query_id, doc_id, term, a, b, CASE WHEN a > 0 AND b > 0 THEN 1.0 ELSE 1 + ln(1.5) END
        AS w FROM (SELECT query_id, doc_id, term, CAST(count(*) FILTER (side = 'q') AS DOUBLE) AS a,
        CAST(count(*) FILTER (side = 'd') AS DOUBLE) AS b FROM (SELECT query_id, doc_id, 'q' AS side,
        unnest({O.index_tokens("query")}) AS term FROM c_hits WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, 'd',
        unnest({O.index_tokens("text")}) FROM c_hits WHERE rank <= 10) GROUP BY ALL)) GROUP BY ALL"""
    ),
)
def tfidf_pair(spark, folder):
    c, q = S.Collection.load(spark, folder), C.search_queries(spark, folder)
    hits = settle(S.lexical_search(c, q, 10))
    p = fusion.tfidf_pairs(hits, c.docs, q)
    return p.withColumn("similarity", F.round("similarity", 6))


# candidates of the diversity selection, their relevance and the similarity of each to the better-ranked ones
_dt = "concat_ws(' ', title, text)"
O.cte("c_cand", f"SELECT query_id, query, doc_id, rank, score, {_dt} AS text FROM c_rrfhits")
O.cte(
    "c_candtf",
    f"""SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT doc_id, unnest({O.index_tokens("text")}) AS term
    FROM (SELECT DISTINCT doc_id, text FROM c_cand)) GROUP BY ALL""",
)
O.cte(
    "c_pairs",
    """SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM c_cand a JOIN c_cand b ON a.query_id = b.query_id
    AND b.rank < a.rank""",
)
O.cte(
    "c_sq_norm",
    "SELECT doc_id, sum(tf * tf) AS n2 FROM c_candtf GROUP BY 1",
)
O.cte(
    "c_sim",
    """SELECT a, b, CASE WHEN dot = 0 OR dot IS NULL THEN 0 ELSE dot / sqrt((sa + (na.n2 - sa) * pow(1 + ln(1.5), 2)) *
    (sb + (nb.n2 - sb) * pow(1 + ln(1.5), 2))) END AS sim FROM c_pairs LEFT JOIN (SELECT p.a AS a, p.b AS b,
    sum(x.tf * y.tf) AS dot, sum(x.tf * x.tf) AS sa, sum(y.tf * y.tf) AS sb FROM c_pairs p JOIN c_candtf x ON x.doc_id = p.a
    JOIN c_candtf y ON y.doc_id = p.b AND y.term = x.term GROUP BY 1, 2) USING (a, b)
    JOIN c_sq_norm na ON na.doc_id = a JOIN c_sq_norm nb ON nb.doc_id = b""",
)


def candidates(spark, folder):
    c, f = fused(spark, folder)
    return S.diversity_candidates(c, C.search_queries(spark, folder), settle(f.select(R_COLS)))


@query(
    "pair_similarity",
    O.sql(
        """SELECT query_id, doc_id, arg_min(b, (-sim, br)) AS nearest_doc_id, max(sim) AS similarity FROM (SELECT x.query_id,
        x.doc_id, y.doc_id AS b, y.rank AS br, round(sim, 6) AS sim FROM c_cand x JOIN c_cand y ON x.query_id = y.query_id
        AND y.rank < x.rank JOIN c_sim s ON s.a = x.doc_id AND s.b = y.doc_id) GROUP BY ALL"""
    ),
)
def pair_similarity(spark, folder):
    return fusion.nearest_better(candidates(spark, folder))


O.cte("c_candrel", relevance_sql("c_cand").replace("round(coalesce(", "(coalesce(").replace(", 0), 6) AS relevance", ", 0)) AS relevance"))
O.cte(
    "c_steps",
    """SELECT c.query_id, c.doc_id, c.rank, c.score, relevance, sims FROM c_cand c JOIN c_candrel USING (query_id, doc_id)
    LEFT JOIN (SELECT x.query_id, x.doc_id, list({'d': y.doc_id, 's': sim}) AS sims FROM c_cand x JOIN c_cand y
    ON x.query_id = y.query_id AND y.rank < x.rank JOIN c_sim s ON s.a = x.doc_id AND s.b = y.doc_id GROUP BY ALL)
    USING (query_id, doc_id)""",
)
O.cte(
    "c_mmr_r",
    """SELECT query_id, CAST(0 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS chosen, CAST(NULL AS BIGINT) AS doc_id,
    CAST(0 AS DOUBLE) AS max_sim, CAST(0 AS DOUBLE) AS mmr, false AS selected FROM (SELECT DISTINCT query_id FROM c_cand)
    UNION ALL SELECT query_id, pos, CASE WHEN keep THEN list_append(chosen, doc_id) ELSE chosen END, doc_id, ms, mmr, keep
    FROM (SELECT *, mmr > 0 OR len(chosen) < 3 AS keep FROM (SELECT *, 0.75 * relevance + 0.3 * score - 0.25 * ms AS mmr FROM
    (SELECT r.query_id, s.rank AS pos, r.chosen, s.doc_id, s.relevance, s.score, CAST(coalesce(list_max(list_transform(
    list_filter(s.sims, lambda x: list_contains(r.chosen, x.d)), lambda x: x.s)), 0) AS DOUBLE) AS ms FROM c_mmr_r r
    JOIN c_steps s ON s.query_id = r.query_id AND s.rank = r.pos + 1 WHERE len(r.chosen) < 36)))""",
)


@query(
    "mmr_select",
    O.sql(
        """SELECT query_id, doc_id, pos AS rank, round(max_sim, 6) AS max_sim, round(mmr, 6) AS mmr, selected
        FROM c_mmr_r WHERE pos > 0"""
    ).replace("c_mmr_r AS MATERIALIZED", "c_mmr_r AS"),
)
def mmr_select(spark, folder):
    return fusion.mmr(candidates(spark, folder))


# -------------------------------------------------------------------------------------------------- evidence
O.cte(
    "c_cls",
    "SELECT query_id, doc_id, title, text, score, unnest(CASE WHEN len(f) > 0 THEN f ELSE ['info'] END) AS section FROM ("
    "SELECT *, list_filter(["
    + ", ".join(f"CASE WHEN {O.contains_any('b', ws)} THEN '{sec}' END" for sec, ws in R.SECTION_WORDS.items())
    + "], lambda x: x IS NOT NULL) AS f FROM (SELECT *, lower(title) || ' ' || lower(text) AS b FROM c_rrfhits))",
)
O.cte(
    "c_ev",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY strength DESC, section DESC) AS section_rank
    FROM (SELECT query_id, section, count(*) AS n, avg(score) AS avg_score, round(count(*) * avg(score), 6) AS strength
    FROM c_cls GROUP BY ALL HAVING avg(score) >= 0.005)) WHERE section_rank <= 4""",
)


def fused_docs(spark, folder):
    c, f = fused(spark, folder)
    return c.hydrate(f.select(R_COLS), "title", "text", "page_url", "idx")


@query("classify_sections", O.sql("SELECT query_id, doc_id, section FROM c_cls"))
def classify_sections(spark, folder):
    return evidence.classify_sections(fused_docs(spark, folder)).select("query_id", "doc_id", "section")


@query(
    "evidence_sections",
    O.sql(
        """SELECT query_id, section, n, round(avg_score, 9) AS avg_score, strength, section_rank, CASE WHEN len(names) = 1
        THEN 'single_section' WHEN list_contains(names, 'api') AND list_contains(names, 'procedure') THEN 'api_procedure'
        WHEN list_contains(names, 'troubleshoot') THEN 'troubleshooting_focused' ELSE 'multi_section' END AS strategy
        FROM (SELECT *, list(section) OVER (PARTITION BY query_id) AS names FROM c_ev)"""
    ),
)
def evidence_sections(spark, folder):
    e = evidence.evidence_sections(evidence.classify_sections(fused_docs(spark, folder)))
    return e.withColumn("avg_score", F.round("avg_score", 9))


_sec_no = O.lookup({k: i for i, k in enumerate(R.SECTION_ORDER)}, "section")


@query(
    "briefing",
    O.sql(
        f"""SELECT query_id, coalesce(md, 'No sufficient evidence found to compose a structured briefing.') AS markdown
        FROM c_sq LEFT JOIN (SELECT query_id, string_agg('## ' || {O.lookup(R.SECTION_TITLES, "section")} || chr(10) || chr(10)
        || body || chr(10), chr(10) ORDER BY {_sec_no}) AS md FROM (SELECT query_id, section, string_agg('**' || title || ':**'
        || chr(10) || {O.clip("t", 500)}, chr(10) || chr(10) ORDER BY n) AS body FROM (SELECT query_id, section, title,
        {O.strip("text")} AS t, row_number() OVER (PARTITION BY query_id, section ORDER BY score DESC, doc_id) AS n FROM c_cls
        JOIN (SELECT query_id, section FROM c_ev) USING (query_id, section)) WHERE n <= 3 GROUP BY ALL) GROUP BY query_id)
        USING (query_id)"""
    ),
)
def briefing(spark, folder):
    return evidence.briefing(C.search_queries(spark, folder), settle(fused_docs(spark, folder)))


@query(
    "results_context",
    O.sql(
        f"""SELECT query_id, string_agg('[' || doc_id || ']: ' || {O.clip("text", 400)}, chr(10) || chr(10) ORDER BY rank)
        AS context FROM c_hits WHERE rank <= 6 GROUP BY query_id"""
    ),
)
def results_context(spark, folder):
    return evidence.results_context(lex_hits(spark, folder, 10, "text"))


def _list_line(kind, value, no):
    return f"""CASE WHEN {kind} = 'apis' THEN {no} || '. ' ELSE {O.lookup(R.LIST_PREFIXES, kind, "'- '")} END || {value} || chr(10)"""



@query(
    "list_answer",
    O.sql(
        f"""SELECT list_type, {O.lookup(R.LIST_HEADINGS, "list_type", "'Available ' || list_type || ':' || chr(10) || chr(10)")}
        || string_agg({_list_line("list_type", "v", "n")}, '' ORDER BY v) || {O.lookup(R.LIST_FOLLOW_UPS, "list_type", "''")}
        AS answer FROM (SELECT list_type, v, row_number() OVER (PARTITION BY list_type ORDER BY v) AS n FROM (
        SELECT DISTINCT 'apis' AS list_type, 'API ' || content_type AS v FROM c_corpus UNION
        SELECT DISTINCT 'utilities', utility_name FROM c_corpus WHERE utility_name IS NOT NULL UNION
        SELECT DISTINCT 'products', space_key FROM c_corpus UNION SELECT DISTINCT 'apgs', acl_hash FROM c_corpus))
        GROUP BY list_type"""
    ),
)
def list_answer(spark, folder):
    """Answers to list requests from the values each field of the corpus takes."""
    docs = C.corpus(spark, folder)
    fields = {
        "apis": F.concat(F.lit("API "), F.col("content_type")), "utilities": F.col("utility_name"),
        "products": F.col("space_key"), "apgs": F.col("acl_hash"),
    }
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("list_type"), v.alias("value")) for k, v in fields.items()]))
    values = docs.select(pairs.alias("p")).select("p.*").where(F.col("value").isNotNull()).distinct()
    return evidence.list_answer(values)


# -------------------------------------------------------------------------------------------------- coverage
O.cte("c_subq", decompose_sql("c_sq"))
O.cte("c_top12", "SELECT query_id, doc_id, rank, text, title, page_url FROM c_hits WHERE rank <= 12")
_aw = " + ".join(f"CASE WHEN {O.has('p', p)} THEN {R.ACTION_WEIGHTS[n]} ELSE 0 END" for n, p in R.ACTION_PATTERNS.items())
_act = " OR ".join(O.has("p", p) for p in R.ACTION_PATTERNS.values())
O.cte(
    "c_feat",
    f"""SELECT doc_id, CAST({_aw} AS DOUBLE) AS w, {_act} AS actionable FROM
    (SELECT DISTINCT doc_id, {O.plain("text")} AS p FROM c_top12)""",
)
O.cte(
    "c_pt",
    f"""SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS n FROM (SELECT doc_id, unnest({O.tokens("text")}) AS term FROM
    (SELECT DISTINCT doc_id, text FROM c_top12)) GROUP BY ALL""",
)
O.cte(
    "c_mat",
    f"""SELECT query_id, subq_id, doc_id, rank, round(1 / (1 + exp(-(least(1, greatest(0, coalesce(sum(n / (n + 1.2)) /
    any_value(nq), 0))) + any_value(w)))), 6) AS a FROM (SELECT s.query_id, s.subq_id, t.doc_id, t.rank, s.term, s.nq, f.w,
    coalesce(p.n, 0) AS n FROM (SELECT query_id, subq_id, CAST(len(ts) AS DOUBLE) AS nq, unnest(ts) AS term FROM (SELECT query_id,
    subq_id, list_distinct({O.tokens("subquery")}) AS ts FROM c_subq)) s JOIN c_top12 t USING (query_id) JOIN c_feat f
    ON f.doc_id = t.doc_id LEFT JOIN c_pt p ON p.doc_id = t.doc_id AND p.term = s.term) GROUP BY ALL""".replace(
        "GROUP BY ALL", "GROUP BY query_id, subq_id, doc_id, rank"
    ),
)


def matrix(spark, folder):
    h = lex_hits(spark, folder, 12, "text").select("query_id", "doc_id", "rank", "text")
    h = settle(h)
    return h, settle(evaluate.answerability(evaluate.subqueries(C.search_queries(spark, folder)), h))


@query("answerability", O.sql("SELECT query_id, subq_id, doc_id, rank, a FROM c_mat"))
def answerability(spark, folder):
    return matrix(spark, folder)[1]


@query(
    "answerability_unscored",
    O.sql(
        """SELECT query_id, subq_id, doc_id, rank, round(1 / (1 + exp(-0.5 * w)), 6) AS a FROM c_subq
        JOIN c_top12 USING (query_id) JOIN c_feat USING (doc_id)"""
    ),
)
def answerability_unscored(spark, folder):
    h = lex_hits(spark, folder, 12, "text").select("query_id", "doc_id", "rank", "text")
    return evaluate.answerability(evaluate.subqueries(C.search_queries(spark, folder)), h, scored=False)


O.cte(
    "c_recall",
    """SELECT query_id, avg(CASE WHEN best >= 0.7 THEN 1.0 ELSE 0 END) AS strict, avg(CASE WHEN best >= 0.25 THEN 1.0 ELSE 0
    END) AS recall FROM (SELECT query_id, subq_id, max(a) AS best FROM c_mat GROUP BY ALL) GROUP BY query_id""",
)


@query(
    "aspect_recall",
    O.sql("SELECT query_id, round(recall, 6) AS recall, round(strict, 6) AS strict_recall FROM c_recall"),
)
def aspect_recall(spark, folder):
    """Recall at the default threshold and at one above one half."""
    _, m = matrix(spark, folder)
    best = m.groupBy("query_id", "subq_id").agg(F.max("a").alias("a"))  # one row per aspect serves both thresholds
    loose = evaluate.aspect_recall(best).select("query_id", F.round("recall", 6).alias("recall"))
    strict = evaluate.aspect_recall(best, tau=0.7).select("query_id", F.round("recall", 6).alias("strict_recall"))
    return loose.join(strict, "query_id")


O.cte(
    "c_ndcg",
    """SELECT query_id, dcg / coalesce(nullif(idcg, 0), 1) AS ndcg FROM (SELECT query_id, sum(pow(0.5, seen) * a /
    log2(1 + rank)) AS dcg FROM (SELECT *, coalesce(sum(CASE WHEN a > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, subq_id
    ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM c_mat) GROUP BY 1) JOIN
    (SELECT query_id, sum(pow(0.5, (r - 1) // m) * best / log2(1 + r)) AS idcg FROM (SELECT query_id, best, m,
    unnest(range(i, n + 1, m)) AS r FROM (SELECT query_id, best, row_number() OVER (PARTITION BY query_id ORDER BY best DESC,
    subq_id) AS i, count(*) OVER (PARTITION BY query_id) AS m FROM (SELECT query_id, subq_id, max(a) AS best FROM c_mat
    GROUP BY ALL)) JOIN (SELECT query_id, count(DISTINCT rank) AS n FROM c_mat GROUP BY 1) USING (query_id)) GROUP BY 1)
    USING (query_id)""",
)


@query("alpha_ndcg", O.sql("SELECT query_id, round(ndcg, 6) AS ndcg FROM c_ndcg"))
def alpha_ndcg(spark, folder):
    _, m = matrix(spark, folder)
    return evaluate.alpha_ndcg(m).withColumn("ndcg", F.round("ndcg", 6))


O.cte(
    "c_picks",
    """SELECT query_id, subq_id, doc_id, rank, a FROM (SELECT *, row_number() OVER (PARTITION BY query_id, subq_id
    ORDER BY a DESC, rank) AS n FROM c_mat) WHERE n = 1 AND a >= 0.25""",
)


@query("aspect_picks", O.sql("SELECT query_id, subq_id, doc_id, rank, a FROM c_picks"))
def aspect_picks(spark, folder):
    return evaluate.aspect_picks(matrix(spark, folder)[1])


@query(
    "coverage_gate",
    O.sql(
        """SELECT query_id, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg, n_actionable, coalesce(n_selected, 0) AS
        n_selected, (recall >= 0.6 OR ndcg >= 0.4) AND n_actionable >= 3 AS gate_pass FROM c_recall JOIN c_ndcg USING (query_id)
        JOIN (SELECT query_id, count(*) FILTER (actionable) AS n_actionable FROM c_top12 JOIN c_feat USING (doc_id) GROUP BY 1)
        USING (query_id) LEFT JOIN (SELECT query_id, count(DISTINCT doc_id) AS n_selected FROM c_picks GROUP BY 1)
        USING (query_id)"""
    ),
)
def coverage_gate(spark, folder):
    h, m = matrix(spark, folder)
    g = evaluate.coverage_gate(m, h)
    return g.withColumns({c: F.round(c, 6) for c in ("recall", "ndcg")})


# ---------------------------------------------------------------------------------------------- verification
# An answer is an assistant turn, its question the turn before, its context the text of that question's conversation.
O.cte(
    "c_vans",
    """SELECT conv_id || '-' || turn AS query_id, conv_id, turn, q AS query, CASE turn % 7 WHEN 1 THEN text || ' ' || 'I cannot find it'
    WHEN 3 THEN text || '...' WHEN 5 THEN '[doc#setup-guide] ' || text || ' Customer interaction utility CIU [2] is shown here in full.'
    ELSE text END AS answer, coalesce(p2, '') || ' ' || text AS context, CASE conv_id % 4 WHEN 0 THEN 'Customer Interaction Utility'
    WHEN 1 THEN 'Account Utility' WHEN 2 THEN 'Digital The events' END AS utility, turn % 2 = 1 AS how_to FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id
    ORDER BY turn) AS q, lag(text, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS p2 FROM conversations)
    WHERE role = 'assistant'""",
)


def graded_answers(spark, folder):
    from quaestor.operators.ranking import previous_turn

    t = C.table(spark, folder, "conversations")
    two = t.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("text").alias("p2_text"))
    j = previous_turn(t, 1, "text").where(F.col("role") == "assistant").join(two, ["conv_id", "turn"], "left")
    answer = (
        F.when(F.col("turn") % 7 == 1, F.concat(F.col("text"), F.lit(" I cannot find it")))
        .when(F.col("turn") % 7 == 3, F.concat(F.col("text"), F.lit("...")))
        .when(
            F.col("turn") % 7 == 5,
            F.concat(F.lit("[doc#setup-guide] "), F.col("text"), F.lit(" Customer interaction utility CIU [2] is shown here in full.")),
        )
        .otherwise(F.col("text"))
    )
    return j.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"),
        F.col("p1_text").alias("query"),
        answer.alias("answer"),
        F.concat(F.coalesce("p2_text", F.lit("")), F.lit(" "), F.col("text")).alias("context"),
        F.when(F.col("conv_id") % 4 == 0, "Customer Interaction Utility")
        .when(F.col("conv_id") % 4 == 1, "Account Utility")
        .when(F.col("conv_id") % 4 == 2, "Digital The events")
        .alias("utility"),
        (F.col("turn") % 2 == 1).alias("how_to"),
        "conv_id",
    )


def _ww(x, n):
    return f"list_distinct(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]{{{n},}}'))"


O.cte(
    "c_chk",
    f"""SELECT query_id, length(s) > 10 AS has_content, NOT {O.contains_any("lower(answer)", R.ERROR_PHRASES)} AS not_error,
    length(context) >= 50 AND len(list_intersect(cc, ac)) >= greatest(3, len(cc) * 0.1) AS contextual,
    coalesce(len(list_intersect(qq, aq)) >= greatest(1, len(qq) * 0.3), false) AS relevant, NOT (length(s) < 20 OR
    {O.contains_any("right(lower(s), 50)", R.TRUNCATION_MARKS)}) AS complete FROM (SELECT *, {O.strip("answer")} AS s,
    {_ww("answer", 4)} AS ac, {_ww("context", 4)} AS cc, {_ww("answer", 3)} AS aq, {_ww("query", 3)} AS qq FROM c_vans)""",
)


@query(
    "verify_answers",
    O.sql(
        """SELECT *, (CAST(has_content AS INT) + CAST(not_error AS INT) + CAST(contextual AS INT) + CAST(relevant AS INT)
        + CAST(complete AS INT)) / 5.0 AS confidence FROM c_chk"""
    ),
)
def verify_answers(spark, folder):
    v = evaluate.verify_answers(graded_answers(spark, folder))
    return v.select("query_id", "has_content", "not_error", "contextual", "relevant", "complete", "confidence")


def _count_sql(x, w):
    return f"((length({x}) - length(replace({x}, {O.s(w)}, ''))) // {len(w)})"


def utility_relevance_sql(answer: str, utility: str) -> str:
    low, n, name = f"lower({answer})", f"len({O.words(answer)})", f"lower(trim({utility}))"
    topics = [
        (f"{name} = {O.s(known.lower())}", "(" + " + ".join(_count_sql(low, t) for t in terms) + ")")
        for known, terms in R.UTILITY_TOPICS.items()
    ]
    count = lambda w: f"((length({low}) - length(replace({low}, {w}, ''))) // greatest(length({w}), 1))"
    initials = f"array_to_string(list_transform(string_split({name}, ' '), lambda w: w[1]), '')"
    total = f"{count(name)} + {count(initials)} + {O.case(topics, '0')}"
    score = f"least(1.0, least(1.0, ({total}) / greatest({n} / 20.0, 1.0)) + CASE WHEN {count(name)} > 0 THEN 0.3 ELSE 0 END)"
    return f"CAST(CASE WHEN {utility} IS NULL THEN 1.0 ELSE {score} END AS DOUBLE)"


@query(
    "utility_relevance",
    O.sql(f"SELECT query_id, round({utility_relevance_sql('answer', 'utility')}, 6) AS relevance FROM c_vans"),
)
def utility_relevance(spark, folder):
    a = graded_answers(spark, folder)
    return a.select("query_id", F.round(evaluate.utility_relevance(F.col("answer"), F.col("utility")), 6).alias("relevance"))


# Results behind an answer: the best five documents of a search for its question; paths name some procedures.
_PATHS = ["/setup/intro", "/reference", "/guide/steps", "/faq", "/other", "/about"]
O.bm25_ctes("c_vq", "c_units", "c_vans", True)
O.cte("c_vbest", O.ranked("(SELECT query_id, doc_id, max(score) AS score FROM c_vq_pu GROUP BY ALL)", 5))
O.cte(
    "c_vhits",
    f"""SELECT query_id, rank, doc_id, title, text, {O.pick(_PATHS, "doc_id")} AS path FROM c_vbest JOIN c_corpus USING (doc_id)""",
)


def answer_hits(spark, folder, answers=None):
    """query_id, rank, doc_id, title, text, path of the best five documents for each answer's question, with the answer if given."""
    c = S.Collection.load(spark, folder)
    hits = S.lexical_search(c, graded_answers(spark, folder).select("query_id", "query"), 5)
    hits = hits.join(answers.select("query_id", "answer"), "query_id") if answers is not None else hits
    path = C.pick(_PATHS, F.col("doc_id")).alias("path")
    return c.hydrate(hits, "title", "text").select("query_id", "rank", "doc_id", "title", "text", path, *(["answer"] if answers is not None else []))


def _anchor_terms(x):
    return " + ".join(f"CAST(contains(lower({x}), {O.s(t)}) AS INT)" for t in R.ANCHOR_TERMS)


O.cte(
    "c_anch",
    f"""SELECT query_id, CAST(in_c + coalesce(in_h, 0) AS BIGINT) AS n_anchors FROM (SELECT query_id, len(list_filter(
    regexp_extract_all(answer, '\\[([^\\]]+)\\]', 1), lambda c: contains(c, '#') AND
    {O.contains_any("lower(substr(c, instr(c, '#') + 1))", R.ANCHOR_TERMS)})) AS in_c FROM c_vans) LEFT JOIN
    (SELECT query_id, sum({_anchor_terms("path")}) AS in_h FROM c_vhits WHERE rank <= 3 GROUP BY 1) USING (query_id)""",
)


@query("anchor_check", O.sql("SELECT query_id, n_anchors, n_anchors > 0 AS passed FROM c_anch"))
def anchor_check(spark, folder):
    return evaluate.anchor_check(graded_answers(spark, folder), answer_hits(spark, folder))


O.cte(
    "c_ground",
    f"""SELECT query_id, len(list_intersect(aw, coalesce(ws, CAST([] AS VARCHAR[])))) / greatest(len(aw), 1) AS grounding
    FROM (SELECT query_id, list_distinct({O.words("lower(answer)")}) AS aw FROM c_vans) LEFT JOIN (SELECT query_id,
    list_distinct(flatten(list(w))) AS ws FROM (SELECT query_id, {O.words("lower(text)")} AS w FROM c_vhits
    WHERE rank <= 5) GROUP BY 1) USING (query_id)""",
)
O.cte(
    "c_cov",
    f"""SELECT query_id, how_to, answer, len(c) > 0 AS hc, len(list_filter(ss, lambda x: len(list_filter(c, lambda y:
    contains(x, y))) > 0)) / greatest(len(ss), 1) AS cov, {utility_relevance_sql("answer", "utility")} AS ur FROM (SELECT *,
    regexp_extract_all(answer, '\\[([^\\]]+)\\]', 1) AS c, list_filter(list_transform(string_split_regex(answer, '[.!?]+'),
    lambda p: {O.strip("p")}), lambda x: length(x) > 20 AND NOT starts_with(x, '**') AND NOT starts_with(x, '#')
    AND NOT starts_with(x, '- ')) AS ss FROM c_vans)""",
)
O.cte(
    "c_ver",
    """SELECT query_id, answer, hc AS has_citations, cov, grounding, ur, NOT how_to OR n_anchors > 0 AS ok, round(CASE WHEN hc
    THEN 0.25 ELSE 0 END + 0.30 * cov + CASE WHEN NOT how_to OR n_anchors > 0 THEN 0.2 ELSE 0.1 END + 0.15 *
    least(grounding * 2, 1) + 0.10 * ur, 6) AS score FROM c_cov JOIN c_ground USING (query_id) JOIN c_anch USING (query_id)""",
)


@query(
    "verify_citations",
    O.sql(
        """SELECT query_id, CAST(score AS DOUBLE) AS score, has_citations, round(cov, 6) AS coverage, round(grounding, 6) AS
        grounding, round(ur, 6) AS utility_score, ok AS anchor_ok, score < 0.65 OR cov < 0.6 OR NOT ok AS needs_improvement,
        array_to_string(list_filter([CASE WHEN NOT has_citations THEN 'Add citations to support claims' WHEN cov < 0.6 THEN
        printf('Improve citation coverage: only %.1f%% of sentences have citations (need ≥%.1f%%)', cov * 100, CAST(60 AS DOUBLE)) END,
        CASE WHEN NOT ok THEN 'Include procedural anchors (setup/onboarding/configuration sections)' END,
        CASE WHEN grounding < 0.3 THEN 'Improve answer grounding to retrieved content' END,
        CASE WHEN ur < 0.7 THEN 'Ensure answer focuses on the specific utility mentioned' END], lambda x: x IS NOT NULL), '; ')
        AS suggestions FROM c_ver"""
    ),
)
def verify_citations(spark, folder):
    answers = settle(graded_answers(spark, folder))
    v = evaluate.verify_citations(answers, answer_hits(spark, folder, answers))
    return v.select(
        "query_id", "score", "has_citations", F.round("coverage", 6).alias("coverage"), F.round("grounding", 6).alias("grounding"),
        F.round("utility_score", 6).alias("utility_score"), "anchor_ok", "needs_improvement",
        F.array_join("suggestions", "; ").alias("suggestions"),
    )


@query(
    "append_sources",
    O.sql(
        """SELECT query_id, CASE WHEN NOT has_citations AND src IS NOT NULL THEN answer || chr(10) || chr(10) || '**Sources:**'
        || chr(10) || src ELSE answer END AS answer FROM c_ver LEFT JOIN (SELECT query_id, string_agg('- [' || doc_id || '] ' ||
        title || chr(10), '' ORDER BY rank) AS src FROM c_vhits WHERE rank <= 3 GROUP BY 1) USING (query_id)"""
    ),
)
def append_sources(spark, folder):
    a = graded_answers(spark, folder).select("query_id", "answer")
    top = (
        answer_hits(spark, folder)
        .where(F.col("rank") <= 3)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "title"))).alias("top"))
    )
    cited = F.size(X.citations(F.col("answer"))) > 0
    return a.join(top, "query_id", "left").select(
        "query_id", evidence.append_sources(F.col("answer"), cited, F.coalesce("top", F.array().cast("array<struct<rank:int,doc_id:bigint,title:string>>"))).alias("answer")
    )
