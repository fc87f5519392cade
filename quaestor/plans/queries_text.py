"""Registered queries: query-log and passage functions."""

from pyspark.sql import functions as F

from quaestor.functions import rules as R
from quaestor.functions import text as X
from quaestor.operators import scoring
from quaestor.plans import oracle as O
from quaestor.plans.queries_search import lex_hits
from quaestor.plans.registry import query
from quaestor.plans import search as S
from quaestor.sources import corpus as C
from quaestor.sources import rules as RF

# Words are fenced with two private-use characters so that RE2 can match whole Unicode words.
_A, _Z = "\ue000", "\ue001"


def _fence(x: str) -> str:
    return f"regexp_replace({x}, '({R.TOKEN})', '{_A}\\1{_Z}', 'g')"


def _fenced_words(phrase: str) -> str:
    return O.re.sub(r"\w+\??", lambda m: f"{_A}{m.group(0)}{_Z}", phrase)


def _unfence(x: str) -> str:
    return f"replace(replace({x}, '{_A}', ''), '{_Z}', '')"


def _log(spark, folder):
    return C.query_log(spark, folder)


_sql = _fence("query")
for _term, _name in R.SYNONYMS:
    _sql = f"regexp_replace({_sql}, '(?i){_fenced_words(_term)}', {O.s(_name)}, 'g')"


@query("normalize_query", O.sql(f"SELECT query_id, {O.collapse(_unfence(_sql))} AS normalized FROM c_qlog"))
def normalize_query(spark, folder):
    return _log(spark, folder).select("query_id", X.normalize_query(F.col("query")).alias("normalized"))


_name_of = O.lookup(X.ACRONYMS, "upper(w)")
_expanded = (
    f"array_to_string(list_transform({O.words('query')}, lambda w: coalesce({_name_of} || ' ' || upper(w), w)), ' ')"
)
_expansions = (
    f"list_filter(list_transform({O.words('query')}, lambda w: {_name_of}), lambda x: x IS NOT NULL)"
)


@query(
    "expand_acronyms",
    O.sql(
        f"""SELECT query_id, {_expanded} AS expanded, array_to_string({_expansions}, '|') AS expansions,
        CAST(len({_expansions}) AS BIGINT) AS n FROM c_qlog"""
    ),
)
def expand_acronyms(spark, folder):
    q = F.col("query")
    return _log(spark, folder).select(
        "query_id",
        X.expand_acronyms(q).alias("expanded"),
        F.array_join(X.expansions(q), "|").alias("expansions"),
        F.size(X.expansions(q)).cast("long").alias("n"),
    )


@query(
    "query_variants",
    O.sql(
        f"""SELECT query_id, CAST(unnest(range(len(v))) AS BIGINT) AS variant_no, unnest(v) AS variant FROM
        (SELECT query_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS v FROM (SELECT query_id,
        CASE WHEN len({_expansions}) > 0 THEN [query, list_extract({_expansions}, 1), {_expanded}] ELSE [query] END AS l
        FROM c_qlog))"""
    ),
)
def query_variants(spark, folder):
    v = F.posexplode(X.query_variants(F.col("query"))).alias("variant_no", "variant")
    return _log(spark, folder).select("query_id", v).withColumn("variant_no", F.col("variant_no").cast("long"))


_sql = _fence(f"array_to_string({O.words('lower(query)')}, ' ')")
for _p, _to in R.SEMANTIC_REWRITES:
    _word = _fenced_words(_p.replace("\\b", ""))
    _sql = f"regexp_replace({_sql}, '{_word}', '{_A}{_to}{_Z}', 'g')"


@query(
    "semantic_key",
    O.sql(f"SELECT semantic_key, count(*) AS n FROM (SELECT {_unfence(_sql)} AS semantic_key FROM c_qlog) GROUP BY ALL"),
)
def semantic_key(spark, folder):
    """Cache keys with the number of queries that share each."""
    return (
        _log(spark, folder)
        .groupBy(X.semantic_key(F.col("query")).alias("semantic_key"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


_kw = O.lookup(X.API_KEYWORDS, f"upper(list_extract({O.words('query')}, 1))")


@query(
    "embedding_text",
    O.sql(
        f"""SELECT query_id, concat_ws(' ', query,
        CASE WHEN len({_expansions}) > 0 THEN '(' || list_extract({_expansions}, 1) || ')' END,
        CASE WHEN len({_expansions}) > 0 THEN {_kw} END, {O.s(R.EMBEDDING_SUFFIX)}) AS embed_text FROM c_qlog"""
    ),
)
def embedding_text(spark, folder):
    return _log(spark, folder).select("query_id", X.embedding_text(F.col("query")).alias("embed_text"))


@query(
    "normalize_embed_text",
    O.sql(
        f"""SELECT doc_id, md5(CASE WHEN t = '' THEN '[empty]' ELSE t END) AS text_md5, CAST(length(t) AS BIGINT) AS n
        FROM (SELECT doc_id, {O.collapse("text")} AS t FROM c_corpus)"""
    ),
)
def normalize_embed_text(spark, folder):
    t = X.normalize_embed_text(F.col("text"))
    return C.corpus(spark, folder).select("doc_id", F.md5(t).alias("text_md5"), F.length(t).cast("long").alias("n"))


_wrap = "(?is)Given context:.*?Current question:\\s*(.*)"


@query(
    "clean_query",
    O.sql(
        f"""SELECT query_id, {O.strip(f"CASE WHEN regexp_matches(query, '{_wrap}') THEN regexp_extract(query, '{_wrap}', 1) ELSE query END")}
        AS clean FROM c_qlog"""
    ),
)
def clean_query(spark, folder):
    return _log(spark, folder).select("query_id", X.clean_query(F.col("query")).alias("clean"))


_ws = O.words("lower(query)")
_route_cases = [
    (f"{O.strip('query')} = ''", ("general", 0.0, "empty_query")),
    (
        f"len({_ws}) <= 3 AND len(list_filter({_ws}, lambda w: list_contains({O.lst(R.ROUTER_ACRONYMS)}, "
        "regexp_replace(w, '^[.,?!]+|[.,?!]+$', '', 'g')))) > 0",
        ("general", 0.9, "utility_acronym"),
    ),
]
for _n, _c, _ps in R.ROUTES:
    _route_cases += [(O.has("p", _p, ci=True), (_n, _c, f"{_n}_pattern: {_p}")) for _p in _ps]


@query(
    "route_queries",
    O.sql(
        "SELECT query_id, "
        + ", ".join(
            f"CAST({O.case([(cond, O.s(v[i])) for cond, v in _route_cases], O.s(d))} AS {t}) AS {name}"
            for i, (name, t, d) in enumerate(
                [("route", "VARCHAR", "general"), ("confidence", "DOUBLE", 0.5), ("pattern", "VARCHAR", "default")]
            )
        )
        + f" FROM (SELECT *, {O.plain('query')} AS p FROM c_qlog)"
    ),
)
def route_queries(spark, folder):
    return _log(spark, folder).select("query_id", X.route(F.col("query")).alias("r")).select("query_id", "r.*")


_t2 = f"{R.TOKEN}(?:\\s+{R.TOKEN})?"
_start = "(?:^|[^\\p{L}\\p{N}_])"
_cmp = [
    f"(?i)({_t2})\\s+(?:vs|versus)\\s+({_t2})",
    f"(?i){_start}difference\\s+between\\s+({_t2})\\s+and\\s+({_t2})",
    f"(?i){_start}compare\\s+({_t2})\\s+(?:and|with)\\s+({_t2})",
]
O.cte(
    "c_cmp",
    "SELECT * FROM (SELECT query_id, query, "
    + ", ".join(
        O.case([(f"regexp_matches(query, '{p}')", f"trim(regexp_extract(query, '{p}', {g}))") for p in _cmp], "NULL")
        + f" AS entity{g}"
        for g in (1, 2)
    )
    + " FROM c_qlog) WHERE entity1 IS NOT NULL",
)


@query("compare_entities", O.sql("SELECT query_id, entity1, entity2 FROM c_cmp"))
def compare_entities(spark, folder):
    e = _log(spark, folder).select("query_id", X.compare_entities(F.col("query")).alias("e"))
    return e.where(F.col("e").isNotNull()).select("query_id", "e.*")


_w1, _w2 = (f"list_extract(ws, {i})" for i in (1, 2))
_definitional = (
    f"coalesce(len(ws) <= 3 OR ({_w1} = 'what' AND {_w2} IN ('is', 'are')) OR {_w1} IN ('define', 'definition') "
    "OR list_contains(ws, 'meaning') OR list_contains(ws, 'stands'), false)"
)


@query(
    "is_definitional",
    O.sql(f"SELECT query_id, {_definitional} AS definitional FROM (SELECT query_id, {_ws} AS ws FROM c_qlog)"),
)
def is_definitional(spark, folder):
    return _log(spark, folder).select("query_id", X.is_definitional(F.col("query")).alias("definitional"))


_spec = "greatest(0.0, " + ", ".join(
    f"CASE WHEN contains(q, {O.s(k)}) THEN CAST({min(len(k.split()) / 3.0, 1.0)!r} AS DOUBLE) ELSE 0.0 END"
    for k in R.SPECIFICITY_KEYWORDS
) + ")"
O.cte(
    "c_qc1",
    f"""SELECT query_id, query, q, CAST({_spec} AS DOUBLE) AS spec,
    {" + ".join(f"CAST({O.has('p', x)} AS INT)" for x in R.GENERIC_API_PATTERNS)} AS generic,
    {" + ".join(f"len(regexp_extract_all(p, {O.s(x)}))" for x in R.PROCEDURE_PATTERNS)} AS procs,
    {" OR ".join(O.has("p", x) for x in R.API_INDICATORS)} AS focus FROM
    (SELECT query_id, query, {O.strip("lower(query)")} AS q, {O.plain(O.strip("lower(query)"))} AS p FROM c_qlog)""",
)
O.cte(
    "c_qc",
    f"""SELECT *, CASE WHEN {O.contains_any("q", R.TROUBLE_WORDS)} THEN 'troubleshoot' WHEN procs > 0 THEN 'procedure'
    WHEN generic > 0 AND spec < 0.3 THEN 'generic_api' WHEN spec > 0.5 THEN 'specific_utility' ELSE 'info' END AS kind,
    least(1.0, 0.5 + CASE WHEN spec > 0.7 THEN 0.3 WHEN spec > 0.3 THEN 0.1 ELSE 0 END
    + CASE WHEN generic > 1 THEN 0.2 WHEN generic > 0 THEN 0.1 ELSE 0 END
    + CASE WHEN procs > 1 THEN 0.2 WHEN procs > 0 THEN 0.1 ELSE 0 END) AS conf,
    concat_ws(', ', CASE WHEN spec > 0.5 THEN printf('high utility specificity (%.2f)', spec)
    WHEN spec > 0.2 THEN printf('moderate utility specificity (%.2f)', spec) END,
    CASE WHEN generic > 0 THEN printf('%d generic API patterns', generic) END,
    CASE WHEN procs > 0 THEN printf('%d procedural indicators', procs) END,
    CASE WHEN focus THEN 'API-focused terminology' END) AS why FROM c_qc1""",
)


@query(
    "query_characteristics",
    O.sql(
        """SELECT query_id, kind AS query_type, round(spec, 6) AS specificity, CAST(generic AS BIGINT) AS generic_hits,
        CAST(procs AS BIGINT) AS procedure_hits, focus AS api_focus, CAST(round(conf, 6) AS DOUBLE) AS confidence,
        'Classified as ' || kind || ': ' || CASE WHEN why = '' THEN 'default classification' ELSE why END AS reasoning
        FROM c_qc"""
    ),
)
def query_characteristics(spark, folder):
    d = X.with_query_characteristics(_log(spark, folder))
    return d.select(
        "query_id",
        "query_type",
        F.round("specificity", 6).alias("specificity"),
        F.col("generic_hits").cast("long").alias("generic_hits"),
        F.col("procedure_hits").cast("long").alias("procedure_hits"),
        "api_focus",
        F.round("confidence", 6).alias("confidence"),
        "reasoning",
    )


_main = O.lookup({k: v[0] for k, v in R.TYPE_THRESHOLDS.items()}, "kind")
_api = O.lookup({k: v[1] for k, v in R.TYPE_THRESHOLDS.items()}, "kind")
O.cte(
    "c_thr",
    f"""SELECT query_id, idx, round(CAST(CASE WHEN idx = 'api' THEN {_api} *
    CASE WHEN spec > 0.7 THEN 1.5 WHEN spec < 0.2 THEN 0.7 ELSE 1 END ELSE {_main} *
    CASE WHEN spec > 0.7 THEN 1.2 WHEN spec < 0.2 THEN 0.8 ELSE 1 END END AS DOUBLE), 6) AS threshold
    FROM c_qc, (VALUES ('main'), ('api')) i(idx)""",
)


def thresholds(queries):
    d = X.with_query_characteristics(queries)
    return d.select(
        "query_id", "query_type", "specificity", F.explode(F.array(F.lit("main"), F.lit("api"))).alias("idx")
    ).select(
        "query_id",
        "idx",
        F.round(X.smart_threshold(F.col("query_type"), F.col("specificity"), F.col("idx")), 6).alias("threshold"),
    )


@query("smart_thresholds", O.sql("SELECT query_id, idx, threshold FROM c_thr"))
def smart_thresholds(spark, folder):
    return thresholds(_log(spark, folder))


def utility_case(text: str, plain_text: str) -> str:
    pairs = [(f"contains({text}, {O.s(p)})", O.s(n)) for n, ps in R.UTILITY_PATTERNS for p in ps if len(p) >= 3]
    pairs += [(O.has(plain_text, rf"\b{p}\b"), O.s(n)) for n, ps in R.UTILITY_PATTERNS for p in ps if len(p) <= 3]
    return O.case(pairs, "NULL")


@query(
    "recognize_utility",
    O.sql(
        f"""SELECT query_id, {utility_case("q", "p")} AS utility,
        {O.contains_any("q", R.UTILITY_QUERY_TERMS)} AS utility_query,
        list_extract({_expansions}, 1) AS token_utility
        FROM (SELECT query_id, query, lower(query) AS q, {O.plain("lower(query)")} AS p FROM c_qlog)"""
    ),
)
def recognize_utility(spark, folder):
    q = F.col("query")
    return _log(spark, folder).select(
        "query_id",
        X.recognize_utility(q).alias("utility"),
        X.is_utility_query(q).alias("utility_query"),
        X.first_utility_token(q).alias("token_utility"),
    )


_list_type = O.case([(O.contains_any("lower(query)", ws), O.s(n)) for ws, n in R.LIST_TYPES], "'apis'")


@query("list_type", O.sql(f"SELECT query_id, {_list_type} AS list_type FROM c_qlog"))
def list_type(spark, folder):
    return _log(spark, folder).select("query_id", X.list_type(F.col("query")).alias("list_type"))


def decompose_sql(src: str) -> str:
    parts = ", ".join(f"'{a} for: ' || q" for a in R.DECOMPOSE_ASPECTS)
    return f"""SELECT query_id, CAST(unnest(range(len(l))) AS BIGINT) AS subq_id, unnest(l) AS subquery FROM
    (SELECT query_id, list_slice(list_filter([CASE WHEN {O.has("p", R.DECOMPOSE_VERBS)}
    THEN 'What are the exact steps to ' || q || '?' END, {parts}], lambda x: x IS NOT NULL), 1, 6) AS l FROM
    (SELECT query_id, lower({O.strip("query")}) AS q, {O.plain(f"lower({O.strip('query')})")} AS p FROM {src}))"""


@query("decompose_queries", O.sql(decompose_sql("c_qlog")))
def decompose_queries(spark, folder):
    d = F.posexplode(X.decompose(F.col("query"))).alias("subq_id", "subquery")
    return _log(spark, folder).select("query_id", d).withColumn("subq_id", F.col("subq_id").cast("long"))


_trouble = O.contains_any("lower(query)", R.PLAN_TROUBLE_WORDS)


@query(
    "plan_aspects",
    O.sql(
        f"""SELECT query_id, aspect, utility, CAST(3 AS BIGINT) AS k, {O.lookup(R.PLAN_STRATEGY, "aspect")} AS strategy,
        CAST({O.lookup(R.PLAN_BUDGETS, "aspect")} AS BIGINT) AS budget FROM (SELECT query_id,
        list_extract({_expansions}, 1) AS utility, unnest(CASE WHEN {_trouble}
        THEN ['overview', 'steps', 'api', 'troubleshoot'] ELSE ['overview', 'steps', 'api'] END) AS aspect FROM c_qlog)"""
    ),
)
def plan_aspects(spark, folder):
    q = F.col("query")
    a = _log(spark, folder).select(
        "query_id", X.first_utility_token(q).alias("utility"), F.explode(X.plan_aspects(q)).alias("aspect")
    )
    return a.select(
        "query_id",
        "aspect",
        "utility",
        F.lit(3).cast("long").alias("k"),
        F.element_at(X.literal_map(R.PLAN_STRATEGY), F.col("aspect")).alias("strategy"),
        F.element_at(X.literal_map(R.PLAN_BUDGETS), F.col("aspect")).cast("long").alias("budget"),
    )


# -------------------------------------------------------------------------------------------------- passages
def hints_sql(text: str, title: str) -> str:
    where = {"text": text, "title": title}
    return "(" + " + ".join(f"CASE WHEN {O.has(where[f], p)} THEN {w} ELSE 0 END" for f, p, w in R.HINT_PATTERNS) + ")"


@query(
    "score_hints",
    O.sql(
        f"""SELECT doc_id, CAST(round({hints_sql("p", "t")}, 6) AS DOUBLE) AS bonus FROM
        (SELECT doc_id, {O.plain("text")} AS p, {O.plain("title")} AS t FROM c_corpus)"""
    ),
)
def score_hints(spark, folder):
    return C.corpus(spark, folder).select(
        "doc_id", F.round(X.score_hints(F.col("text"), F.col("title")), 6).alias("bonus")
    )


@query(
    "action_features",
    O.sql(
        "SELECT doc_id, "
        + ", ".join(f"{O.has('p', p)} AS has_{n}" for n, p in R.ACTION_PATTERNS.items())
        + f" FROM (SELECT doc_id, {O.plain('text')} AS p FROM c_corpus)"
    ),
)
def action_features(spark, folder):
    f = X.action_features(F.col("text"))
    return C.corpus(spark, folder).select("doc_id", *[c.alias(f"has_{n}") for n, c in f.items()])


_steps_sql = " OR ".join(O.has("p", "(?im)" + p) for p in R.STEP_INDICATORS)


@query(
    "has_steps",
    O.sql(f"SELECT doc_id, {_steps_sql} AS has_steps FROM (SELECT doc_id, {O.plain('text')} AS p FROM c_corpus)"),
)
def has_steps(spark, folder):
    return C.corpus(spark, folder).select("doc_id", X.has_steps(F.col("text")).alias("has_steps"))


_step_rx = "(?s)^(.{0,319})\\b\\d+\\."
_sentence_rx = "(?s)^(.*)\\. "


@query(
    "truncate_steps",
    O.sql(
        f"""SELECT doc_id, CASE WHEN length(text) <= 400 THEN text WHEN regexp_matches(p, '{_step_rx}')
        THEN left(text, length(regexp_extract(p, '{_step_rx}', 1))) || chr(10) || chr(10) || '*[Additional steps available...]*'
        WHEN contains(left(text, 400), '. ') THEN regexp_extract(left(text, 400), '{_sentence_rx}', 1) || '.'
        ELSE left(text, 397) || '...' END AS cut FROM (SELECT doc_id, text, {O.plain("text")} AS p FROM c_corpus)"""
    ),
)
def truncate_steps(spark, folder):
    return C.corpus(spark, folder).select("doc_id", X.truncate_steps(F.col("text")).alias("cut"))


def trim_sql(text: str, n: int) -> str:
    t = O.collapse(f"coalesce({text}, '')")
    return f"""CASE WHEN length({t}) <= {n} THEN {t} WHEN contains(left({t}, {n}), '. ')
    THEN regexp_extract(left({t}, {n}), '{_sentence_rx}', 1) || '.' ELSE left({t}, {n}) || '…' END"""


def excerpt_sql(x: str, n: int) -> str:
    ws = O.words(f"left({x}, {n})")
    return f"""CASE WHEN length({x}) <= {n} THEN {O.strip(x)} WHEN contains(left({x}, {n}), '. ')
    THEN regexp_extract(left({x}, {n}), '{_sentence_rx}', 1) || '.' WHEN len({ws}) > 1
    THEN array_to_string(list_slice({ws}, 1, len({ws}) - 1), ' ') || '...' ELSE left({x}, {n - 3}) || '...' END"""


@query(
    "trim_text",
    O.sql(f"SELECT doc_id, {trim_sql('text', 180)} AS trimmed, {excerpt_sql('text', 150)} AS excerpt FROM c_corpus"),
)
def trim_text(spark, folder):
    t = F.col("text")
    return C.corpus(spark, folder).select("doc_id", X.trim_text(t, 180).alias("trimmed"), X.excerpt(t, 150).alias("excerpt"))


def relevance_sql(src: str, query_col: str = "query", text_col: str = "text") -> str:
    """query_id, doc_id, relevance over (query_id, doc_id, query, text) rows."""
    return f"""SELECT query_id, doc_id, round(coalesce(sum(n / (n + 1.2)) / any_value(nq), 0), 6) AS relevance FROM
    (SELECT h.query_id, h.doc_id, t.term, CAST(count(d.term) AS DOUBLE) AS n, any_value(t.nq) AS nq
    FROM {src} h JOIN (SELECT query_id, unnest(ts) AS term, CAST(len(ts) AS DOUBLE) AS nq FROM (SELECT query_id,
    list_distinct({O.tokens("q")}) AS ts FROM (SELECT DISTINCT query_id, {query_col} AS q FROM {src}))) t
    ON t.query_id = h.query_id LEFT JOIN (SELECT doc_id, unnest({O.tokens("x")}) AS term FROM
    (SELECT DISTINCT doc_id, {text_col} AS x FROM {src})) d ON d.doc_id = h.doc_id AND d.term = t.term
    GROUP BY ALL) GROUP BY ALL"""


O.cte("c_rel", relevance_sql("c_hits"))


@query("lexical_relevance", O.sql("SELECT query_id, doc_id, relevance FROM c_rel"))
def lexical_relevance(spark, folder):
    h = X.with_relevance(lex_hits(spark, folder, 50, "text"))
    return h.select("query_id", "doc_id", F.round("relevance", 6).alias("relevance"))


@query("score_pairs", O.sql("SELECT query_id, doc_id, relevance AS pair_score FROM c_rel"))
def score_pairs(spark, folder):
    h = scoring.score_pairs(lex_hits(spark, folder, 50, "text"))
    return h.select("query_id", "doc_id", F.round("pair_score", 6).alias("pair_score"))


# answers derived from the assistant turns: every other one cites its sources
O.cte(
    "c_ans",
    """SELECT conv_id || '-' || turn AS answer_id, CASE WHEN turn % 4 = 1 THEN '[doc ' || conv_id || '#setup] ' || text
    || ' [2]' ELSE text END AS answer FROM conversations WHERE role = 'assistant'""",
)


def answers(spark, folder):
    c = C.table(spark, folder, "conversations").where(F.col("role") == "assistant")
    cited = F.concat(F.lit("[doc "), F.col("conv_id").cast("string"), F.lit("#setup] "), F.col("text"), F.lit(" [2]"))
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("answer_id"),
        F.when(F.col("turn") % 4 == 1, cited).otherwise(F.col("text")).alias("answer"),
    )


@query(
    "citations",
    O.sql(
        """SELECT answer_id, CAST(len(c) AS BIGINT) AS n, array_to_string(c, '|') AS citations FROM
        (SELECT answer_id, regexp_extract_all(answer, '\\[([^\\]]+)\\]', 1) AS c FROM c_ans)"""
    ),
)
def citations(spark, folder):
    c = X.citations(F.col("answer"))
    return answers(spark, folder).select(
        "answer_id", F.size(c).cast("long").alias("n"), F.array_join(c, "|").alias("citations")
    )


@query(
    "normalize_stage",
    O.sql("SELECT stage, event, count(*) AS n, round(sum(ms), 3) AS total_ms FROM c_tel GROUP BY ALL"),
)
def normalize_stage(spark, folder):
    t = C.telemetry(spark, folder)
    return t.groupBy("stage", "event").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("ms"), 3).alias("total_ms"))


@query(
    "source_chips",
    O.sql(
        f"""SELECT query_id, rank, doc_id, CASE WHEN t <> '' THEN t ELSE
        {O.clip("split_part(text, '. ', 1)", 50)} END AS title, page_url AS url, {excerpt_sql("text", 150)} AS excerpt
        FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN title ELSE '' END AS t FROM c_hits) WHERE rank <= 5"""
    ),
)
def source_chips(spark, folder):
    h = lex_hits(spark, folder, 5, "title", "text", "page_url")
    title = F.when(F.col("doc_id") % 2 == 0, F.col("title")).otherwise("")
    return h.select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        "doc_id",
        X.source_title(title, F.col("text")).alias("title"),
        F.col("page_url").alias("url"),
        X.excerpt(F.col("text"), 150).alias("excerpt"),
    )


# ---------------------------------------------------------------------------------------------- rule tables
def _rule_values(rows) -> str:
    return ", ".join("(" + ", ".join(O.s(v) for v in r) + ")" for r in rows)


@query(
    "load_synonyms",
    O.sql(
        f"""SELECT s.term, s.expansion, count(q.query_id) AS n_queries FROM (VALUES {_rule_values(R.SYNONYMS)})
        s(term, expansion) LEFT JOIN (SELECT DISTINCT query_id, unnest({O.tokens("query")}) AS t FROM c_qlog) q
        ON q.t = s.term GROUP BY ALL"""
    ),
)
def load_synonyms(spark, folder):
    """The synonym table with the number of logged queries that use each term as a word."""
    terms = RF.read_synonyms(spark, RF.built_in(spark).synonyms)
    used = _log(spark, folder).select(F.explode(F.array_distinct(X.tokens(F.col("query")))).alias("term"))
    return (
        terms.join(used.groupBy("term").agg(F.count(F.lit(1)).alias("n_queries")), "term", "left")
        .withColumn("n_queries", F.coalesce("n_queries", F.lit(0)))
    )


_catalog_rows = [(p, g, a, n) for p, g, a, names in R.API_CATALOG for n in names]


@query(
    "api_catalog",
    O.sql(
        f"""SELECT product, group_name, acronym, api_name, coalesce(s.expansion, group_name) AS full_name,
        coalesce(n_docs, 0) AS n_docs FROM (VALUES {_rule_values(_catalog_rows)}) c(product, group_name, acronym, api_name)
        LEFT JOIN (VALUES {_rule_values(R.SYNONYMS)}) s(term, expansion) ON upper(s.term) = c.acronym
        LEFT JOIN (SELECT utility_name, count(*) AS n_docs FROM c_corpus GROUP BY 1) d ON d.utility_name = c.group_name"""
    ),
)
def api_catalog(spark, folder):
    """Catalogue rows with their acronym's name (the synonym file wins) and the documents of their group."""
    files = RF.built_in(spark)
    rows = RF.read_catalog(spark, files.catalog)
    names = RF.read_synonyms(spark, files.synonyms).select(F.upper("term").alias("acronym"), "expansion")
    docs = C.corpus(spark, folder).groupBy(F.col("utility_name").alias("group_name")).agg(F.count(F.lit(1)).alias("n_docs"))
    return (
        rows.select("product", "group_name", "acronym", F.explode("apis").alias("api_name"))
        .join(names, "acronym", "left")
        .join(docs, "group_name", "left")
        .select(
            "product", "group_name", "acronym", "api_name",
            F.coalesce("expansion", "group_name").alias("full_name"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        )
    )


@query(
    "strategy_choice",
    O.sql(
        f"""SELECT query_id, CASE WHEN route = 'list' THEN 'bm25' WHEN confidence > 0.7 THEN 'fusion' ELSE 'bm25' END
        AS strategy, CASE WHEN route = 'api' THEN 'api' ELSE 'main' END AS idx FROM (SELECT query_id,
        {O.case([(c, O.s(v[0])) for c, v in _route_cases], "'general'")} AS route,
        {O.case([(c, O.s(v[1])) for c, v in _route_cases], "0.5")} AS confidence
        FROM (SELECT *, {O.plain('query')} AS p FROM c_qlog))"""
    ),
)
def strategy_choice(spark, folder):
    return S.strategy(_log(spark, folder)).select("query_id", "strategy", "idx")


@query(
    "one_step_plan",
    O.sql("SELECT query_id, 'search' AS type, query, CAST(15 AS BIGINT) AS k FROM c_qlog"),
)
def one_step_plan(spark, folder):
    return _log(spark, folder).select("query_id", F.inline(X.one_step_plan(F.col("query"))))


# A candidate's text is its second line, its content the first, its snippet the address group, its body the whole text.
_line = "nullif({0}, '')"
_given = ", ".join(
    _line.format(O.strip(x)) for x in ("split_part(text, chr(10), 2)", "split_part(text, chr(10), 1)", "source", "text")
)


@query(
    "candidate_text",
    O.sql(f"SELECT doc_id, md5(coalesce({_given}, '')) AS text_md5 FROM documents"),
)
def candidate_text(spark, folder):
    second, first = (F.split_part(F.col("text"), F.lit("\n"), F.lit(n)) for n in (2, 1))
    return C.table(spark, folder, "documents").select(
        "doc_id", F.md5(X.candidate_text(second, first, F.col("source"), F.col("text"))).alias("text_md5")
    )


_key = "replace(replace(lower(replace(replace(k, '\"', ''), chr(39), '')), '-', '_'), ' ', '_')"


@query(
    "normalize_log_keys",
    O.sql(
        f"""SELECT key, count(*) AS n FROM (SELECT {O.lookup(R.LOG_KEYS, _key, _key)} AS key FROM (SELECT unnest(['Request-ID',
        '"reg_id"', 'Event ' || event_type]) AS k FROM events)) GROUP BY key"""
    ),
)
def normalize_log_keys(spark, folder):
    names = F.array(F.lit("Request-ID"), F.lit('"reg_id"'), F.concat(F.lit("Event "), F.col("event_type")))
    keys = C.table(spark, folder, "events").select(F.explode(names).alias("k"))
    return keys.select(X.normalize_key(F.col("k")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
