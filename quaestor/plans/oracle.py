"""DuckDB SQL for the checks: named common table expressions and helpers to write them.

Each check is one statement built from the expressions it needs.  RE2 knows no Unicode word boundary, so boolean
patterns run on a text whose non-ASCII letters are replaced by '_' (a word character in every dialect).
"""

import re

from quaestor.functions import rules as R
from quaestor.sources import corpus as C


def s(value) -> str:
    """SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + value.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(s(v) for v in values) + "]"


def pick(values, key) -> str:
    return f"list_extract({lst(values)}, CAST(({key}) % {len(values)} + 1 AS INT))"


def plain(x: str) -> str:
    return f"regexp_replace({x}, '[^\\x00-\\x7F\\p{{P}}\\p{{S}}\\p{{Z}}]', '_', 'g')"


def has(x: str, p: str, ci: bool = False) -> str:
    """Boolean pattern on a text already made plain."""
    return f"regexp_matches({x}, {s(('(?i)' if ci else '') + p)})"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{R.SPACE}', ''), '{R.SPACE}$', '')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{R.SPACE}', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{R.SPACE}'), lambda w: w <> '')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{R.TOKEN}')"


def index_tokens(x: str) -> str:
    return f"list_filter({tokens(x)}, lambda t: NOT list_contains({lst(R.STOP_WORDS)}, t))"


def contains_any(x: str, ws) -> str:
    return "(" + " OR ".join(f"contains({x}, {s(w)})" for w in ws) + ")"


def case(pairs, default) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def clip(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN left({x}, {n}) || '...' ELSE {x} END"


def lookup(d: dict, x: str, default="NULL") -> str:
    return "CASE " + " ".join(f"WHEN {x} = {s(k)} THEN {s(v)}" for k, v in d.items()) + f" ELSE {default} END"


CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def sql(body: str) -> str:
    """Prepend the expressions a statement refers to, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit_cte(name)

    def visit_cte(name: str) -> None:
        text = CTES[name]
        for other in CTES:
            if other != name and other not in order and re.search(rf"\b{other}\b", text):
                visit_cte(other)
        if name not in order:
            order.append(name)

    visit(body)
    if not order:
        return body
    head = ",\n".join(f"{n} AS {'MATERIALIZED ' if n.startswith('c_') else ''}(\n{CTES[n]}\n)" for n in order)
    return f"WITH RECURSIVE {head}\n{body}"


# ------------------------------------------------------------------------------------------------ data model
cte(
    "c_corpus",
    f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'api' ELSE 'main' END AS idx,
    split_part(text, chr(10), 1) AS title, text || chr(10) || {pick(C.SNIPPETS, "doc_id")} AS text,
    'grp_' || (doc_id % 5) AS acl_hash, lang AS space_key, {pick(C.CONTENT_TYPES, "doc_id")} AS content_type,
    {pick(C.UTILITIES, "doc_id")} AS utility_name, DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS updated_at,
    'https://docs.example.com/' || source || '/' || doc_id AS page_url FROM documents""",
)
cte(
    "c_units",
    f"""SELECT doc_id, unit_no, unit_text FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS unit_no,
    unnest(l) AS unit_text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM c_corpus))
    WHERE {strip("unit_text")} <> ''""",
)
cte(
    "c_qlog",
    f"""SELECT conv_id || '-' || turn AS query_id,
    replace({pick(C.QUERY_TEMPLATES, "conv_id * 7 + turn")}, '{{}}', text) AS query
    FROM conversations WHERE role = 'user'""",
)
cte(
    "c_sq",
    f"SELECT item_id AS query_id, {pick(C.SEARCH_PREFIXES, 'item_id')} || text AS query FROM benchmark",
)
cte("c_vec", "SELECT vec_id AS doc_id, embedding FROM embeddings")
cte("c_qvec", "SELECT item_id AS query_id, embedding FROM benchmark JOIN embeddings ON vec_id = item_id")
cte(
    "c_tel",
    f"""SELECT event_id, ts, user_id, user_id || '-' || strftime(ts, '%Y%m%d') AS req_id,
    {lookup(R.STAGE_FIXES, "translate(lower(event_type), '- ', '__')", "translate(lower(event_type), '- ', '__')")}
    AS stage, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 2 = 0 THEN 'start' ELSE 'success' END AS event,
    value * 10 AS ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
)

# -------------------------------------------------------------------------------------------------- lexical
def clauses_sql(queries: str) -> str:
    """Boosted clauses for the utilities that queries(query_id, query) name."""
    return " UNION ALL ".join(
        f"SELECT query_id, {s(a + suffix)} AS text, {boost} AS boost FROM {queries} WHERE contains(lower(query), {s(n.lower())})"
        for n, a in R.CLAUSE_UTILITIES
        for suffix, boost in R.CLAUSE_BOOSTS
    )


def bm25_ctes(prefix: str, units: str, queries: str, clauses: bool) -> None:
    """<prefix>_pu(query_id, doc_id, unit_no, score) over units(doc_id, unit_no, unit_text)."""
    extra = f" UNION ALL {clauses_sql(queries)}" if clauses else ""
    cte(
        f"{prefix}_qt",
        f"""SELECT query_id, term, sum(CAST(boost AS DOUBLE)) AS weight FROM (SELECT query_id, boost,
        unnest({index_tokens("text")}) AS term FROM (SELECT query_id, query AS text, 1.0 AS boost FROM {queries}{extra}))
        GROUP BY ALL""",
    )
    cte(f"{prefix}_tk", f"SELECT doc_id, unit_no, {index_tokens('unit_text')} AS toks FROM {units}")
    cte(f"{prefix}_st", f"SELECT count(*) AS n, avg(len(toks)) AS al FROM {prefix}_tk WHERE len(toks) > 0")
    cte(
        f"{prefix}_po",
        f"""SELECT doc_id, unit_no, ul, term, count(*) AS tf FROM (SELECT doc_id, unit_no, len(toks) AS ul,
        unnest(toks) AS term FROM {prefix}_tk) WHERE term IN (SELECT term FROM {prefix}_qt) GROUP BY ALL""",
    )
    cte(f"{prefix}_df", f"SELECT term, count(*) AS df FROM {prefix}_po GROUP BY term")
    cte(
        f"{prefix}_pu",
        f"""SELECT query_id, doc_id, unit_no, sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf /
        (tf + 1.2 * (1 - 0.75 + 0.75 * ul / al))) AS score FROM {prefix}_po JOIN {prefix}_qt USING (term)
        JOIN {prefix}_df USING (term), {prefix}_st GROUP BY ALL""",
    )


def ranked(src: str, k: int, by: str = "query_id") -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, doc_id) AS rank
    FROM (SELECT {by}, doc_id, round(score, 6) AS score FROM {src})) WHERE rank <= {k}"""


bm25_ctes("c_b", "c_units", "c_sq", True)
cte("c_bd", "SELECT query_id, doc_id, max(score) AS score FROM c_b_pu GROUP BY ALL")
cte("c_bm25", ranked("c_bd", 50))
cte("c_bm65", ranked("c_bd", 65))
cte(
    "c_knn_all",
    """SELECT q.query_id, v.doc_id, (1 + list_cosine_similarity(CAST(q.embedding AS DOUBLE[]),
    CAST(v.embedding AS DOUBLE[]))) / 2 AS score FROM c_qvec q, c_vec v""",
)
cte("c_knn", ranked("c_knn_all", 50))
cte("c_knn65", ranked("c_knn_all", 65))


def rrf(a: str, b: str, k: int) -> str:
    return ranked(
        f"""(SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT query_id, doc_id, rank FROM {a}
        UNION ALL SELECT query_id, doc_id, rank FROM {b}) GROUP BY ALL)""",
        k,
    )


cte("c_rrf", rrf("c_bm65", "c_knn65", 50))
# hits with document columns
cte(
    "c_hits",
    """SELECT query_id, query, h.doc_id, h.score, h.rank, idx, title, text, content_type, utility_name, updated_at,
    page_url FROM c_bm25 h JOIN c_corpus USING (doc_id) JOIN c_sq USING (query_id)""",
)
cte(
    "c_rrfhits",
    """SELECT query_id, query, h.doc_id, h.score, h.rank, idx, title, text, page_url FROM c_rrf h
    JOIN c_corpus USING (doc_id) JOIN c_sq USING (query_id)""",
)
