"""Column functions over query logs and passages.

All of them are plain Column expressions, so they stay inside the JVM and fuse with the surrounding projection.
Patterns run with Java's Unicode character classes because queries and documents are multilingual.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.functions import rules as R
from quaestor.session import settle


# ---------------------------------------------------------------------------------------------------- basics
def pattern(p: str) -> str:
    """Make \\w, \\b, \\d and \\s of a Java pattern cover Unicode."""
    return "(?U)" + p


def has(c: Column, p: str, ignore_case: bool = False) -> Column:
    return c.rlike(pattern(("(?i)" if ignore_case else "") + p))


def contains_any(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def collapse(c: Column) -> Column:
    """Trim and reduce every run of white space to one blank."""
    return F.trim(F.regexp_replace(c, R.SPACE, " "))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(R.SPACE_CHARS))


def words(c: Column) -> Column:
    """White-space words; an empty text has none."""
    return F.filter(F.split(c, R.SPACE), lambda w: w != "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(R.TOKEN), 0)


def index_tokens(c: Column) -> Column:
    """Tokens without stop words, as the lexical index sees them."""
    return F.filter(tokens(c), lambda t: ~t.isin(R.STOP_WORDS))


def first_case(cases, default) -> Column:
    """First matching (condition, value) wins."""
    out = None
    for cond, value in cases:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default)


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


# ------------------------------------------------------------------------------------------- query rewriting
def normalize_query(c: Column) -> Column:
    """Replace whole-word synonyms in one pass, so a replacement is never rewritten again."""
    rx = pattern(r"(?i)\b(" + "|".join(t for t, _ in R.SYNONYMS) + r")\b")
    names = literal_map(dict(R.SYNONYMS))
    kept = F.split(c, rx, -1)
    found = F.transform(F.regexp_extract_all(c, F.lit(rx), 0), lambda m: F.element_at(names, F.lower(m)))
    return collapse(F.array_join(F.zip_with(kept, found, lambda k, f: F.concat(k, F.coalesce(f, F.lit("")))), ""))


_ACRONYMS = {t.upper(): name for t, name in R.SYNONYMS}
for _, _group, _acronym, _ in R.API_CATALOG:
    if _acronym:
        _ACRONYMS.setdefault(_acronym, _group)
ACRONYMS = dict(_ACRONYMS)  # the synonym file wins; the catalogue only fills gaps


def expansions(c: Column) -> Column:
    names = literal_map(ACRONYMS)
    return F.filter(F.transform(words(c), lambda w: F.element_at(names, F.upper(w))), lambda x: x.isNotNull())


def expand_acronyms(c: Column) -> Column:
    names = literal_map(ACRONYMS)
    return F.array_join(
        F.transform(
            words(c), lambda w: F.coalesce(F.concat(F.element_at(names, F.upper(w)), F.lit(" "), F.upper(w)), w)
        ),
        " ",
    )


def query_variants(c: Column) -> Column:
    """The query, its first expansion and the expanded text, in that order and without repeats."""
    found = expansions(c)
    return F.when(F.size(found) > 0, F.array_distinct(F.array(c, found[0], expand_acronyms(c)))).otherwise(F.array(c))


def semantic_key(c: Column) -> Column:
    out = F.array_join(words(F.lower(c)), " ")
    for p, replacement in R.SEMANTIC_REWRITES:
        out = F.regexp_replace(out, pattern(p), replacement)
    return out


def _api_keywords() -> dict:
    out = {}
    for _, _, acronym, names in R.API_CATALOG:
        if acronym:
            found = []
            for name in names[:3]:
                found += [w for w in name.replace("API", "").replace("Service", "").split() if len(w) > 2]
            out[acronym] = " ".join(found[:5])
    return out


API_KEYWORDS = _api_keywords()


def embedding_text(c: Column) -> Column:
    """Query, expansion of its first acronym, keywords of the APIs of its first word, and the domain suffix."""
    found = expansions(c)
    keywords = F.element_at(literal_map(API_KEYWORDS), F.upper(F.get(words(c), F.lit(0))))
    return F.concat_ws(
        " ",
        c,
        F.when(F.size(found) > 0, F.concat(F.lit("("), F.get(found, F.lit(0)), F.lit(")"))),
        F.when(F.size(found) > 0, keywords),
        F.lit(R.EMBEDDING_SUFFIX),
    )


def one_decimal(c: Column) -> Column:
    """A non-negative number with one decimal, rounded by its exact value and halves to even, as printf does.

    Twenty times the number minus an odd integer tells on which side of a half it lies; the number is split in two parts
    whose products are exact.
    """
    k = F.floor(c * 10)
    high = c.cast("float").cast("double")
    beyond = (high * 20 - (2 * k + 1)) + (c - high) * 20
    tenths = k + F.when((beyond > 0) | ((beyond == 0) & (k % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def normalize_embed_text(c: Column, limit: int | None = None) -> Column:
    """White space collapsed, '[empty]' for nothing; the whole text unless a limit is given."""
    out = collapse(F.coalesce(c, F.lit("")))
    out = out if limit is None else F.substring(out, 1, limit)
    return F.when(out == "", "[empty]").otherwise(out)


def clean_query(c: Column) -> Column:
    """Drop a 'Given context: ... Current question:' wrapper."""
    rx = r"(?is)Given context:.*?Current question:\s*(.*)"
    return strip(F.when(c.rlike(rx), F.regexp_extract(c, rx, 1)).otherwise(c))


def sanitize(c: Column) -> Column:
    """Strip escapes and control characters; null when nothing is left."""
    escaped = F.regexp_replace(F.regexp_replace(c, r"\\\\", ""), r"\\'", "'")
    out = F.regexp_replace(strip(escaped), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return F.nullif(out, F.lit(""))


# ------------------------------------------------------------------------------------------- classification
def route(c: Column) -> Column:
    """Ordered first-match routing -> struct(route, confidence, pattern)."""

    def hit(name, confidence, why):
        return F.struct(F.lit(name).alias("route"), F.lit(confidence).alias("confidence"), F.lit(why).alias("pattern"))

    ws = words(F.lower(c))
    short = (F.size(ws) <= 3) & F.exists(
        ws, lambda w: F.regexp_replace(w, r"^[.,?!]+|[.,?!]+$", "").isin(R.ROUTER_ACRONYMS)
    )
    cases = [(strip(F.coalesce(c, F.lit(""))) == "", hit("general", 0.0, "empty_query"))]
    cases.append((short, hit("general", 0.9, "utility_acronym")))
    for name, confidence, patterns in R.ROUTES:
        cases += [(has(c, p, ignore_case=True), hit(name, confidence, f"{name}_pattern: {p}")) for p in patterns]
    return first_case(cases, hit("general", 0.5, "default"))


def compare_entities(c: Column) -> Column:
    """struct(entity1, entity2) of a comparison query, null when it is none."""
    cases = []
    for p in R.COMPARE_ENTITIES:
        rx = pattern("(?i)" + p)
        pair = F.struct(
            strip(F.regexp_extract(c, rx, 1)).alias("entity1"), strip(F.regexp_extract(c, rx, 2)).alias("entity2")
        )
        cases.append((c.rlike(rx), pair))
    return first_case(cases, F.lit(None).cast("struct<entity1:string,entity2:string>"))


def is_definitional(c: Column) -> Column:
    t = words(F.lower(c))
    return (
        (F.size(t) <= 3)
        | ((F.get(t, F.lit(0)) == "what") & F.get(t, F.lit(1)).isin("is", "are"))
        | F.get(t, F.lit(0)).isin("define", "definition")
        | F.array_contains(t, "meaning")
        | F.array_contains(t, "stands")
    )


def with_query_characteristics(df: DataFrame, query: str = "query") -> DataFrame:
    """Add query_type, specificity, generic_hits, procedure_hits, api_focus, confidence and reasoning.

    The measures are projected first and the labels derived from them, so no pattern is evaluated twice.
    """
    q = F.col("_q")
    keyword_scores = [
        F.when(q.contains(k), F.lit(min(len(k.split()) / 3.0, 1.0))).otherwise(0.0) for k in R.SPECIFICITY_KEYWORDS
    ]
    df = df.withColumn("_q", strip(F.lower(F.col(query)))).withColumns(
        {
            "specificity": F.greatest(F.lit(0.0), *keyword_scores),
            "generic_hits": reduce(lambda a, b: a + b, [has(q, p).cast("int") for p in R.GENERIC_API_PATTERNS]),
            "procedure_hits": reduce(
                lambda a, b: a + b, [F.regexp_count(q, F.lit(pattern(p))) for p in R.PROCEDURE_PATTERNS]
            ),
            "api_focus": reduce(lambda a, b: a | b, [has(q, p) for p in R.API_INDICATORS]),
            "_trouble": contains_any(q, R.TROUBLE_WORDS),
        }
    )
    spec, generic, procedural = F.col("specificity"), F.col("generic_hits"), F.col("procedure_hits")
    df = df.withColumn(
        "query_type",
        first_case(
            [
                (F.col("_trouble"), F.lit("troubleshoot")),
                (procedural > 0, F.lit("procedure")),
                ((generic > 0) & (spec < 0.3), F.lit("generic_api")),
                (spec > 0.5, F.lit("specific_utility")),
            ],
            F.lit("info"),
        ),
    )
    confidence = F.least(
        F.lit(1.0),
        F.lit(0.5)
        + F.when(spec > 0.7, 0.3).when(spec > 0.3, 0.1).otherwise(0.0)
        + F.when(generic > 1, 0.2).when(generic > 0, 0.1).otherwise(0.0)
        + F.when(procedural > 1, 0.2).when(procedural > 0, 0.1).otherwise(0.0),
    )
    reasons = F.concat_ws(
        ", ",
        F.when(spec > 0.5, F.format_string("high utility specificity (%.2f)", spec)).when(
            spec > 0.2, F.format_string("moderate utility specificity (%.2f)", spec)
        ),
        F.when(generic > 0, F.format_string("%d generic API patterns", generic)),
        F.when(procedural > 0, F.format_string("%d procedural indicators", procedural)),
        F.when(F.col("api_focus"), F.lit("API-focused terminology")),
    )
    return (
        df.withColumn("confidence", confidence)
        .withColumn("_why", reasons)
        .withColumn(
            "reasoning",
            F.concat(
                F.lit("Classified as "),
                F.col("query_type"),
                F.lit(": "),
                F.when(F.col("_why") == "", "default classification").otherwise(F.col("_why")),
            ),
        )
        .drop("_q", "_trouble", "_why")
    )


def smart_threshold(kind: Column, specificity: Column, idx: Column) -> Column:
    main = F.element_at(literal_map({k: v[0] for k, v in R.TYPE_THRESHOLDS.items()}), kind)
    api = F.element_at(literal_map({k: v[1] for k, v in R.TYPE_THRESHOLDS.items()}), kind)
    return F.when(
        idx == "api", api * F.when(specificity > 0.7, 1.5).when(specificity < 0.2, 0.7).otherwise(1.0)
    ).otherwise(main * F.when(specificity > 0.7, 1.2).when(specificity < 0.2, 0.8).otherwise(1.0))


def recognize_utility(c: Column) -> Column:
    """Phrases of three letters or more by substring first, then short acronyms as whole words."""
    q = F.lower(c)
    cases = [(q.contains(p), F.lit(n)) for n, ps in R.UTILITY_PATTERNS for p in ps if len(p) >= 3]
    cases += [(has(q, rf"\b{p}\b"), F.lit(n)) for n, ps in R.UTILITY_PATTERNS for p in ps if len(p) <= 3]
    return first_case(cases, F.lit(None).cast("string"))


def is_utility_query(c: Column) -> Column:
    return contains_any(F.lower(c), R.UTILITY_QUERY_TERMS)


def first_utility_token(c: Column) -> Column:
    return F.get(expansions(c), F.lit(0))


def list_type(c: Column) -> Column:
    q = F.lower(c)
    return first_case([(contains_any(q, ws), F.lit(name)) for ws, name in R.LIST_TYPES], F.lit("apis"))


def decompose(c: Column, limit: int = 6) -> Column:
    q = F.lower(strip(c))
    exact = F.when(has(q, R.DECOMPOSE_VERBS), F.concat(F.lit("What are the exact steps to "), q, F.lit("?")))
    parts = [F.concat(F.lit(a + " for: "), q) for a in R.DECOMPOSE_ASPECTS]
    return F.slice(F.array_compact(F.array_distinct(F.array(exact, *parts))), 1, limit)


def plan_aspects(c: Column) -> Column:
    base = F.array(*[F.lit(a) for a in R.PLAN_ASPECTS])
    trouble = contains_any(F.lower(c), R.PLAN_TROUBLE_WORDS)
    return F.when(trouble, F.concat(base, F.array(F.lit("troubleshoot")))).otherwise(base)


# ----------------------------------------------------------------------------------------- passage functions
def score_hints(text: Column, title: Column) -> Column:
    where = {"text": text, "title": F.coalesce(title, F.lit(""))}
    return reduce(lambda a, b: a + b, [F.when(has(where[f], p), w).otherwise(0.0) for f, p, w in R.HINT_PATTERNS])


def action_features(text: Column) -> dict:
    """Feature name -> boolean Column."""
    return {name: has(text, p) for name, p in R.ACTION_PATTERNS.items()}


def action_weight(text: Column) -> Column:
    return reduce(
        lambda a, b: a + b,
        [F.when(f, R.ACTION_WEIGHTS[n]).otherwise(0.0) for n, f in action_features(text).items()],
    )


def is_actionable(text: Column) -> Column:
    return reduce(lambda a, b: a | b, action_features(text).values())


def has_steps(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [has(text, "(?im)" + p) for p in R.STEP_INDICATORS])


def truncate_steps(text: Column, limit: int = 400) -> Column:
    """Cut before the last numbered step that starts in the first 80 %, else after a sentence, else hard."""
    last_start = int(limit * 0.8) - 1 if (limit * 0.8) == int(limit * 0.8) else int(limit * 0.8)
    step = pattern(rf"(?s)^(.{{0,{last_start}}})\b\d+\.")
    sentence = r"(?s)^(.*)\. "
    cut = F.substring(text, 1, limit)
    return (
        F.when(F.length(text) <= limit, text)
        .when(
            text.rlike(step), F.concat(F.regexp_extract(text, step, 1), F.lit("\n\n*[Additional steps available...]*"))
        )
        .when(cut.contains(". "), F.concat(F.regexp_extract(cut, sentence, 1), F.lit(".")))
        .otherwise(F.concat(F.substring(text, 1, limit - 3), F.lit("...")))
    )


def trim_text(text: Column, n) -> Column:
    """Collapse white space and cut at a sentence end, else with an ellipsis."""
    n = n if isinstance(n, Column) else F.lit(n)
    t = collapse(F.coalesce(text, F.lit("")))
    cut = F.substring(t, F.lit(1), n)
    return (
        F.when(F.length(t) <= n, t)
        .when(cut.contains(". "), F.concat(F.regexp_extract(cut, r"(?s)^(.*)\. ", 1), F.lit(".")))
        .otherwise(F.concat(cut, F.lit("…")))
    )


def excerpt(text: Column, n: int = 150) -> Column:
    cut = F.substring(text, 1, n)
    ws = words(cut)
    return (
        F.when(F.length(text) <= n, strip(text))
        .when(cut.contains(". "), F.concat(F.regexp_extract(cut, r"(?s)^(.*)\. ", 1), F.lit(".")))
        .when(F.size(ws) > 1, F.concat(F.array_join(F.slice(ws, F.lit(1), F.size(ws) - 1), " "), F.lit("...")))
        .otherwise(F.concat(F.substring(text, 1, n - 3), F.lit("...")))
    )


def clip(text: Column, n: int) -> Column:
    """First n characters, marked when something was left out."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def pair_relevance(
    pairs: DataFrame, queries: DataFrame, docs: DataFrame, query_key: list[str], name: str = "relevance"
) -> DataFrame:
    """Add to (query, document) pairs the mean saturated term frequency of the distinct query tokens.

    pairs: query key, doc_id.  queries: query key, query.  docs: doc_id, text.  Texts are split once per document and
    queries once per query; pairs meet them term by term, so neither side carries texts through a shuffle.
    """
    terms = queries.select(*query_key, F.array_distinct(tokens(F.col("query"))).alias("_ts")).select(
        *query_key, F.size("_ts").alias("_n"), F.explode("_ts").alias("_t")
    )
    found = (
        docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("_t"))
        .groupBy("doc_id", "_t")
        .agg(F.count(F.lit(1)).cast("double").alias("_tf"))
    )
    keys = [*query_key, "doc_id"]
    scored = (
        pairs.select(*keys)
        .join(terms, query_key)
        .join(found, ["doc_id", "_t"])
        .groupBy(*keys)
        .agg(F.sum(F.col("_tf") / (F.col("_tf") + 1.2) / F.col("_n")).alias("_r"))
    )
    return pairs.join(scored, keys, "left").withColumn(name, F.coalesce("_r", F.lit(0.0))).drop("_r")


def with_relevance(hits: DataFrame, text: str = "text", name: str = "relevance") -> DataFrame:
    """Relevance of a hit list that carries query_id, query, doc_id and the text."""
    hits = settle(hits, "hits")
    queries = hits.select("query_id", "query").dropDuplicates(["query_id"])
    docs = hits.select("doc_id", F.col(text).alias("text")).dropDuplicates(["doc_id"])
    return pair_relevance(hits, queries, docs, ["query_id"], name)


def citations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]"), 1)


def verification_sentences(text: Column) -> Column:
    """Sentences long enough to need a citation; headings and bullets are left out."""
    parts = F.transform(F.split(text, r"[.!?]+"), strip)
    return F.filter(
        parts, lambda s: (F.length(s) > 20) & ~s.startswith("**") & ~s.startswith("#") & ~s.startswith("- ")
    )


def source_title(title: Column, text: Column) -> Column:
    first = F.substring_index(text, ". ", 1)
    return F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(clip(first, 50))


def suite_name(suite: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(R.SUITE_NAMES), F.lower(suite)), F.initcap(suite))


def format_attrs(attrs: Column) -> Column:
    labels = literal_map(R.ATTR_LABELS)
    return F.array_join(
        F.transform(
            F.array_sort(F.map_entries(attrs)),
            lambda e: F.concat(F.coalesce(F.element_at(labels, e["key"]), F.concat(e["key"], F.lit(": "))), e["value"]),
        ),
        ", ",
    )


def call_to_action(suite: Column, capability: Column) -> Column:
    table = literal_map({f"{s}/{c}": text for (s, c), text in R.CTA.items()})
    return F.coalesce(F.element_at(table, F.concat(suite, F.lit("/"), capability)), F.lit("Open link"))


def normalize_stage(c: Column) -> Column:
    s = F.translate(F.lower(c), "- ", "__")
    return F.coalesce(F.element_at(literal_map(R.STAGE_FIXES), s), s)


def normalize_key(c: Column) -> Column:
    """A log key in snake case, without quotes, under its usual name."""
    key = F.translate(F.lower(F.translate(c, "\"'", "")), "- ", "__")
    return F.coalesce(F.element_at(literal_map(R.LOG_KEYS), key), key)


def one_step_plan(c: Column, k: int = 15) -> Column:
    """The plan of a query that is not taken apart: one unfiltered search."""
    return F.array(F.struct(F.lit("search").alias("type"), c.alias("query"), F.lit(k).cast("long").alias("k")))


def candidate_text(text: Column, content: Column, snippet: Column, body: Column) -> Column:
    """The first of a candidate's texts that is not blank, stripped; empty if there is none."""
    found = [F.nullif(strip(c), F.lit("")) for c in (text, content, snippet, body)]
    return F.coalesce(*found, F.lit(""))
