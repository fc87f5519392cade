"""Reading search responses and extracting passages from nested hits."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.functions import text as X

SECTION = "struct<title:string,heading:string,content:string,text:string>"
HIT = (
    "struct<_id:string,_index:string,_score:double,_source:struct<title:string,api_name:string,utility_name:string,"
    "page_url:string,content_type:string,updated_at:string,body:string,content:string,text:string,description:string,"
    f"summary:string,sections:array<{SECTION}>>,"
    f"inner_hits:struct<matched_sections:struct<hits:struct<hits:array<struct<_score:double,_source:{SECTION}>>>>>>"
)
DOC_FIELDS = ("body", "content", "text", "description", "summary")
SECTION_FIELDS = ("content", "text")


def total_hits(response: Column) -> Column:
    """hits.total is a number or an object with a value."""
    v = F.parse_json(response)
    return F.coalesce(
        F.try_variant_get(v, "$.hits.total.value", "bigint"), F.try_variant_get(v, "$.hits.total", "bigint"), F.lit(0)
    )


def parse_response(responses: DataFrame, column: str = "response") -> DataFrame:
    """query_id, response -> one row per hit: query_id, total, pos, hit."""
    parsed = F.from_json(F.get_json_object(F.col(column), "$.hits.hits"), f"array<{HIT}>")
    return responses.select(
        "query_id", total_hits(F.col(column)).alias("total"), F.posexplode(parsed).alias("pos", "hit")
    )


def first_filled(record: Column, fields) -> Column:
    return F.coalesce(*[F.nullif(record[f], F.lit("")) for f in fields])


def extract_passages(
    hits: DataFrame,
    max_sections: int = 5,
    min_chars: int = 80,
    max_chars: int = 1200,
    doc_fields=DOC_FIELDS,
    section_fields=SECTION_FIELDS,
) -> DataFrame:
    """hits: keys..., hit -> passages with the path they came from.

    Inner hits first; then the first three sections; then the first filled document field.
    """
    h, src = F.col("hit"), F.col("hit._source")

    def passage(text, section_title, score, path):
        return F.struct(
            X.strip(text).alias("text"), section_title.alias("section_title"), score.alias("score"), F.lit(path).alias("path")
        )

    def kept(a):
        return F.filter(F.coalesce(a, F.array()), lambda p: F.coalesce(p["text"], F.lit("")) != "")

    inner = kept(
        F.transform(
            F.slice(h["inner_hits"]["matched_sections"]["hits"]["hits"], 1, max_sections),
            lambda s: passage(
                first_filled(s["_source"], section_fields),
                F.coalesce(s["_source"]["title"], s["_source"]["heading"]),
                F.coalesce(s["_score"], h["_score"]),
                "inner_hits",
            ),
        )
    )
    nested = kept(
        F.transform(
            F.slice(src["sections"], 1, 3),
            lambda s: passage(
                first_filled(s, section_fields), F.coalesce(s["title"], s["heading"]), h["_score"], "sections.content"
            ),
        )
    )
    flat = F.coalesce(
        *[
            F.when(
                F.coalesce(X.strip(src[f]), F.lit("")) != "",
                F.array(passage(src[f], F.lit(None).cast("string"), h["_score"], f)),
            )
            for f in doc_fields
        ],
        F.array(),
    )
    keys = [c for c in hits.columns if c != "hit"]
    staged = hits.withColumns({"_inner": inner, "_nested": nested, "_flat": flat})
    chosen = F.when(F.size("_inner") > 0, F.col("_inner")).when(F.size("_nested") > 0, F.col("_nested")).otherwise(
        F.col("_flat")
    )
    out = staged.select(*keys, "hit", F.posexplode(chosen).alias("passage_no", "p")).select(
        *keys,
        h["_id"].alias("doc_id"),
        h["_index"].alias("idx"),
        "passage_no",
        X.collapse(F.col("p.text")).alias("text"),
        "p.section_title",
        "p.score",
        "p.path",
        src["title"].alias("title"),
        src["page_url"].alias("page_url"),
        F.map_filter(
            F.create_map(
                F.lit("heading"), F.col("p.section_title"),
                F.lit("url"), src["page_url"],
                F.lit("utility_name"), src["utility_name"],
                F.lit("content_type"), src["content_type"],
                F.lit("updated_at"), src["updated_at"],
            ),
            lambda k, v: v.isNotNull(),
        ).alias("meta"),
    )
    return out.where(F.length("text").between(min_chars, max_chars))


def full_body(fields: dict) -> Column:
    """First text field of more than 100 characters, else title, summary, text and content joined."""
    null = F.lit(None).cast("string")
    long = [fields.get(f, null) for f in ("body", "full_text", "content", "text", "snippet")]
    parts = [F.nullif(fields.get(f, null), F.lit("")) for f in ("title", "summary", "text", "content")]
    return F.coalesce(*[F.when(F.length(c) > 100, c) for c in long], F.concat_ws(" ", *parts))
