"""Small inline fixtures with stated results."""

import pytest
from pyspark.sql import functions as F

from quaestor.functions import text as X
from quaestor.functions import vectors as V


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "q string").select(fn(F.col("q")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "query, expected",
    [
        ("what is CIU", True),
        ("define CIU", True),
        ("a b c", True),
        ("API", True),
        ("how to configure CIU for production", False),
        ("step by step guide", False),
    ],
)
def test_definitional(spark, query, expected):
    assert one(spark, query, X.is_definitional) is expected


def test_synonyms_are_replaced_once(spark):
    assert one(spark, "etu and  Transaction Utility", X.normalize_query) == (
        "Enhanced Transaction Utility and Enhanced Transaction Utility"
    )
    assert one(spark, "idée de décade", X.normalize_query) == "idée Digital Events décade"


def test_acronyms(spark):
    assert one(spark, "what is ciu", X.expand_acronyms) == "what is Customer Interaction Utility CIU"
    assert one(spark, "CIU", X.query_variants) == ["CIU", "Customer Interaction Utility", "Customer Interaction Utility CIU"]


def test_semantic_keys_meet(spark):
    assert one(spark, "CIU onboarding guide", X.semantic_key) == one(spark, "ciu  onboarding docs", X.semantic_key)


def test_routes(spark):
    routes = {q: one(spark, q, X.route)["route"] for q in ("CIU?", "GET /api/v1/users", "list apis", "a vs b", "how do I setup it today", "", "tell me more about this one")}
    assert list(routes.values()) == ["general", "api", "list", "compare", "procedure", "general", "general"]


def test_comparison_entities(spark):
    assert tuple(one(spark, "difference between account utility and ETU", X.compare_entities)) == ("account utility", "ETU")
    assert one(spark, "nothing here", X.compare_entities) is None


def test_plan(spark):
    assert one(spark, "tell me about CIU", X.plan_aspects) == ["overview", "steps", "api"]
    assert one(spark, "fix CIU error", X.plan_aspects)[-1] == "troubleshoot"


def test_truncation(spark):
    text = "intro. " + "x" * 100 + " 1. first " + "y" * 100 + " 2. second " + "z" * 400
    assert one(spark, text, X.truncate_steps).endswith("y \n\n*[Additional steps available...]*")
    assert one(spark, "a" * 500, X.truncate_steps) == "a" * 397 + "..."


def test_trim(spark):
    assert one(spark, "One. Two is long", lambda c: X.trim_text(c, 8)) == "One."
    assert one(spark, "abcdefghij", lambda c: X.trim_text(c, 4)) == "abcd…"


def test_embedding_text_normalisation(spark):
    assert one(spark, "  a \n b ", X.normalize_embed_text) == "a b"
    assert one(spark, "   ", X.normalize_embed_text) == "[empty]"
    assert len(one(spark, "x" * 9000, X.normalize_embed_text)) == 9000
    assert len(one(spark, "x" * 9000, lambda c: X.normalize_embed_text(c, 8192))) == 8192


def test_cosine(spark):
    rows = [([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 0.0]
    bad = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    with pytest.raises(Exception, match="widths differ"):
        bad.select(V.cosine(F.col("a"), F.col("b"))).collect()


def test_one_decimal_is_rounded_as_printf_does(spark):
    values = [n / 100 for n in range(0, 1000)] + [k / 3 for k in range(50)] + [12.25, 12.75, 0.05, 99.95, 0.04999999999999999]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.one_decimal(F.col("v")).alias("s"))
    assert all(r["s"] == f"{r['v']:.1f}" for r in df.collect())
