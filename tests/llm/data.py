"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random
import re

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use inside
        T.StructField("id", T.StringType()),
        T.StructField("batch", T.IntegerType()),
        T.StructField("component", T.StringType()),
        T.StructField("tie", T.IntegerType()),
    ]
)
WORDS = {
    "en": "the of and house river stone cloud winter morning paper garden letter window silver road field market answer".split(),
    "de": "der und nicht strasse wolke winter garten brief fenster silber feld markt antwort morgen schnee haus weg licht".split(),
}


def prose(rng: random.Random, lang: str, n: int) -> str:
    words = [rng.choice(WORDS[lang]) + (rng.choice("abcdefgh") * rng.randint(0, 2)) for _ in range(n)]
    return " ".join(w.capitalize() if k % 11 == 0 else w + ("." if k % 11 == 10 else "") for k, w in enumerate(words))


def documents(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    texts = [(prose(rng, lang, rng.randint(20, 150)), lang) for lang in ("en", "de") for _ in range(25)]
    passage = prose(rng, "en", 60)
    base = texts[0][0]
    near = base.split(" ")
    near[len(near) // 2] = "changed"
    texts += [(base, "en"), (" ".join(near), "en"), (base.upper(), "en")]
    texts += [(prose(rng, "en", 30) + "\n" + passage + "\n" + prose(rng, "en", 30), "en") for _ in range(3)]
    texts += [(prose(rng, "de", 6000), "de"), ("", "en"), (" \t\n ", None), (None, "en"), ("one two", None), ("one two", "en")]
    texts += [("日本語 のテキスト  two  spaces \x85 é à\n\n x", None), ("12 34 %% 56", "de"), ("!" * 300, None)]
    rows = [(k, t, lang, "s0", len(t or ""), "x", k % 2, "c", 7) for k, (t, lang) in enumerate(texts)]
    return rows + [rows[3], (None, "text without an id", "en", None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def words(text: str | None) -> list[str]:
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)
