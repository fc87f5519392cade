"""Language identification by words first, character n-grams where a word is unknown.

A word the model knows scores its log frequency in each language; an unknown word falls back to its character n-grams, the
longest length at which the model knows any, down to single characters.  A text's language is the one of the highest sum.

The model is fitted on a sample of at most about SAMPLE labelled documents per language, and keeps WORDS words and GRAMS
n-grams per language and length, so what is collected and sent to the executors has a fixed size; prediction reads every
word of every text.  Nulls and texts without a letter are `und` with score 0.  Documents without a language or text teach
nothing; with nothing learned at all every text is `und`.  Ids may be null or repeat; rows stay rows.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaestor.llm.common import give_back, written

SAMPLE = 4000
WORDS = 40_000
GRAMS = 20_000
LONGEST = 5
#: Added to counts, so that a word of one language has a finite score in the others.
SMOOTHING = 0.5
#: A text's score is the posterior as if its words numbered at most this many.
CONFIDENT = 20
#: Unknown words a task remembers (results do not depend on it).
REMEMBERED = 30_000
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


class Model:
    """Languages, and log frequencies per language of words and of n-grams: names and a matrix with a row for each."""

    def __init__(self, languages: list[str], words: dict[str, int], word_table, grams: dict[str, int], gram_table):
        self.languages, self.words, self.word_table, self.grams, self.gram_table = languages, words, word_table, grams, gram_table
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[str, int] = {}  # unknown words; their rows follow those of the known ones
        self.table = np.concatenate([self.word_table, np.zeros((1 << 12, len(self.languages)))])

    def word(self, word: str) -> np.ndarray:
        """Log frequency of a word per language, by n-grams where the word is unknown."""
        at = self.words.get(word)
        if at is not None:
            return self.word_table[at]
        marked = f"_{word}_"
        for n in range(min(LONGEST, len(marked)), 0, -1):
            known = [g for k in range(len(marked) - n + 1) if (g := self.grams.get(marked[k : k + n])) is not None]
            if known:
                return self.gram_table[known].mean(0)
        return np.zeros(len(self.languages))

    def place(self, word: str) -> int:
        at = self.words.get(word)
        if at is None:
            at = self.seen.get(word)
        if at is None:
            at = self.seen[word] = len(self.words) + len(self.seen)
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.zeros((len(self.seen), len(self.languages)))])
            self.table[at] = self.word(word)
        return at

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self.seen) > REMEMBERED:
            self._forget()
        found = [LETTERS.findall(t.lower()) if t else [] for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        places = np.fromiter((self.place(w) for ws in found for w in ws), np.int64, int(sizes.sum()))
        if not self.languages or not len(places):
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        owner = np.repeat(np.arange(len(found)), sizes)
        table = self.table[places]
        sums = np.stack([np.bincount(owner, table[:, k], len(found)) for k in range(len(self.languages))], 1)
        scaled = sums * np.minimum(1, CONFIDENT / np.maximum(sizes, 1))[:, None]
        best = scaled.argmax(1)
        score = 1 / np.exp(scaled - scaled.max(1, keepdims=True)).sum(1)
        names = [self.languages[b] if n else UNKNOWN for b, n in zip(best, sizes)]
        return names, np.where(sizes > 0, score, 0.0).tolist()


def _numbered(tables: dict[str, tuple[float, ...]], width: int) -> tuple[dict[str, int], np.ndarray]:
    return {key: k for k, key in enumerate(tables)}, np.array(list(tables.values()), np.float64).reshape(len(tables), width)


def _table(rows, languages: list[str], totals: dict[str, int]) -> dict[str, tuple[float, ...]]:
    """Log frequencies of keys per language."""
    counts: dict[str, list[int]] = defaultdict(lambda: [0] * len(languages))
    at = {name: k for k, name in enumerate(languages)}
    for r in rows:
        counts[r["key"]][at[r["lang"]]] = r["n"]
    base = [totals.get(name, 0) + 1 for name in languages]
    return {key: tuple(math.log((c + SMOOTHING) / b) for c, b in zip(cs, base)) for key, cs in counts.items()}


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from rows (id, text, lang)."""
    rows = labelled.where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    chosen = rows.join(F.broadcast(sizes), "lang").where(  # a row per language
        F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(sample) / F.col("docs") * (1 << 20)
    )
    words = (
        chosen.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("key"))
        .where("key <> ''")
        .groupBy("lang", "key")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    words = written(words, "words")  # of a sample of fixed size; read four times
    marked = F.concat(F.lit("_"), "key", F.lit("_"))
    at = F.explode(F.sequence(F.lit(1), F.length("marked") - F.col("size") + 1))
    grams = (
        words.select("lang", "n", marked.alias("marked"), F.explode(F.sequence(F.lit(1), F.lit(LONGEST))).alias("size"))
        .where("length(marked) >= size")
        .select("lang", "n", "size", "marked", at.alias("at"))
        .groupBy("lang", "size", F.substring("marked", F.col("at"), F.col("size")).alias("key"))
        .agg(F.sum("n").alias("n"))
    )

    def top(counts: DataFrame, keys: list[str], most: int) -> tuple[list, dict]:
        order = Window.partitionBy(*keys).orderBy(F.desc("n"), "key")
        kept = counts.where("n > 1").withColumn("place", F.row_number().over(order)).where(f"place <= {most}").collect()
        return kept, {tuple(r[k] for k in keys): r["n"] for r in counts.groupBy(*keys).agg(F.sum("n").alias("n")).collect()}

    word_rows, word_totals = top(words, ["lang"], WORDS)
    gram_rows, gram_totals = top(grams, ["lang", "size"], GRAMS)
    languages = sorted({r["lang"] for r in word_rows})
    by_size = defaultdict(list)
    for r in gram_rows:
        if r["lang"] in languages:
            by_size[r["size"]].append(r)
    grams = {}
    known = _numbered(_table(word_rows, languages, {k[0]: n for k, n in word_totals.items()}), len(languages))
    for size, some in by_size.items():
        grams |= _table(some, languages, {k[0]: n for k, n in gram_totals.items() if k[1] == size})
    return Model(languages, *known, *_numbered(grams, len(languages)))


def predictor(spark: SparkSession, model: Model):
    """A column function: text to struct(lang_pred, score).  A worker holds the model as long as its task runs."""
    sent = spark.sparkContext.broadcast((model.languages, model.words, model.word_table, model.grams, model.gram_table))  # of fixed size, see fit

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held = Model(*sent.value)
        for text in batches:
            parts = [held.predict(text.iloc[a : a + 200].tolist()) for a in range(0, len(text), 200)]
            yield pd.DataFrame({"lang_pred": [x for p in parts for x in p[0]], "score": [x for p in parts for x in p[1]]})
            del text, parts
        del held
        give_back()

    return run
