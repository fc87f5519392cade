"""Toxicity by non-negative positive-unlabelled learning.

A numpy classifier learns from confirmed toxic documents (P) and unlabelled text (U).  With the class prior p the risk is
p * R_P(+) + max(0, R_U(-) - p * R_P(-)): what unlabelled text costs as negative, less the share that is positive after
all.  Where the bracket turns negative the step goes back up its gradient, so the classifier cannot overfit the positives.

Features are a text's distinct words and the words' first PREFIXES letters (stems of inflected words), those only whose
frequency in P exceeds what the whole sample lets expect by SCREEN standard deviations: a few thousand confirmed examples
cannot support a weight for every word of a language.

It is fitted on at most about POSITIVES and UNLABELLED documents and VOCABULARY words, so the model has a fixed size;
scores read every word of every text.  The prior is the toxic share of the labelled rows it may learn from.  Nulls: a null
text is empty and scores like one; labels that are null teach nothing; of several labels of one document the highest
counts.  Without any positive the classifier says 0 for all.  Ids may be null or repeat; rows stay rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm.common import give_back, written

POSITIVES = 10_000
UNLABELLED = 15_000
VOCABULARY = 1 << 16
PREFIXES = (4, 5)
#: A feature needs so many positive documents, and so many standard deviations more than expected.
SUPPORT, SCREEN = 5, 5.0
STEPS, RATE, DECAY, TOLERANCE = 300, 0.1, 1e-4, 0.0
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Classifier:
    words: dict[str, int]
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of the toxic class; a feature counts once per text."""
        out = np.full(len(texts), self.bias)
        for k, text in enumerate(texts):
            known = self.words.keys() & features(text)
            if known:
                out[k] += self.weights[[self.words[f] for f in known]].sum()
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def features(text: str | None) -> set[str]:
    """Distinct words, and their first letters marked by a hyphen."""
    words = set(LETTERS.findall(text.lower())) if text else set()
    return words.union(*({w[:n] + "-" for w in words if len(w) >= n} for n in PREFIXES))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], words: dict[str, int], prior: float) -> Classifier:
    """Fit on the numbers of the features of each sample document."""
    if not words or not positive or not unlabelled or not 0 < prior < 1:
        return Classifier({}, np.zeros(1), -20.0)
    docs = positive + unlabelled
    owner, index = np.repeat(np.arange(len(docs)), [len(i) for i in docs]), np.concatenate(docs).astype(np.int64)
    n_p, n_u, size = len(positive), len(unlabelled), max(1, len(words))
    is_p = np.arange(len(docs)) < n_p
    theta, moment, square = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    theta[-1] = base = np.log(prior / (1 - prior))
    for step in range(1, STEPS + 1):
        z = theta[-1] + np.bincount(owner, theta[index], len(docs))
        sigmoid = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        as_negative = np.logaddexp(0, z)
        bracket = as_negative[~is_p].mean() - prior * as_negative[is_p].mean()
        up = np.where(is_p, -prior * sigmoid / n_p, sigmoid / n_u)  # gradient of the bracket
        pull = up + np.where(is_p, prior * (sigmoid - 1) / n_p, 0) if bracket >= -TOLERANCE else -up
        grad = np.append(np.bincount(index, pull[owner], size), pull.sum())
        grad[:-1] += DECAY * theta[:-1]
        moment, square = 0.9 * moment + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        theta -= RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        np.maximum(theta[:-1], 0, out=theta[:-1])  # the screen let through signs of the positive class only
        theta[-1] = min(theta[-1], base)  # so a text without any is no likelier positive than the prior
    return Classifier(words, theta[:-1], float(theta[-1]))


def _features(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 100):  # a long text has tens of thousands of features
            part = batch.slice(a, 100)
            found = pa.array([sorted(features(t)) for t in part.column("text").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([part.column("confirmed"), found], ["confirmed", "features"])
            del part, found
    give_back()


def screen(sample: DataFrame) -> dict[str, int]:
    """Numbers of the features of rows (confirmed, features) that stand out in the confirmed documents."""
    docs = sample.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("confirmed").cast("int")).alias("p")).first()
    share = (docs["p"] or 0) / max(1, docs["n"])
    counts = sample.select("confirmed", F.explode("features").alias("f")).groupBy("f").agg(
        F.sum(F.col("confirmed").cast("int")).alias("x"), F.count(F.lit(1)).alias("n")
    )
    excess = F.col("x") - F.col("n") * share
    kept = counts.where((F.col("x") >= SUPPORT) & (excess >= SCREEN * F.sqrt(F.col("n") * share * (1 - share))))
    return {r["f"]: k for k, r in enumerate(kept.orderBy(excess.desc(), "f").limit(VOCABULARY).collect())}


def _share(size: int, most: int) -> int:
    """The part of 2 ** 24 hash values that leaves about most of size rows."""
    return int(min(1.0, most / max(size, 1)) * (1 << 24))


def _sample(rows: DataFrame, size: int, most: int) -> DataFrame:
    """About most of size rows, by a hash of the text and id, whatever their order."""
    return rows.where(F.pmod(F.xxhash64("text", "id"), F.lit(1 << 24)) < F.lit(_share(size, most)))


def fit(learnable: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Classifier:
    """Learn from rows (id, text) and labels (id, toxic); rows without a label, or with label 0, are unlabelled text."""
    marks = labels.where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    # ids alone meet the labels; of the toxic ones about `positives` are drawn and sent to the rows, so no text is shuffled
    known = written(learnable.groupBy("id").count().join(marks, "id"), "labelled")
    size = known.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("p")).first()
    drawn = known.where("toxic = 1").where(F.pmod(F.xxhash64("id"), F.lit(1 << 24)) < F.lit(_share(size["p"] or 0, positives)))
    n_drawn = drawn.agg(F.sum("count")).first()[0] or 0  # more than ids where rows repeat their id
    toxic_rows = learnable.join(F.broadcast(drawn.select("id")), "id", "left_semi")
    toxic_docs = _sample(toxic_rows, n_drawn, positives).select("text", F.lit(True).alias("confirmed"))
    sample = toxic_docs.union(_sample(learnable, learnable.count(), unlabelled).select("text", F.lit(False)))
    sample = written(sample.mapInArrow(_features, "confirmed boolean, features array<string>"), "toxicity")
    words = screen(sample)
    sent = learnable.sparkSession.sparkContext.broadcast(words)  # at most VOCABULARY

    def number(batches):
        kept = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                part = batch.slice(a, 100)
                at = [[kept[f] for f in fs if f in kept] for fs in part.column("features").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("confirmed"), pa.array(at, pa.list_(pa.int32()))], ["confirmed", "at"])

    rows = sample.mapInArrow(number, "confirmed boolean, at array<int>").toPandas()
    by_kind = [[np.asarray(a) for a in rows["at"][rows["confirmed"] == kind]] for kind in (True, False)]
    return train(*by_kind, words, (size["p"] or 0) / max(size["n"], 1))


def scorer(spark: SparkSession, model: Classifier):
    """A column function: text to the probability of the toxic class."""
    sent = spark.sparkContext.broadcast(model)  # of fixed size, see fit

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in batches:
            yield pd.Series(sent.value.score(text.tolist()))
            del text
        give_back()

    return run
