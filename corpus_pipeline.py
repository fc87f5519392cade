"""From a raw corpus to packed training sequences: language, toxicity, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame that is written as
Parquet and read again as the next stage's docs.  All but the last keep the columns of documents, whatever they are.
Nulls: a null text has no language and goes; rows without an id pass the passage stage as they are.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm import jaccard_join, langid, packing, substring, toxicity
from quaestor.llm.common import crc_mod, written

#: A text goes if its language is unknown or less likely than this.
LANGUAGE_SCORE = 0.5
TOXIC_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    known = docs.select(F.col("doc_id").cast("long").alias("id"), "text", "lang")
    model = langid.fit(known.where(crc_mod(F.col("id"), 3) != 1))
    judged = docs.withColumn("__language", langid.predictor(spark, model)("text"))
    good = (F.col("__language.lang_pred") != langid.UNKNOWN) & (F.col("__language.score") >= LANGUAGE_SCORE)
    return judged.where(good).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not read like the confirmed toxic ones."""
    learnable = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where(crc_mod(F.col("id"), 5) != 0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long").alias("id"), "toxic")
    model = toxicity.fit(learnable, labels.where(crc_mod(F.col("id"), 5) != 0))
    judged = docs.withColumn("__toxic", toxicity.scorer(spark, model)("text"))
    return judged.where(F.col("__toxic") < TOXIC_SCORE).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: of the smallest id, rows without an id last, then of the smallest hash.

    A row is decided by its id and text, so rows that share an id are apart if their texts differ; rows equal in both are
    repeats of one document, of which one stays.  Texts without words are no duplicates of anything and stay.
    """
    number = F.col("doc_id").cast("long")
    keyed = docs.withColumn("__key", F.shiftrightunsigned(F.xxhash64(number, "text"), 1))
    joined = jaccard_join.join(keyed.select(F.col("__key").alias("doc_id"), "text")).where("n_shingles > 0")
    groups = joined.groupBy(F.col("doc_id").alias("__key")).agg(F.min("component_id").alias("__group"))
    rows = written(keyed.select("__key", number.alias("__id")).join(groups, "__key"), "groups")
    firsts = rows.groupBy("__group").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "__key")).alias("f")).select("f.__key")
    first = keyed.join(firsts, "__key", "left_semi").dropDuplicates(["__key", "doc_id", "text"])
    none = keyed.join(groups, "__key", "left_anti")
    return first.union(none).select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has."""
    return substring.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one row per piece.  Workers that go on to other stages or runs keep no encoder."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, keep=False)


STAGES = [
    ("language", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("packing", pack),
]

#: Trained models and a tokenizer cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; all but the last are written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
