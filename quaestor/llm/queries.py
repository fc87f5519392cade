"""Queries of the operators over their whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm import ans, backoff_lm, cover_tree, cws, importance, jaccard_join, langid, maxscore, packing, piece_bpe, prefix_trie, substring, toxicity
from quaestor.llm.common import crc_mod

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op2_token_files(spark, folder):
    return ans.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


@query
def op8_piece_bpe(spark, folder):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return piece_bpe.encode_documents(table(spark, folder, "documents"), path, public_tokenizers.PATTERN).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op9_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


@query
def op7_backoff_lm(spark, folder):
    return backoff_lm.score(table(spark, folder, "documents")).withColumn("score", F.round("score", 6))


ORACLES["op7_backoff_lm"] = backoff_lm.ORACLE


@query
def op6_jaccard_join(spark, folder):
    return jaccard_join.join(table(spark, folder, "documents"))


ORACLES["op6_jaccard_join"] = jaccard_join.ORACLE


@query
def op5_language_id(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    held_out = crc_mod(F.col("id"), 3) == 1
    model = langid.fit(docs.where(~held_out))
    found = docs.select("id", langid.predictor(spark, model)("text").alias("p"))
    return found.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "p.lang_pred", "p.score")


@query
def op10_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), "toxic")
    held_out = crc_mod(F.col("id"), 5) == 0
    model = toxicity.fit(docs.where(~held_out), labels.where(~held_out))
    found = docs.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), toxicity.scorer(spark, model)("text").alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op4_cws(spark, folder):
    return cws.fingerprints(table(spark, folder, "documents"))


@query
def op3_cover_tree(spark, folder):
    return cover_tree.near_duplicates(table(spark, folder, "embeddings"))


ORACLES["op3_cover_tree"] = cover_tree.ORACLE


@query
def op1_substring(spark, folder):
    return substring.passages(table(spark, folder, "documents"))


@query
def op13_importance(spark, folder):
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLES["op13_importance"] = importance.ORACLE


@query
def op12_maxscore(spark, folder):
    return maxscore.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLES["op12_maxscore"] = maxscore.ORACLE


@query
def op11_prefix_trie(spark, folder):
    turns, sizes = prefix_trie.rebuilt(prefix_trie.numbered(table(spark, folder, "conversations")), family=5, most=9)
    return prefix_trie.trie(turns, sizes)


ORACLES["op11_prefix_trie"] = prefix_trie.ORACLE
