"""Pluggable models: text embedders and pair scorers.

Both run as Arrow batches inside tasks.  The defaults are deterministic and need no model, so jobs and tests run
anywhere; a deployment passes its own callable.
"""

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.functions import text as X
from quaestor.operators import ranking
from quaestor.session import settle

Embedder = Callable[[list[str]], np.ndarray]
PairScorer = Callable[[list[str], list[str]], np.ndarray]


def hash_embedder(dims: int = 64) -> Embedder:
    """Signed feature hashing of tokens, L2-normalised."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = xxhash.xxh64_intdigest(w)
                out[i, h % dims] += 1.0 if (h >> 32) & 1 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)

    return embed


#: Characters of a text that an embedder gets at a time.
PIECE_CHARS = 8192


def embed_pieces(
    texts: DataFrame, embedder: Embedder | None = None, dims: int = 64, batch: int = 64, retries: int = 3, chars: int = PIECE_CHARS
) -> DataFrame:
    """id, text -> id, piece, n_chars, embedding, error: every piece of every text.  Equal pieces are embedded once.

    A batch that fails `retries` times is halved until the pieces that fail stand alone; they come back without a vector
    and with the error, so one bad text neither stops the job nor takes its batch along.
    """
    embedder = embedder or hash_embedder(dims)
    norm = X.normalize_embed_text(F.col("text"))
    starts = F.sequence(F.lit(1), F.length("_norm"), F.lit(chars))
    pieces = texts.select(F.col("id"), norm.alias("_norm")).select("id", F.posexplode(F.transform(starts, lambda a: F.substr("_norm", a, F.lit(chars)))).alias("piece", "_text"))
    pieces = settle(pieces, "pieces")

    def embed(chunk: list[str]):
        """(vector, error) of each text."""
        for attempt in range(retries):
            try:
                vectors = np.asarray(embedder(chunk))
                break
            except Exception as e:
                reason = f"{type(e).__name__}: {e}"
        else:
            if len(chunk) == 1:
                return [(None, reason)]
            half = len(chunk) // 2
            return embed(chunk[:half]) + embed(chunk[half:])
        if vectors.shape != (len(chunk), dims):
            raise ValueError(f"embedder returned {vectors.shape}, expected {(len(chunk), dims)}")
        return [(v.astype(np.float32).tolist(), None) for v in vectors]

    def run(batches):
        for pdf in batches:
            done = []
            for start in range(0, len(pdf), batch):
                done += embed(pdf["_text"].iloc[start : start + batch].tolist())
            yield pd.DataFrame({"_text": pdf["_text"], "embedding": [v for v, _ in done], "error": [e for _, e in done]})

    vectors = pieces.select("_text").distinct().mapInPandas(run, "_text string, embedding array<float>, error string")
    return pieces.join(vectors, "_text").select("id", "piece", F.length("_text").alias("n_chars"), "embedding", "error")


def pooled(pieces: DataFrame, dims: int = 64) -> DataFrame:
    """id, embedding: the mean of a text's pieces weighted by their length, brought to length 1.

    A text any piece of which failed has no vector; its rows of embed_pieces say why (see quarantine).
    """
    weight = F.col("n_chars").cast("double")
    sums = [F.sum(F.get("embedding", F.lit(k)) * weight).alias(f"s{k}") for k in range(dims)]
    whole = pieces.groupBy("id").agg(F.max("error").alias("error"), *sums).where("error IS NULL")
    v = F.array(*[F.col(f"s{k}") for k in range(dims)])
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return whole.select("id", F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)).cast("float")).alias("embedding"))


def quarantine(pieces: DataFrame) -> DataFrame:
    """id, piece, n_chars, error of everything that could not be embedded."""
    return pieces.where("error IS NOT NULL").drop("embedding")


def embed_texts(texts: DataFrame, embedder: Embedder | None = None, dims: int = 64, batch: int = 64, retries: int = 3) -> DataFrame:
    """id, text -> id, embedding of the whole text.  Texts that could not be embedded are left out: see embed_pieces."""
    return pooled(embed_pieces(texts, embedder, dims, batch, retries), dims)


def score_pairs(pairs: DataFrame, scorer: PairScorer | None = None) -> DataFrame:
    """Add pair_score to query_id, query, doc_id, text rows; the default is the lexical relevance, without Python."""
    if scorer is None:
        return X.with_relevance(pairs, name="pair_score")

    def run(batches):
        for pdf in batches:
            scores = np.zeros(len(pdf))
            step = len(pdf) if len(pdf) <= 4 else 16
            for start in range(0, len(pdf), max(step, 1)):
                part = pdf.iloc[start : start + step]
                try:
                    scores[start : start + step] = scorer(part["query"].tolist(), part["text"].tolist())
                except Exception:
                    pass  # a failed batch keeps zeros, as the policy wants
            yield pdf.assign(pair_score=scores)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInPandas(run, f"{fields}, pair_score double")


def rerank(hits: DataFrame, scorer: PairScorer | None = None, top_k: int = 8, min_score: float = 0.1) -> DataFrame:
    """Score pairs, add the light hints, cut adaptively; a query that collapses keeps its fused order.

    hits: query_id, query, doc_id, rank, title, text.
    """
    hits = settle(hits)
    scored = score_pairs(hits, scorer).withColumn(
        "score", F.round(F.col("pair_score") + X.score_hints(F.col("text"), F.col("title")), 6)
    )
    kept = settle(
        ranking.rerank_select(
            scored.select("query_id", "doc_id", "score", (X.strip(F.col("text")) == "").alias("is_empty")), min_score, top_k
        )
    )
    sizes = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_kept"))
    collapsed = sizes.where("n_kept < 3").select("query_id")
    fused = (
        hits.join(collapsed, "query_id", "left_semi")
        .where(F.col("rank") <= 50)
        .select("query_id", "doc_id", F.lit(None).cast("double").alias("score"), "rank", F.lit("fused").alias("order_by"))
    )
    ok = kept.join(collapsed, "query_id", "left_anti").select(
        "query_id", "doc_id", "score", "rank", F.lit("scores").alias("order_by")
    )
    return ok.unionByName(fused)
