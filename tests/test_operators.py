"""Operators on small fixtures, against brute force where the result is not stated."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaestor.functions import text as X
from quaestor.operators import evaluate, filters, fusion, lexical, nearest, passages, quality, ranking, scoring
from quaestor.operators import spans as SP
from quaestor.sources import publish
from quaestor.session import shared_dir
from quaestor.streaming import jobs


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def brute_bm25(units, queries):
    toks = {u: [t for t in text.lower().split() if t not in X.R.STOP_WORDS] for u, text in units.items()}
    n, avg = sum(1 for t in toks.values() if t), np.mean([len(t) for t in toks.values() if t])
    out = {}
    for q, text in queries.items():
        for u, ts in toks.items():
            score = 0.0
            for term in text.lower().split():
                tf, df = ts.count(term), sum(term in x for x in toks.values())
                if tf:
                    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                    score += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / avg))
            if score:
                out[q, u] = round(score, 6)
    return out


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_bm25_against_brute_force_with_and_without_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", limit)
    rng = random.Random(7)
    # one word makes up a third of everything
    texts = {i: " ".join(rng.choice(["hot", "hot", "a1", "b2", "c3", "d4"]) for _ in range(rng.randint(1, 9))) for i in range(60)}
    queries = {1: "hot a1", 2: "d4 d4 zz", 3: "zz"}
    units = spark.createDataFrame([(i, 0, t) for i, t in texts.items()], "doc_id long, unit_no int, unit_text string")
    q = spark.createDataFrame(list(queries.items()), "query_id long, query string")
    got = {(r.query_id, r.doc_id): r.score for r in lexical.bm25(units, q, k=100).collect()}
    assert got == pytest.approx(brute_bm25(texts, queries), abs=1e-6)


def test_filters_keep_index_statistics(spark):
    units = spark.createDataFrame(
        [(i, 0, "x y" if i % 2 else "x z", i % 2 == 0) for i in range(10)],
        "doc_id long, unit_no int, unit_text string, keep boolean",
    )
    q = spark.createDataFrame([(1, "x y z")], "query_id long, query string")
    kept = rows(lexical.bm25(units, q).select("doc_id", "score"), "doc_id")
    everything = dict(rows(lexical.bm25(units.drop("keep"), q).select("doc_id", "score"), "doc_id"))
    assert [d for d, _ in kept] == [0, 2, 4, 6, 8]
    assert all(everything[d] == s for d, s in kept)


def test_knn_blocks_do_not_change_results(spark):
    rng = np.random.default_rng(1)
    c = [(int(i), v.tolist()) for i, v in enumerate(rng.normal(size=(90, 8)))]
    q = [(int(i), v.tolist()) for i, v in enumerate(rng.normal(size=(20, 8)))]
    corpus = spark.createDataFrame(c, "doc_id long, embedding array<float>").repartition(5)
    queries = spark.createDataFrame(q, "query_id long, embedding array<float>")
    whole = rows(nearest.knn(corpus, queries, 4), "query_id", "rank")
    small_blocks = rows(nearest.knn(corpus, queries, 4, block_bytes=3 * 64), "query_id", "rank")
    m, n = np.array([v for _, v in q], dtype=np.float32).astype(float), np.array([v for _, v in c], dtype=np.float32).astype(float)
    cos = (m @ n.T) / np.linalg.norm(m, axis=1)[:, None] / np.linalg.norm(n, axis=1)
    for i in range(20):
        best = sorted(range(90), key=lambda j: (-round((1 + cos[i, j]) / 2, 6), j))[:4]
        assert [r[1] for r in whole if r[0] == i] == best
    assert whole == small_blocks


def test_rrf_bound_and_raw_score(spark):
    a = spark.createDataFrame([(1, 10, 5.0, 1), (1, 11, 4.0, 2)], "query_id long, doc_id long, score double, rank int")
    b = spark.createDataFrame([(1, 10, 0.9, 1)], a.schema)
    got = rows(fusion.rrf(a, b).select("doc_id", "score", "raw_score"), "doc_id")
    assert got == [(10, round(2 / 61, 6), 0.9), (11, round(1 / 62, 6), 4.0)]


def test_dedupe_keeps_first_and_best(spark):
    h = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.8, 2), (1, 1, 0.7, 3)], "query_id long, doc_id long, score double, position int")
    assert rows(fusion.dedupe_docs(h).select("doc_id", "score", "rank"), "rank") == [(1, 0.9, 1), (2, 0.8, 2)]


def test_pair_similarity_formula():
    one = lambda a, b: fusion.similarities([a, b])[0, 1]
    assert one({"a": 1}, {"a": 3}) == pytest.approx(1.0)
    assert one({"a": 1}, {"b": 1}) == 0.0
    w = 1 + math.log(1.5)
    assert one({"a": 1, "b": 1}, {"a": 1, "c": 1}) == pytest.approx(1 / (1 + w * w))


def test_rerank_policy(spark):
    q = spark.createDataFrame([(1, "how to configure the thing today"), (2, "what is CIU")], "query_id long, query string")
    h = spark.createDataFrame(
        [(i, d, r, s) for i in (1, 2) for d, r, s in ((1, 1, 0.8), (2, 2, 0.6), (3, 3, 0.9))],
        "query_id long, doc_id long, rank int, pair_score double",
    )
    got = rows(ranking.rerank_policy(q, h).select("query_id", "doc_id", "rank", "reason"), "query_id", "rank")
    assert [g[1] for g in got if g[0] == 1] == [3, 1, 2] and got[0][3] == "ok"
    assert [g[1] for g in got if g[0] == 2] == [1, 2, 3] and got[-1][3] == "skipped_definitional"


def hits(spark, body):
    schema = f"query_id long, hit {passages.HIT}"
    return spark.read.schema(schema).json(spark.sparkContext.parallelize([body]))


def test_passages_from_inner_hits_sections_and_fields(spark):
    inner = """{"query_id":1,"hit":{"_id":"d","_index":"main","_score":0.5,"_source":{"title":"T"},"inner_hits":
    {"matched_sections":{"hits":{"hits":[{"_score":0.9,"_source":{"title":"Section 1","content":"First  text"}},
    {"_score":0.8,"_source":{"heading":"Section 2","text":"Second text"}}]}}}}}""".replace("\n", " ")
    got = rows(passages.extract_passages(hits(spark, inner), min_chars=0).select("text", "section_title", "score"), "score")
    assert got == [("Second text", "Section 2", 0.8), ("First text", "Section 1", 0.9)]
    nested = """{"query_id":1,"hit":{"_id":"d","_score":0.5,"_source":{"sections":[{"title":"A","content":"one"},{"heading":"B","text":"two"}]}}}"""
    got = rows(passages.extract_passages(hits(spark, nested), min_chars=0).select("section_title", "text", "path"), "text")
    assert got == [("A", "one", "sections.content"), ("B", "two", "sections.content")]
    flat = """{"query_id":1,"hit":{"_id":"d","_score":0.5,"_source":{"content":"from content","description":"other"}}}"""
    p = passages.extract_passages(hits(spark, flat), min_chars=0, doc_fields=("content", "body", "description"))
    assert rows(p.select("text", "path"), "text") == [("from content", "content")]


def test_passage_length(spark):
    p = spark.createDataFrame([(i, "x" * n) for i, n in enumerate((50, 200, 2000))], "id int, text string")
    assert [r["id"] for r in filters.passage_length(p).collect()] == [1]


def test_total_hits_number_or_object(spark):
    r = spark.createDataFrame([('{"hits":{"total":7}}',), ('{"hits":{"total":{"value":9}}}',), ("{}",)], "r string")
    assert sorted(x[0] for x in r.select(passages.total_hits(F.col("r"))).collect()) == [0, 7, 9]


def observations(spark, flags):
    data = [("i", f, "inner_hits" if f else "sections.content", n) for n, f in enumerate(flags)]
    return spark.createDataFrame(data, "idx string, has_inner_hits boolean, path string, n int").withColumn(
        "ts", F.timestamp_seconds("n")
    )


def test_schema_profile(spark):
    p = quality.schema_profile(observations(spark, [True] * 5))
    assert quality.reliable(p).first()["reliable"] and quality.preferred_paths(p).first()["preferred"][0] == "inner_hits"
    p = quality.schema_profile(observations(spark, [True] * 3 + [False] * 7))
    assert not quality.reliable(p).first()["reliable"]
    assert quality.preferred_paths(p).first()["preferred"][0] == "sections.content"


def test_document_validation(spark):
    schema = "doc_id string, title string, text string, metadata map<string,string>, updated_at string"
    d = spark.createDataFrame([("", "", "", None, "x"), ("1", "t", "b", {"a": "b"}, "2024-01-01T00:00:00Z")], schema)
    assert [len(r["errors"]) for r in filters.validate_documents(d).orderBy("doc_id").collect()] == [5, 0]


def test_spans_offsets_and_runs(spark):
    body = "Please ask the billing support team now. Create a Jira ticket.\n1. Do it\nmail dl: help-team@example.com"
    d = spark.createDataFrame([(1, "T", body, "u")], "doc_id long, title string, text string, page_url string")
    got = {(r["capability"], r["offset"]): r["text"] for r in SP.extract_spans(d).collect()}
    text = f"T\n{body}"
    import re

    for no, suite, name, capability, weight, p in SP.rule_rows():
        for m in re.finditer(p, text):
            assert got[capability, m.start()] is not None
    assert got["ticket.create", text.index("Create")] == "Create a Jira ticket"


def test_span_overlap_window(spark):
    s = [(1, 1, o, n, suite, "c", "t", 0.5, "x", "u", {}) for n, (o, suite) in enumerate([(0, "a"), (10, "a"), (20, "b"), (60, "a"), (100, "a")])]
    df = spark.createDataFrame(
        s,
        "query_id long, doc_id long, offset int, rule_no int, suite string, capability string, type string, confidence double, "
        "text string, url string, attrs map<string,string>",
    )
    assert [r["offset"] for r in SP.dedupe_spans(df).orderBy("offset").collect()] == [0, 20, 60]


def test_coverage(spark):
    q = spark.createDataFrame([(1, "enable Payment API")], "query_id long, query string")
    p = spark.createDataFrame(
        [(1, 1, 1, "1. Enable the Payment API\n2. done"), (1, 2, 2, "POST /payments to pay"), (1, 3, 3, "contact the owner team")],
        "query_id long, doc_id long, rank int, text string",
    )
    m = evaluate.answerability(evaluate.subqueries(q), p)
    assert all(0 <= r["a"] <= 1 for r in m.collect())
    g = evaluate.coverage_gate(m, p).first()
    assert g["recall"] >= 0.5 and g["n_actionable"] == 3 and g["gate_pass"]
    assert evaluate.aspect_recall(m, tau=0.99).first()["recall"] == 0.0


def test_embedding_batches_and_width(spark):
    t = spark.createDataFrame([(i, f"text {i % 3}") for i in range(9)], "id long, text string")
    e = scoring.embed_texts(t, batch=2).collect()
    assert len(e) == 9 and {len(r["embedding"]) for r in e} == {64}
    assert len({tuple(r["embedding"]) for r in e}) == 3
    with pytest.raises(Exception, match="expected"):
        scoring.embed_texts(t, embedder=lambda xs: np.zeros((len(xs), 3))).collect()


def test_embedding_reads_whole_texts(spark):
    long = "word " * 4000  # three pieces
    t = spark.createDataFrame([(1, long + "alpha"), (2, long + "beta"), (3, "alpha"), (4, None)], "id long, text string")
    got = {r["id"]: np.array(r["embedding"]) for r in scoring.embed_texts(t).collect()}
    assert not np.allclose(got[1], got[2])
    text = " ".join((long + "alpha").split())
    cuts = [text[a : a + 8192] for a in range(0, len(text), 8192)]
    want = sum(len(p) * scoring.hash_embedder()([p])[0].astype(float) for p in cuts)
    assert np.allclose(got[1], want / np.linalg.norm(want), atol=1e-6) and set(got) == {1, 2, 3, 4}


def test_failed_texts_are_set_aside_alone(spark):
    def picky(xs):
        if any("bad" in x for x in xs):
            raise RuntimeError("no")
        return np.ones((len(xs), 4))

    t = spark.createDataFrame([(i, "bad" if i == 5 else f"text {i}") for i in range(20)], "id long, text string").coalesce(1)
    pieces = scoring.embed_pieces(t, picky, 4, batch=8)
    assert [(r["id"], r["error"]) for r in scoring.quarantine(pieces).collect()] == [(5, "RuntimeError: no")]
    assert sorted(r["id"] for r in scoring.pooled(pieces, 4).collect()) == [i for i in range(20) if i != 5]


def test_similarities_equal_the_pairwise_formula():
    rng = np.random.default_rng(1)
    maps = [{f"t{w}": int(n) for w, n in zip(rng.choice(60, 20, replace=False), rng.integers(1, 5, 20))} for _ in range(12)] + [{}, {"only": 3}]

    def cosine(a, b):
        weigh = lambda x, y: sum((tf if t in y else tf * fusion.ONE_SIDED) ** 2 for t, tf in x.items())
        dot = sum(tf * b[t] for t, tf in a.items() if t in b)
        return dot / (weigh(a, b) * weigh(b, a)) ** 0.5 if dot else 0.0

    got = fusion.similarities(maps)
    assert all(abs(got[i, j] - cosine(a, b)) < 1e-12 for i, a in enumerate(maps) for j, b in enumerate(maps) if i != j)


def test_failed_scorer_gives_zeros(spark):
    def broken(q, t):
        raise RuntimeError

    p = spark.createDataFrame([(1, "q", 1, "t")], "query_id long, query string, doc_id long, text string")
    assert scoring.score_pairs(p, broken).first()["pair_score"] == 0.0


def test_versions(spark):
    path = shared_dir(spark, "versions")
    d = spark.createDataFrame([("main", 1)], "idx string, doc_id long")
    assert [publish.publish(d, path) for _ in range(3)] == [1, 2, 3]
    assert publish.read_current(spark, path).first()["version"] == 3


def events(spark, data):
    return spark.createDataFrame(data, "user_id long, t double, event_id long").select(
        "user_id", "event_id", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts"),
        F.lit("s").alias("stage"), F.lit("r").alias("req_id"), F.lit("start").alias("event"), F.lit(600.0).alias("ms"),
    )


def test_ttl_cache_against_a_loop(spark):
    rng = random.Random(3)
    data, n = [], 0
    for user, size in ((1, 200), (2, 5)):
        for t in sorted(rng.uniform(0, 300_000) for _ in range(size)):
            data.append((user, t, n))
            n += 1
    want = {}
    for user, t, _ in data:
        at, h, m = want.get(user, (None, 0, 0))
        t = int(t * 1_000_000)
        want[user] = (at, h + 1, m) if at is not None and t - at < 600_000_000 * 6 else (t, h, m + 1)
    got = {r["key"]: (r["hits"], r["misses"]) for r in jobs.ttl_cache(events(spark, data), ttl_s=3600).collect()}
    assert got == {u: (h, m) for u, (_, h, m) in want.items()}


def test_sessions_cross_buckets(spark):
    data = [(1, 3500.0, 1), (1, 3700.0, 2), (1, 7300.0, 3), (1, 20_000.0, 4)]
    got = jobs.timeline_batch(events(spark, data)).orderBy("started").collect()
    assert [r["n"] for r in got] == [2, 1, 1]
