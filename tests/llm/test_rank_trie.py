"""Importance resampling, exact top-k and the prefix trie against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.llm import importance, maxscore, prefix_trie, queries
from tests.llm.data import documents, frame

# -- importance --------------------------------------------------------------------------------------------------------


def alnum(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def features(text, lo, hi):
    w = alnum(text)
    return [crc32(" ".join(w[k : k + n]).encode()) for n in range(lo, hi + 1) for k in range(len(w) - n + 1)]


def resampled(docs, target, percent, lo, hi, buckets, least):
    s, t = (Counter(c % buckets for x in texts for c in features(x, lo, hi)) for texts in ([d[1] for d in docs], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
    out = []
    for doc_id, text in docs:
        codes = features(text, lo, hi)
        weight = sum(gain(c % buckets) for c in codes) // len(codes) if codes else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, len(codes), weight, score, len(alnum(text)) >= least))
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = [(*r[:4], k + 1 if k < len(fit) * percent // 100 else None) for k, r in enumerate(fit)]
    return Counter(drawn + [(*r[:4], None) for r in out if not r[4]])


@pytest.mark.parametrize("lo, hi, percent, least", [(1, 1, 10, 20), (1, 2, 37, 3), (2, 3, 100, 0)])
def test_importance_equals_brute_force(spark, lo, hi, percent, least):
    docs = documents() + documents(2)[:20] + [documents()[4]] * 40
    target = ["river stone cloud winter", None, "", "ÄÖ river 42"]
    goal = spark.createDataFrame([(x, "other") for x in target], "text string, id string")
    got = importance.resample(frame(spark, docs), goal, percent, lo, hi, 50, least).collect()
    assert Counter(tuple(r) for r in got) == resampled([d[:2] for d in docs], target, percent, lo, hi, 50, least)


def test_importance_cuts_equal_rows_apart(spark):
    rows = spark.range(0, 3000, 1, 8).select(F.lit(7).cast("long").alias("id"), *(F.lit(k).cast("long").alias(c) for k, c in enumerate(["n_words", "n_features", "weight", "score"])))
    runs = importance.sorted_runs(rows)
    cuts = importance.splitters(runs, 3000, 8)
    sizes = [r["count"] for r in importance.with_segments(runs, cuts).groupBy("segment").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 3000 / 8
    ranks = [r["rank"] for r in importance.ranked(runs, 3000, 2000).collect()]
    assert sorted(r for r in ranks if r) == list(range(1, 2001)) and ranks.count(None) == 1000


def test_importance_of_empty_tables(spark):
    docs, none = frame(spark, documents()[:5]), spark.createDataFrame([], "text string")
    assert importance.resample(frame(spark, []), none).count() == 0
    assert {tuple(r)[:4] for r in importance.resample(docs, none).collect()} == {
        r[:4] for r in resampled([d[:2] for d in documents()[:5]], [], 10, 1, 1, 10_000, 20)
    }


def test_features_of_long_texts_are_those_of_the_whole(monkeypatch):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abÄ.") for _ in range(rng.randint(0, 9))) for _ in range(300)) + "x" * 100 + "!!"
    whole = Counter(features(text, 1, 3))
    for piece in (5, 16, 64, 1 << 20):
        monkeypatch.setattr(importance, "PIECE", piece)
        found = list(importance._features(text.encode(), 1, 3))
        assert Counter(int(c) for _, codes in found for c in codes) == whole
        assert sum(n for n, _ in found) == len(alnum(text))


# -- top-k -------------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, row string, cell int, shard int"


def best(rows, k=10, every=100):
    limit = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    have = [
        (i, [limit(math.floor(1024.0 * x)) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in have:
        if q % every == 0:
            scores = sorted((-limit(sum(x * y for x, y in zip(a, b))), c) for c, b in have if c != q)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores)]
    return Counter(out)


def vectors(seed, n, dims, sparse=0.0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(5, dims))
    rows = (base[rng.integers(5, size=n)] + 0.1 * rng.normal(size=(n, dims))) * (rng.random((n, dims)) >= sparse)
    return [(k, [float(np.float32(x)) for x in row]) for k, row in enumerate(rows)]


ODD = [(None, [1.0, 2.0]), (200, None), (201, []), (300, []), (202, [None, 1.0]), (203, [float("nan")]), (204, [float("-inf")])]
ODD += [(400, [0.5, -0.25, 1.0]), (401, [0.0] * 8), (401, [0.0] * 8), (500, [-0.0001] * 8), (500, [-0.0001] * 8)]


@pytest.mark.parametrize("rows", [vectors(1, 150, 8) + ODD, vectors(2, 150, 40, 0.9) + ODD, ODD, ODD[:3], [], vectors(3, 101, 6) + [(600, [1e30, -1e30]), (601, [3e37, 1.0]), (700, [1e18, 1e18])]])
def test_top_k_equals_brute_force(spark, rows):
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], VECTORS).repartition(3)
    rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = maxscore.top_k(df, F.col("vec_id") % 100 == 0)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert Counter(map(tuple, got.collect())) == best(rows)


def test_top_k_over_several_cells_and_blocks(spark, monkeypatch):
    rows = vectors(4, 600, 16) + [(600 + k, vectors(4, 1, 16)[0][1]) for k in range(300)]  # one vector that a third share
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 100)
    monkeypatch.setattr(maxscore, "QUERY_BYTES", 8 * 16 * 2)
    monkeypatch.setattr(maxscore, "BLOCK_BYTES", 8 * 16 * 32)
    got = maxscore.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0)
    assert Counter(map(tuple, got.collect())) == best(rows)


def test_bounds_save_work():
    rows = np.array([[int(1024 * x) for x in v] for _, v in vectors(5, 4000, 32)])
    ids = np.arange(4000)
    search = maxscore.Search(ids[:20], rows[:20], 10)
    for at in range(0, 4000, 500):
        search.block(ids[at : at + 500], rows[at : at + 500])
    assert search.work < 0.8 * search.plain


# -- trie --------------------------------------------------------------------------------------------------------------

TURNS = T.StructType(
    [T.StructField(c, t) for c, t in (("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("p", T.StringType()), ("part", T.IntegerType()))]
)


def nodes(sequences):
    """Brute force: the contract's columns for {conv: [(role, text)]}."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[c] for c in children[path]) or 1
        own = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        saved[path] = own + sum(saved[c] for c in children[path])
    out = Counter()
    for path, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(sequences[c]) == len(path))
        up = min(members[path[:-1]]) if path else None
        row = (min(who), len(path), up, len(who), len(children[path]), leaves[path], saved[path])
        out[(*row, hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def plain(rows):
    out = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns, key=lambda t: t[:2])] for c, turns in out.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.choice([1, 2, 3, 8, 12])):
            rows.append((c, turn if turn or c % 3 else None, rng.choice(["user", "bot", None]), rng.choice(["a", "ü", "", None, "long " * 5]), "x", 1))
    rows += [(c, k, "user", str(k), "x", 1) for c in (n, n + 1, n + 5, n + 10) for k in range(60)]  # long copies
    rows += [(n + 15, k, "user", str(k) if k < 50 else "off", "x", 1) for k in range(70)]  # goes on differently
    rows += [(n + 20 + 5 * k, j, "user", "hi", "x", 1) for k in range(40) for j in range(2)]  # a hot class
    rows += [(None, 0, "user", "no id", None, None), (None, None, None, None, None, None), (n + 2, 0, "user", "z" * 100_000, "x", 1)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("path, again", [(3, True), (256, True), (3, False)])
def test_trie_equals_brute_force(spark, path, again):
    rows = conversations(7, 60)
    own = prefix_trie.numbered(spark.createDataFrame(rows, TURNS).repartition(4))
    if again:
        turns, sizes = prefix_trie.rebuilt(own, 5, 9)
    else:
        turns, sizes = prefix_trie.sequences(own)
    got = prefix_trie.trie(turns, sizes, path)
    want = nodes(rebuilt(plain(rows)) if again else plain(rows))
    assert Counter(map(tuple, got.collect())) == want


def test_turns_of_one_conversation_fill_many_tasks(spark):
    rows = [(5, k, "user", f"t{k % 7}", "x", 1) for k in range(900)] + [(6, 0, None, "b", "x", 1), (6, 0, None, "b", "x", 1)]
    own = prefix_trie.numbered(spark.createDataFrame(rows, TURNS).repartition(4))
    parts = own.where("conv = 5").groupBy("part").count().collect()
    assert len(parts) > 4 and max(r["count"] for r in parts) < 500
    assert sorted(r["p"] for r in own.where("conv = 5").collect()) == list(range(1, 901))
    assert own.where("conv = 5").agg(F.max("cum")).first()[0] == 1800
    turns, sizes = prefix_trie.sequences(own)
    assert Counter(map(tuple, prefix_trie.trie(turns, sizes, 4).collect())) == nodes(plain(rows))


def test_no_conversations_no_nodes(spark):
    df = spark.createDataFrame([(None, 1, "a", "b", None, None)], TURNS)
    for rows in (df, df.limit(0)):
        turns, sizes = prefix_trie.rebuilt(prefix_trie.numbered(rows), 5, 9)
        assert prefix_trie.trie(turns, sizes).count() == 0


def test_find_close_matches_a_stack(monkeypatch):
    rng = random.Random(9)
    for block, n in ((4, 1), (4, 3), (4, 400), (64, 3000)):
        monkeypatch.setattr(prefix_trie, "BLOCK", block)
        bits, open_now = [1], 1
        while len(bits) < n or open_now > 1:
            up = open_now == 1 or len(bits) < n and rng.random() < (0.5 if len(bits) % 200 < 100 else 0.9)
            bits.append(int(up))
            open_now += 1 if up else -1
            if len(bits) > n and open_now == 1:
                break
        bits += [0] * open_now
        stack, close = [], {}
        for k, b in enumerate(bits):
            if b:
                stack.append(k)
            else:
                close[stack.pop()] = k
        shape = prefix_trie.Parentheses(np.array(bits))
        assert shape.find_close().tolist() == [close[k] for k, b in enumerate(bits) if b]


def test_registered_queries_equal_brute_force(spark, tmp_path):
    docs = documents()
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "river stone"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows, vecs = conversations(8, 40), vectors(6, 250, 12)
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    run = lambda name: Counter(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).collect()))
    assert run("op11_prefix_trie") == nodes(rebuilt(plain(rows)))
    assert run("op12_maxscore") == best(vecs)
    assert run("op13_importance") == resampled([d[:2] for d in docs], ["river stone", None], 10, 1, 1, 10_000, 20)
