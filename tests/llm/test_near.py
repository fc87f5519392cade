import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quaestor.llm import backoff_lm, common, counting, cover_tree, cws, jaccard_join, substring
from tests.llm.data import documents, frame, words


def groups(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < 5 else set(zip(*(w[k:] for k in range(5))))


def test_words_are_cut_as_the_contract_says():
    texts = ["A b\tC\x0bd e", "", " \n", "ÀB ÀB aÀB", "x" * 100]
    found = list(common.word_hashes(pa.array(texts)))
    counts = [c for f in found for c in f[2]]
    assert counts == [len(words(t)) for t in texts]
    flat = [w for t in texts for w in words(t)]
    hashes = np.concatenate([f[1] for f in found])
    assert len(set(hashes.tolist())) == len(set(flat))


def test_components(spark):
    chain = [(k, k + 1) for k in range(20, 60)] + [(3, 3), (7, 5), (5, 9), (100, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    nodes = {n for e in chain if e[0] != e[1] for n in e}
    assert got == groups(nodes, [e for e in chain if e[0] != e[1]])
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_counting_packs_keys_exactly():
    rng = np.random.default_rng(0)
    for keys in (np.unique(rng.integers(0, 1 << 56, 1000, np.uint64)), np.array([5], np.uint64), np.array([0, 1 << 55], np.uint64)):
        assert (counting.unpack_keys(counting.pack_keys(keys)) == keys).all()


def test_signatures_meet_for_every_linked_pair():
    """Pairs at the threshold share an entry whatever the split into rare and frequent shingles."""
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 60)
        order = list(range(1, 200))
        x = set(rng.sample(order, n))
        y = set(x)
        for _ in range(rng.randint(0, max(1, n // 5))):
            y.discard(rng.choice(sorted(y)))
            y.add(rng.choice(order))
        if not jaccard_join.linked(len(x & y), len(x), len(y)):
            continue
        for cut in (200, 100, 30, 0):
            entry = lambda s: set(jaccard_join.signatures(len(s), np.array(sorted(s), np.uint64), sum(k >= cut for k in s)).tolist())  # noqa: E731, B023
            assert entry(x) & entry(y), (x, y, cut)


def test_jaccard_join(spark, monkeypatch):
    rows = documents()
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 400)}" for _ in range(80)]
    for k in range(40):  # a group of near copies, some beyond the threshold
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(80)] = f"v{rng.randint(0, 50)}"
        rows.append((1000 + k, " ".join(w), "en", "s1", 1, None, None, None, None))
    monkeypatch.setattr(jaccard_join, "FREQUENT", 6)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    got = jaccard_join.join(frame(spark, rows)).collect()
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = groups(sets, links)
    assert len(got) == len(rows) and len(set(want.values())) < len(want)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.doc_id is None or r.n_shingles == len(sets[r.doc_id])
    assert jaccard_join.join(frame(spark, [])).count() == 0


def test_compact_windows_are_the_nodes_of_the_tree():
    rng = np.random.default_rng(4)
    s = rng.integers(0, 1 << 63, 300, np.uint64)
    row = np.repeat([0, 1], [200, 100])
    h = common.mix(s ^ np.uint64(common.mix_one(9))) & np.uint64(0xFFFFFFFF00000000)

    def nodes(a, b):
        if b - a < 20:
            return []
        c = a + int(np.argmin(h[a:b]))
        return nodes(a, c) + [(max(a, c - 19), c, min(b - 1, c + 19))] + nodes(c + 1, b)

    found = list(zip(*(x.tolist() for x in substring.compact_windows(s, row, 9, 20))))
    assert sorted(found) == sorted(nodes(0, 200) + nodes(200, 300))


@pytest.mark.parametrize("size", [50, 55, 62, 70])
@pytest.mark.parametrize("edit", ["substitute", "insert", "delete"])
def test_verify_finds_every_edited_passage(size, edit):
    """One edit at any place: wherever a shared shingle is the minimum, the best stretches are found, as brute force finds them."""
    rng = np.random.default_rng(size)
    W = substring.WIDTH
    tokens = lambda n: rng.integers(0, 1 << 63, n, np.uint64)
    passage = tokens(size)
    for k in range(size):
        other = {
            "substitute": [passage[:k], tokens(1), passage[k + 1 :]],
            "insert": [passage[:k], tokens(1), passage[k:]],
            "delete": [passage[:k], passage[k + 1 :]],
        }[edit]
        x, y = (common.grams(np.concatenate([tokens(30), *p, tokens(30)]), 5) & np.uint64(0xFFFF) for p in ([passage], other))
        x, y = x.astype(np.uint16), y.astype(np.uint16)
        n = size - 4
        for at in {30, 30 + k // 2, 30 + n // 2, 30 + n - 1}:
            here = np.flatnonzero(y == x[at])
            if not len(here):
                continue
            at_y = int(here[0])
            u, v = x[max(0, at - W + 1) : at + W], y[max(0, at_y - W + 1) : at_y + W]
            p, q = min(at, W - 1), min(at_y, W - 1)
            best = 0  # over all stretches of W and W + 1 shingles that hold the minimum
            for wide in (W, W + 1):
                for wide_y in (W, W + 1):
                    for a in range(max(0, p - wide + 1), min(p, len(u) - wide) + 1):
                        for c in {q - p + a + s for s in (-1, 0, 1)}:
                            if max(0, q - wide_y + 1) <= c <= min(q, len(v) - wide_y):
                                s, t = set(u[a : a + wide].tolist()), set(v[c : c + wide_y].tolist())
                                best = max(best, len(s & t) / len(s | t))
            found = substring.verify(u, p, v, q)
            assert (found is not None) >= (best >= 0.75), (k, at, best)
            if found:
                a, b, c, d, similarity = found
                assert a <= p <= b < len(u) and c <= q <= d < len(v) and min(b - a, d - c) + 1 >= W and 0.75 <= similarity <= 1
                s, t = set(u[a : b + 1].tolist()), set(v[c : d + 1].tolist())
                assert len(s & t) >= 0.74 * len(s | t)


def test_substring(spark):
    rows = documents()
    docs = frame(spark, rows)
    got = substring.passages(docs).toPandas()
    seen, covered = {}, defaultdict(set)
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(r[1])
        for k in range(len(w) - 49):
            if seen.setdefault(tuple(w[k : k + 50]), r[0]) != r[0]:
                covered[r[0]].update(range(k, k + 50))
    found = defaultdict(set)
    for p in got.itertuples():
        assert p.other_doc_id < p.doc_id and p.similarity >= 0.75 and p.n_words >= 50
        found[p.doc_id].update(range(p.first_word, p.first_word + p.n_words))
    assert covered and all(covered[i] <= found[i] for i in covered)
    texts = {r[0]: r[1] for r in rows}
    clean = [i for i in texts if i is not None and i not in found]
    left = {r.doc_id: r.text for r in substring.without_repeats(docs).collect()}
    assert all(left[i] == texts[i] for i in clean)
    assert all(len(words(left.get(i, ""))) == len(words(texts[i])) - len(found[i]) for i in found)
    assert substring.without_repeats(docs).columns == docs.columns
    assert substring.passages(frame(spark, [])).count() == 0 and substring.without_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("block", [3, 2048])
def test_substring_compares_all_windows_of_a_key(spark, monkeypatch, block):
    """Repeats whose first relative in the key is another one: edited siblings, and passages around a line of all documents."""
    monkeypatch.setattr(substring, "BLOCK", block)
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(1 << 40)}" for _ in range(n)]
    rows, want = [], []

    def add(w):
        rows.append((len(rows), " ".join(w), "en", "s1", 1, None, None, None, None))
        return len(rows) - 1

    line = fresh(30)
    for _ in range(12):
        o = fresh(60)
        a, b = list(o), list(o)
        a[15], b[45] = fresh(2)
        add(a)  # shares 46 of 66 shingles with b, o shares 51 of 61
        want.append((add(o), add(b)))
    for _ in range(12):
        add(fresh(40) + line + fresh(40))
    for _ in range(6):
        p = fresh(10) + line + fresh(10)
        want.append((add(fresh(40) + p + fresh(40)), add(fresh(40) + p + fresh(40))))
    found = {(p.other, p.doc) for p in substring.links(frame(spark, rows)).collect()}
    assert not [pair for pair in want if pair not in found]
    assert all(a < b for a, b in found)


def test_bounds_of_spans_hold():
    rng = np.random.default_rng(6)
    where, n_found = np.full((1 << 16) + 1, -1, np.int16), 0
    for k in range(400):
        span = rng.integers(0, 1 << 16 if k % 4 else 60, 91).astype(np.uint16)
        others, places = [], []
        for _ in range(5):
            w, at = span.tolist(), 45
            for _ in range(rng.integers(0, 5)):
                cut = int(rng.integers(0, len(w)))
                if abs(cut - at) > 5:
                    new = rng.integers(0, 1 << 16, rng.integers(0, 6)).tolist()
                    if cut < at:
                        at += len(new) - len(w[cut : cut + 5])
                    w[cut : cut + 5] = new
            others.append(np.array(w[max(0, at - 45) : at + 46], np.uint16))
            places.append(min(at, 45))
        table = np.full((5, 91), 1 << 16, np.int32)
        for o, w in enumerate(others):
            table[o, : len(w)] = w
        first, last, held = substring._reach(span, 45, table, where)
        assert (where == -1).all()
        for o, w in enumerate(others):
            found = substring.verify(span, 45, w, places[o])
            if found:
                inside = [p for p in range(found[0], found[1] + 1) if span[p] in w]
                n_found += 1
                assert first[o] <= inside[0] and inside[-1] <= last[o] and held[o] >= 35
    assert n_found > 500


def test_best_stretch_of_runs_is_that_of_all_ends():
    """The search over runs gives what trying any two ends in one span with any two in the other gives."""
    rng, n_found = np.random.default_rng(8), 0
    for k in range(600):
        one = rng.integers(0, 1 << 16 if k % 3 else 200, 91).tolist()
        two, at = list(one), 45
        for _ in range(rng.integers(0, 6)):
            cut = int(rng.integers(0, len(two)))
            if abs(cut - at) > 5:
                new = rng.integers(0, 1 << 16, rng.integers(0, 6)).tolist()
                at += len(new) - len(two[cut : cut + 5]) if cut < at else 0
                two[cut : cut + 5] = new
        repeated = {v for values in (one, two) for v in values if values.count(v) > 1}
        where = {name: j for j, name in enumerate(substring._names(two, at, repeated))}
        pairs = [(i, where[name]) for i, name in enumerate(substring._names(one, 45, repeated)) if name in where]
        runs = substring._runs(pairs)
        if runs is not None:
            found = substring._best(runs, 45)
            n_found += found is not None
            want = substring._best_of_many(pairs, 45, at)
            assert (found is None) == (want is None)
            assert found is None or abs(found[4] - want[4]) < 1e-6 and found[:4] == want[:4]
    assert n_found > 200


def test_rare_shingles_look_up_all_that_can_match():
    rng = np.random.default_rng(12)
    pool = rng.integers(0, 1 << 16, 300)
    spans = [rng.choice(pool[: 60 + 60 * (k % 5)], rng.integers(46, 92)).astype(np.uint16) for k in range(200)]
    index = substring._Rare(spans)
    for k, span in enumerate(spans):
        near = [o for o in range(k) if np.isin(span, spans[o]).sum() >= substring.LEAST]
        assert set(near) <= set(index.sharing(span, k).tolist())


@pytest.mark.parametrize("indexed", [6, 256])
def test_equal_windows_of_a_cell_are_one_class(spark, monkeypatch, indexed):
    """Copies of a passage in many documents, some of them edited or twice in one document: all are linked to an earlier one."""
    monkeypatch.setattr(substring, "INDEXED", indexed)
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(1 << 40)}" for _ in range(n)]
    p, rows = fresh(80), []
    for k in range(60):
        q = list(p)
        if k % 3 == 0:
            q[rng.randrange(80)] = fresh(1)[0]
        rows.append((k, " ".join(fresh(60) + q + fresh(60) + (p if k % 7 == 0 else [])), "en", "s1", 1, None, None, None, None))
    found = substring.passages(frame(spark, rows)).collect()
    covered = {k: [(r.first_word, r.first_word + r.n_words) for r in found if r.doc_id == k] for k in range(60)}
    assert not covered[0]
    for k in range(1, 60):
        wanted = [(60, 140)] + ([(200, 280)] if k % 7 == 0 else [])
        assert all(any(a <= x + 5 and b >= y - 5 for a, b in covered[k]) for x, y in wanted), (k, covered[k])
        for a, b in covered[k]:  # a stretch may reach beyond what is repeated as far as its similarity allows
            assert sum(max(0, min(b, y) - max(a, x)) for x, y in wanted) >= 0.7 * (b - a), (k, covered[k])


def test_substring_recall_of_edited_passages(spark):
    """Passages of 50 to 59 words with one word substituted, inserted or left out, in other contexts: links against brute force."""
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(1 << 40)}" for _ in range(n)]
    rows, want = [], set()
    for k in range(1500):
        p = fresh(50 + k % 10)
        at = rng.randrange(len(p))
        q = [p[:at] + fresh(1) + p[at + 1 :], p[:at] + fresh(1) + p[at:], p[:at] + p[at + 1 :]][k % 3]
        x, y = (shingles(" ".join(w)) for w in (p, q))
        if min(len(p), len(q)) >= 50 and len(x & y) >= 0.75 * len(x | y):
            want.add((2 * k, 2 * k + 1))
        rows += [(2 * k + n, " ".join(fresh(40) + w + fresh(40)), "en", "s1", 1, None, None, None, None) for n, w in enumerate((p, q))]
    found = {(r.other, r.doc) for r in substring.links(frame(spark, rows)).collect()}
    print(f"recall {len(want & found)} of {len(want)}")
    assert len(want) > 1000 and len(want & found) >= 0.998 * len(want)


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows, centre = [], rng.normal(size=8)
    for k in range(150):
        v = centre + rng.normal(size=8) * 0.12 if k % 3 else rng.normal(size=8)
        rows.append((k, [float(x) for x in v.astype(np.float32)], k % 2))
    rows += [(200 + k, rows[1][1], 1) for k in range(4)] + [(300, [2 * x for x in rows[1][1]], 1)]
    rows += [(400, None, 1), (401, [0.0] * 8, 1), (402, [float("nan")] * 8, 1), (403, [None] + [1.0] * 7, 1), (404, rows[1][1], None)]
    return rows + [(405, rows[1][1][:4], 1), (406, [], 1), (None, rows[1][1], 1)]


@pytest.mark.parametrize("leaf", [16, 1024])
def test_cover_tree(spark, monkeypatch, leaf):
    monkeypatch.setattr(cover_tree, "LEAF", leaf)
    rows = vectors()
    got = {r.vec_id: r for r in cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    able = {}
    for k, (i, v, label) in enumerate(rows):
        if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v):
            a = np.array(v, np.float32).astype(float)
            able[k] = (a / np.linalg.norm(a), label, len(v))
    links = [(a, b) for a, b in itertools.combinations(able, 2) if able[a][1:] == able[b][1:] and able[a][0] @ able[b][0] >= 0.98]
    count = Counter(x for e in links for x in e)
    named = lambda k: rows[k][0] if rows[k][0] is not None else math.inf
    group = groups(range(len(rows)), links)
    low = defaultdict(lambda: math.inf)
    for k, g in group.items():
        low[g] = min(low[g], named(k))
    assert len(got) == len({r[0] for r in rows}) and len(links) > 100
    for k, r in enumerate(rows):
        one = got[r[0]]
        assert one.n_links == count[k]
        if r[0] is not None:
            assert one.component_id == low[group[k]] and one.kept == (r[0] == one.component_id)
    assert cover_tree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_cws(spark):
    rows = documents()
    got = cws.fingerprints(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_text = defaultdict(set)
    order = sorted({(r[0], r[1] or "") for r in rows if r[0] is not None}, reverse=True)
    edited = {}
    for (i, t), (_, following) in zip(order, order[1:]):
        k = len(t) // 3
        edited[i] = t[: len(t) - k] + following[:k]
    import hashlib

    texts = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    for r in got:
        if r.doc_id is not None:
            by_text[texts[r.doc_id]].add(r.fingerprint)
            assert r.n_chars == len(texts[r.doc_id])
            if r.doc_id in edited:
                assert r.edited_sha256 == hashlib.sha256(edited[r.doc_id].encode()).hexdigest()
    assert all(len(v) == 1 for v in by_text.values())
    assert cws.fingerprints(frame(spark, [])).count() == 0


def test_cws_estimates_generalised_jaccard(spark):
    rng = random.Random(7)
    base = [f"t{rng.randint(0, 60)}" for _ in range(300)]
    pairs, gaps = [], []
    for k in range(60):
        other = base[: 30 * (k % 10)] + [f"u{rng.randint(0, 60)}" for _ in range(150)]
        pairs.append((k, " ".join(base[k:] + [f"k{k}"]), " ".join(other)))
    df = spark.createDataFrame(pairs, "k long, a string, b string").withColumn("copies", F.lit(1))
    weighted = [cws.samples(cws.term_weights(df.select("k", "copies", F.col(c).alias("text")), ["k"]), ["k"]).withColumnRenamed("samples", c) for c in "ab"]
    got = {r.k: r.s for r in weighted[0].join(weighted[1], "k").select("k", cws.likeness("a", "b").alias("s")).collect()}
    for k, a, b in pairs:
        x, y = Counter(a.split()), Counter(b.split())
        want = sum((x & y).values()) / sum((x | y).values())
        gaps.append(got[k] - want)
    assert abs(np.mean(gaps)) < 0.03 and np.std(gaps) < 0.12


def test_backoff_lm(spark):
    rows = documents()
    got = backoff_lm.score(frame(spark, rows)).collect()
    docs = [words(r[1]) for r in rows]
    own = [[Counter(zip(*(w[j:] for j in range(n)))) for n in (1, 2, 3)] for w in docs]
    total = [sum((o[n] for o in own), Counter()) for n in range(3)]
    n_words = sum(map(len, docs))
    want = []
    for (w, o), r in zip(zip(docs, own), rows):
        logs = []
        for i in range(len(w)):
            rest = lambda *g, o=o: total[len(g) - 1][g] - o[len(g) - 1][g]
            s = rest(w[i]) / (n_words - len(w)) if rest(w[i]) else 1 / (n_words - len(w) + 1)
            if i > 0:
                s = rest(*w[i - 1 : i + 1]) / rest(w[i - 1]) if rest(*w[i - 1 : i + 1]) else 0.4 * s
            if i > 1:
                s = rest(*w[i - 2 : i + 1]) / rest(*w[i - 2 : i]) if rest(*w[i - 2 : i + 1]) else 0.4 * s
            logs.append(math.log10(s))
        want.append((r[0] is None, r[0] or 0, len(w), round(sum(logs) / len(w), 6) if w else None))
    have = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, None if r.score is None else round(r.score, 6)) for r in got)
    key = lambda r: (r[0], r[1], r[2])
    for a, b in zip(sorted(have, key=key), sorted(want, key=key)):
        assert a[:3] == b[:3] and (a[3] is None) == (b[3] is None) and (a[3] is None or abs(a[3] - b[3]) < 2e-6)
    assert backoff_lm.score(frame(spark, [])).count() == 0


def window(doc, words_before, passage, words_after, place):
    """A window of a cell: place is that of its minimum in the passage."""
    shingles = [*words_before, *passage, *words_after]
    at = len(words_before) + place
    first = max(0, at - substring.WIDTH + 1)
    span = np.array(shingles[first : at + substring.WIDTH], np.uint16)
    return doc, first, at - first, span, 0, [first]


def test_windows_of_a_cell_are_bounded_only_for_what_can_add_to_them(monkeypatch):
    """Copies of a passage in contexts of their own: once one is found, no other can add anything and none is looked at again."""
    rng, n, seen = np.random.default_rng(3), 200, []
    bounds = substring._bounds
    monkeypatch.setattr(substring, "_bounds", lambda held, place: seen.append(len(held)) or bounds(held, place))
    values = rng.permutation(1 << 16).tolist()
    passage = [values.pop() for _ in range(70)]
    fresh = lambda: [values.pop() for _ in range(6)]
    links = []
    substring._compare([window(doc, fresh(), passage, fresh(), 30) for doc in range(n)], links)
    assert {link[0] for link in links} == set(range(1, n))
    assert sum(seen) <= 2 * n


@pytest.mark.parametrize("small, indexed, screen, kinds", [(6, 256, 1024, 1), (2, 10, 16, 1), (2, 10, 16, 2), (200, 256, 1024, 1)])
def test_cells_cover_what_comparing_all_pairs_covers(monkeypatch, small, indexed, screen, kinds):
    for name, value in (("SMALL", small), ("INDEXED", indexed), ("SCREEN", screen), ("KEPT", 20)):
        monkeypatch.setattr(substring, name, value)
    rng, n_linked = np.random.default_rng(12), 0
    for k in range(5):
        # the last one repeats shingles
        new = lambda m: rng.integers(0, 65000 if k < 4 else 200, m).tolist()  # noqa: E731, B023
        least, families, rows = 65500, [(new(45), new(45)) for _ in range(4)], []
        for doc in range(40):
            left, right = (list(side) for side in families[rng.integers(0, 4)])
            for side in (left, right):
                for _ in range(rng.integers(0, 3)):
                    cut = int(rng.integers(0, 40))
                    side[cut : cut + int(rng.integers(0, 6))] = new(rng.integers(0, 6))
            if rng.random() < 0.3:
                left = new(25) + left[25:]
            doc = doc // 2 if rng.random() < 0.2 else doc
            _, at, place, span, _, ats = window(doc, left, [least], right, 0)
            rows.append((doc, at, place, span, 2 + doc % 2 if kinds == 2 else 0, ats))
        rows.sort(key=lambda r: r[0])
        links = []
        substring._compare(rows, links)
        assert all(link[0] > link[3] for link in links)
        for doc in {r[0] for r in rows}:
            want = set()
            for d, at, place, span, kind, _ in (r for r in rows if r[0] == doc):
                for o in rows:
                    found = o[0] < doc and (not kind or o[4] != kind) and substring.verify(span, place, o[3], o[2])
                    want |= set(range(at + found[0], at + found[1] + 1)) if found else set()
            got = {p for link in links if link[0] == doc for p in range(link[1], link[2] + 1)}
            # all but what a stretch shorter than a passage is filled up with
            assert got <= want and len(want) - len(got) <= 2 * (substring.WIDTH - substring.LEAST) and bool(got) == bool(want)
            n_linked += bool(got)
    assert n_linked > 100
