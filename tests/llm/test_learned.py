import random
import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quaestor.llm import langid, toxicity
from tests.llm.data import WORDS, documents, frame, prose, words


def test_language(spark):
    rng = random.Random(3)
    train = [(k, prose(rng, lang, 40), lang) for k, lang in enumerate(["en", "de"] * 30)] + [(90, None, "en"), (91, "x", None)]
    model = langid.fit(spark.createDataFrame(train, "id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    assert model.word("the")[1] > model.word("the")[0]
    known = model.word("gartenz")  # unknown, but its n-grams are German
    assert "gartenz" not in model.words and known[0] > known[1]
    texts = [prose(rng, lang, 30) for lang in ("en", "de") for _ in range(20)] + [None, "", "12 %", "the", "x" * 5000]
    names, scores = model.predict(texts)
    assert names[:40] == ["en"] * 20 + ["de"] * 20 and names[40:43] == ["und"] * 3
    assert all(0 <= s <= 1 for s in scores) and scores[40:43] == [0.0] * 3
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(langid.predictor(spark, model)("text").alias("p"))
    assert [r.p.lang_pred for r in df.collect()] == names
    nothing = langid.fit(spark.createDataFrame([], "id long, text string, lang string"))
    assert nothing.predict(["the"]) == (["und"], [0.0])


def test_language_remembers_unknown_words_only(monkeypatch):
    """What a worker holds stays small: known words are not held twice, and a model goes with its task."""
    table = np.log([[0.7, 0.1], [0.2, 0.6]])
    model = langid.Model(["de", "en"], {"und": 0, "the": 1}, table, {"_t": 0, "t": 1}, table)
    assert model.predict(["und und the", "the"])[0] == ["de", "en"] and not model.seen
    first = [model.predict([f"ta {chr(97 + k % 26) * (k // 26 + 1)}"]) for k in range(200)]
    monkeypatch.setattr(langid, "REMEMBERED", 10)
    assert [model.predict([f"ta {chr(97 + k % 26) * (k // 26 + 1)}"]) for k in range(200)] == first and len(model.seen) <= 12
    assert not hasattr(langid, "_models")


def test_a_worker_gives_back_what_it_freed():
    """Small pieces freed between others stay with the process unless they are given back."""
    code = """
import re, sys
import numpy as np
from quaestor.llm.common import give_back
def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10
base = held()
pieces = [np.zeros(1000, np.uint8) + 1 for _ in range(200_000)]
last = pieces[::2000]
del pieces
give_back()
assert held() - base < 60, (base, held())
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_toxicity(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(600):
        bad = k % 6 == 0
        text = prose(rng, "en", 40)
        rows.append((k, text + " vilely nasty" if bad else text))
        if k % 2 == 0:
            labels.append((k, int(bad)))
    rows += [(700, None), (701, ""), (None, "vilely nasty")]
    labels += [(0, 1), (5, None), (None, 1)]
    docs, marks = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(labels, "id long, toxic int")
    model = toxicity.fit(docs, marks)
    got = docs.withColumn("s", toxicity.scorer(spark, model)("text")).collect()
    assert all((r.s >= 0.5) == ("nasty" in (r.text or "")) and 0 <= r.s <= 1 for r in got)
    none = toxicity.fit(docs, marks.where("toxic = 7"))
    assert (none.score(["nasty", None]) < 0.5).all()
    assert (toxicity.fit(docs.limit(0), marks.limit(0)).score([None]) < 0.5).all()


def test_pipeline_stages_take_effect(spark, tmp_path):
    rows = documents()
    rng = random.Random(9)
    rows += [(500 + k, prose(rng, "en", 40) + (" nasty vilely" if k % 4 == 0 else ""), "en", "s", 1, None, None, None, None) for k in range(200)]
    rows += [(800, rows[-1][1], "en", "s", 1, None, None, None, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(500 + k, int(k % 4 == 0)) for k in range(200)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert out.columns == docs.columns
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r[0]: r for r in docs.collect()} if name != "packing" else docs.collect())
    language, toxic, near, passages, packed = kept
    assert 0 in language and not any(r.text is None or not any(c.isalpha() for c in r.text) for r in language.values())
    assert not any("nasty" in r.text for r in toxic.values())
    assert {i for i in language if "nasty" not in language[i].text} == set(toxic)
    assert 800 not in near and 699 in near and 0 in near
    assert set(passages) <= set(near)
    assert {r.doc_id for r in packed} == set(passages)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


def test_near_duplicates_keep_one_row_of_a_group(spark, tmp_path):
    rng = random.Random(4)
    a, b, c, d = (prose(rng, "en", 60) for _ in range(4))
    pairs = [(1, a), (1, a), (2, a), (1, b), (3, b), (None, c), (None, c), (4, d), (None, d), (5, ""), (6, ""), (None, "")]
    docs = frame(spark, [(i, t, "en", "s", 1, None, None, None, None) for i, t in pairs])
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()]
    want = [(1, a), (1, b), (None, c), (4, d), (5, ""), (6, ""), (None, "")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_pipeline_of_nothing(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert WORDS and words("A b") == ["a", "b"] and F
