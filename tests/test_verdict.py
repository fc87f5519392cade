"""Cases that the sample tables do not show."""

import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaestor import session
from quaestor.operators import evaluate, nearest, quality, spans

RULES = list(spans.rule_rows())


@pytest.mark.parametrize("rule", RULES, ids=[str(r[0]) for r in RULES])
def test_every_pattern_finds_what_plain_matching_finds(rule):
    no, suite, name, _, _, pattern = rule
    run = spans._extractor()

    @settings(max_examples=3, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(pattern, re.ASCII) if not pattern.startswith("(?i)") else re.compile(pattern), fullmatch=False))
    def check(text):
        frame = pd.DataFrame({"doc_id": [1], "title": [None], "text": [text], "page_url": ["u"]})
        found = pd.concat(list(run([frame])))
        got = found[found["rule_no"] == no]["offset"].tolist()
        assert got == [m.start() for m in re.finditer(pattern, "\n" + text)]

    check()


def test_outlook_without_the_word_email():
    frame = pd.DataFrame({"doc_id": [1], "title": [""], "text": ["contact Bob Smith via outlook"], "page_url": ["u"]})
    assert len(pd.concat(list(spans._extractor()([frame]))))


def test_utility_relevance_of_any_name(spark):
    rows = [("digital events are here", "Digital Events"), ("nothing", "Digital Events"), ("x", None), ("x", " "), ("account", "ACCOUNT utility")]
    df = spark.createDataFrame(rows, "a string, u string").select(evaluate.utility_relevance(F.col("a"), F.col("u")).alias("r"))
    assert [r.r for r in df.collect()] == [1.0, 0.0, 1.0, 1.0, 1.0]


def test_knn_over_several_blocks_and_rounds(spark):
    rng = np.random.default_rng(1)
    docs = [(k, [float(x) for x in rng.normal(size=4)]) for k in range(300)]
    docs += [(300 + k, docs[0][1]) for k in range(30)]  # ties
    queries = [(f"q{k}", [float(x) for x in rng.normal(size=4)]) for k in range(40)] + [("t", docs[0][1])]
    c, q = spark.createDataFrame(docs, "doc_id long, embedding array<double>"), spark.createDataFrame(queries, "query_id string, embedding array<double>")
    got = nearest.knn(c, q, k=7, block_bytes=320, matrix_bytes=1 << 10).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.doc_id))
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for name, v in queries:
        scores = sorted((-round((1 + float(unit(v) @ unit(w))) / 2, 6), d) for d, w in docs)[:7]
        assert [d for _, d in sorted(found[name])] == [d for _, d in scores]


def test_list_values_has_no_cut_unless_asked(spark):
    df = spark.range(1500).select(F.col("id").cast("string").alias("v"))
    assert quality.list_values(df, "v").count() == 1500 and quality.list_values(df, "v", 10).count() == 10


class _Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)

    def set(self, key, value):
        self[key] = value


class _Session:
    def __init__(self, master, conf):
        self.conf = _Conf(conf)
        self.sparkContext = type("C", (), {"master": master})()


def test_shared_folder_is_the_clusters_own():
    assert session.shared_dir(_Session("yarn", {"spark.checkpoint.dir": "hdfs:///x/"}), "a").startswith("hdfs:///x/a-")
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(ValueError):
            session.shared_dir(_Session(master, {}), "a")
    alone = _Session("local[2]", {})
    first, second = session.shared_dir(alone, "a"), session.shared_dir(alone, "a")
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
