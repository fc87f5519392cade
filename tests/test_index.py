"""The published index: what a search reads, statistics by index, versions of concurrent writers."""

import pathlib
import re

from pyspark.sql import functions as F

from quaestor.functions import text as X
from quaestor.operators import lexical, nearest, sweep
from quaestor.plans import search as S
from quaestor.sources import corpus as C
from quaestor.sources import index as I
from quaestor.sources import publish as P

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return {tuple(r) for r in df.withColumn("score", F.round("score", 6)).collect()}


def test_index_scores_as_the_corpus(spark):
    c, q = S.Collection.load(spark, FOLDER), C.search_queries(spark, FOLDER)
    columns = ["query_id", "doc_id", "unit_no", "score"]
    assert rows(lexical.index_units(c.index, q).select(columns)) == rows(lexical.bm25_units(C.sections(c.docs), q).select(columns))


def test_filters_leave_statistics_alone(spark):
    c, q = S.Collection.load(spark, FOLDER), C.search_queries(spark, FOLDER)
    kept = c.index.documents.where("acl_hash = 'grp_1'")
    all_rows = rows(lexical.index_units(c.index, q).select("query_id", "doc_id", "unit_no", "score"))
    some = rows(lexical.index_units(c.index, q, kept=kept).select("query_id", "doc_id", "unit_no", "score"))
    assert some == {r for r in all_rows if r[1] % 5 == 1}


def test_scoped_queries_have_the_statistics_of_their_index(spark):
    c, q = S.Collection.load(spark, FOLDER), C.search_queries(spark, FOLDER)
    both = q.withColumn("idx", F.explode(F.array(F.lit("main"), F.lit("api"))))
    got = lexical.per_document(lexical.index_units(c.index, both))
    for idx in ("main", "api"):
        alone = lexical.bm25_units(C.sections(c.docs.where(F.col("idx") == idx)), q)
        want = rows(alone.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")))
        assert rows(got.where(F.col("idx") == idx).select("query_id", "doc_id", "score")) == want


def test_search_reads_only_the_folders_of_its_terms(spark):
    index = I.published(spark, FOLDER)
    one = spark.createDataFrame([(1, "river")], "query_id long, query string")
    plan = lexical.index_units(index, one)._jdf.queryExecution().toString()
    assert "documents.parquet" not in plan
    n = spark.range(1).select(I.bucket(F.lit("river"), index.buckets)).first()[0]
    filters = re.findall(r"postings.*?PartitionFilters: \[(.*?)\]", plan)
    assert filters and all(re.search(rf"bucket#\d+ = {n}\)", f) for f in filters)


def test_nearest_with_a_key_is_each_index_alone(spark):
    vectors = C.vectors(spark, FOLDER).withColumn("idx", F.when(F.col("doc_id") % 3 == 0, "api").otherwise("main"))
    q = C.query_vectors(spark, FOLDER)
    got = nearest.knn(vectors, q.withColumn("idx", F.explode(F.array(F.lit("main"), F.lit("api")))), 7)
    for idx in ("main", "api"):
        want = nearest.knn(vectors.where(F.col("idx") == idx), q, 7)
        columns = ["query_id", "doc_id", "rank", "score"]
        assert rows(got.where(F.col("idx") == idx).select(columns)) == rows(want.select(columns))


def test_facade_falls_back_to_terms_without_vectors(spark):
    c, q = S.Collection.load(spark, FOLDER), C.search_queries(spark, FOLDER)
    none = C.query_vectors(spark, FOLDER).limit(0)
    got = S.search(c, q, none, "knn", ("docs", "api"))
    assert {(r.focus, r.method) for r in got.select("focus", "method").distinct().collect()} == {("docs", "bm25"), ("api", "api_focused")}
    assert got.groupBy("query_id", "focus").count().agg(F.max("count")).first()[0] <= 15
    filtered = S.search(c, q, none, "bm25", ("general",), filters=S.FL.Filters(acl_hash="grp_1"))
    assert all(r.doc_id % 5 == 1 for r in filtered.collect())


def test_two_writers_take_two_versions(spark, tmp_path):
    path = f"{tmp_path}/v"
    first, second = P.claim_version(spark, path), P.claim_version(spark, path)
    assert (first, second) == (1, 2) and P.current_version(spark, path) == 0
    assert P.publish(spark.range(3).withColumn("idx", F.lit("main")), path) == 3
    assert P.current_version(spark, path) == 3 and P.read_current(spark, path).count() == 3


def test_a_changed_folder_is_indexed_anew(spark, tmp_path):
    docs = C.table(spark, FOLDER, "documents")
    docs.limit(5).write.parquet(f"{tmp_path}/documents.parquet")
    first = I.published(spark, str(tmp_path))
    assert I.published(spark, str(tmp_path)).path == first.path
    docs.limit(9).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert I.published(spark, str(tmp_path)).documents.count() == 9 and first.documents.count() == 5


def test_terms_and_lengths_need_no_postings(spark, tmp_path):
    """Every word of three fields was shuffled and written for a count."""
    C.table(spark, FOLDER, "documents").limit(40).write.parquet(f"{tmp_path}/documents.parquet")
    index = I.published(spark, str(tmp_path), ("section",), ())
    assert sorted(p.name for p in pathlib.Path(index.path).iterdir() if not p.name.startswith(("_", "."))) == ["lengths", "terms"]
    whole = I.published(spark, str(tmp_path))
    for some in ("terms", "lengths"):
        got, want = (sorted(map(tuple, getattr(x, some)().drop("bucket").collect())) for x in (index, whole))
        assert got == want and got


def test_counts_of_repeated_and_empty_documents(spark, monkeypatch):
    monkeypatch.setattr(I, "DOCUMENTS", 2)
    data = [
        (1, "main", "River bank", "River the\n\n river bank river"), (1, "main", "River bank", "River the\n\n river bank river"),
        (1, "main", "Bank", "sea sea\n\nsea bank sea"), (2, "api", None, None), (3, "api", "", "\n"), (4, None, "the", "the\nthe"),
        (5, "api", "ÉTÉ x", "été\nx_1 ÉTÉ"), (None, "main", "a", "lake"), (None, "main", "a", "lake"), (6, None, "sea", "sea a"), (7, "api", "z", "z\nz"),
    ]
    docs = spark.createDataFrame(data, "doc_id long, idx string, title string, text string")
    for d in (docs, docs.where("doc_id > 1"), docs.limit(0)):
        lines = d.select("idx", "doc_id", F.posexplode(F.split("text", "\n")).alias("unit_no", "unit_text"), F.lit("section").alias("field"))
        for field in ("text", "title"):
            lines = lines.unionByName(d.select("idx", "doc_id", F.lit(0).alias("unit_no"), F.col(field).alias("unit_text"), F.lit(field).alias("field")))
        units = lines.withColumn("toks", X.index_tokens(F.col("unit_text"))).withColumn("unit_len", F.size("toks")).where("unit_len > 0")
        keys = ["field", "idx", "doc_id", "unit_no", "unit_len", "term"]
        each = units.withColumn("term", F.explode(F.array_append("toks", F.lit("")))).groupBy(*keys).agg(F.count(F.lit(1)).alias("tf"))
        want = each.groupBy("field", "idx", "term").agg(F.count(F.lit(1)), F.sum(F.expr("if(term = '', unit_len, tf)"))).collect()
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(map(tuple, I._tallies(d, I.FIELDS).collect()), key=key) == sorted(map(tuple, want), key=key)
        want = [(*r[:6], 1 if r.term == "" else r.tf) for r in each.collect()]
        got = map(tuple, I.unpack(I._packed(d, I.FIELDS)).select(*keys, "tf").collect())
        assert sorted(got, key=key) == sorted(want, key=key)


def test_a_bounded_search_makes_pairs_of_its_best_documents_only(spark, monkeypatch):
    """Pairs of every query and every unit with a term of it were spilled and, for inner hits, written."""
    monkeypatch.setattr(sweep, "FIRST", 1)
    c, q = S.Collection.load(spark, FOLDER), C.search_queries(spark, FOLDER)
    both = q.withColumn("idx", F.explode(F.array(F.lit("main"), F.lit("api"))))
    for queries, scope in ((q, []), (both, ["idx"])):
        every, few = (lexical.index_units(c.index, queries, k=k) for k in (None, 4))
        top = lexical.top_k(lexical.per_document(every), 4)
        assert rows(lexical.top_k(lexical.per_document(few), 4)) == rows(top)
        kept = every.join(top.select("query_id", *scope, "doc_id"), ["query_id", *scope, "doc_id"], "left_semi")
        assert rows(kept.select(few.columns)) <= rows(few) <= rows(every.select(few.columns))
        assert few.select("query_id", *scope, "doc_id").distinct().count() <= 9 * queries.count()
