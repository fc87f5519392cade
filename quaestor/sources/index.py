"""The lexical index as published tables.

postings   field, bucket | term, idx, lists of doc_id, unit_no, unit_len, tf: in folders by field and bucket of the term, sorted
           by term inside, so that a search reads the buckets of its terms only; a row holds the postings of a term in a
           stretch of documents; the empty term has one posting a unit
terms      field, bucket | term, idx, df, cf: document and collection frequency in each index
lengths    field, idx, n_units, n_terms: of the units with a term
documents  what filters ask for, without texts

Fields are "section" (one unit a line), "text" and "title" (one unit a document).  Frequencies are kept for each idx, so a
search of one index has that index's statistics and a search of all adds them up.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions import rules as R
from quaestor.functions.words import letters, toks
from quaestor.session import settle, shared_dir
from quaestor.sources import corpus as C
from quaestor.sources import publish as P

FIELDS = ("section", "text", "title")
TABLES = ("documents", "postings")  # besides terms and lengths
DOCUMENTS = 1000  # that are cut into words together
BUCKET_BYTES = 64 << 20  # of text that a bucket of terms stands for
BUCKETS = (8, 4096)
META = ["doc_id", "idx", "title", "acl_hash", "space_key", "content_type", "utility_name", "updated_at", "page_url"]


def bucket(term: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(n)).cast("int")


@dataclass(frozen=True)
class Index:
    """A finished version of the tables."""

    spark: SparkSession
    path: str

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def documents(self) -> DataFrame:
        return self._table("documents")

    @property
    def buckets(self) -> int:
        return self._table("lengths").agg(F.max("buckets")).first()[0] or 1

    def packed(self, field: str = "section") -> DataFrame:
        return self._table("postings").where(F.col("field") == field).drop("field")

    def postings(self, field: str = "section") -> DataFrame:
        return unpack(self.packed(field))

    def terms(self, field: str = "section") -> DataFrame:
        return self._table("terms").where(F.col("field") == field).drop("field")

    def lengths(self, field: str = "section") -> DataFrame:
        return self._table("lengths").where(F.col("field") == field).select("idx", "n_units", "n_terms")


def _merged(doc: np.ndarray, no: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The number of each unit when those equal in document, place and length are one."""
    return np.unique(np.stack([doc, no, length]), axis=1, return_inverse=True)[1].ravel()


def _parsed(docs: pa.Table, field: str, letter: np.ndarray, repeated: bool):
    """Terms; term and unit of each of their occurrences; document (row), place and length of each unit; of one idx.

    Where ids are repeated, all rows of an id are here, and their units of the same place and length are one.
    """
    text = docs.column("title" if field == "title" else "text").combine_chunks()
    counts, words = toks(text, letter)
    if not len(words):
        return None
    words = words.dictionary_encode()
    known, code = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    others = pc.index_in(known, value_set=pa.array([*R.STOP_WORDS, "\n"]).cast(pa.binary())).fill_null(-1).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(others[code] == len(R.STOP_WORDS)) if field == "section" else np.zeros(len(code), np.int64)
    no = ends - np.append(0, ends)[np.cumsum(counts) - counts][doc]
    term = others[code] < 0
    doc, no, code = doc[term], no[term], code[term]
    if not len(code):
        return None
    first = (np.diff(doc, prepend=-1) != 0) | (np.diff(no, prepend=-1) != 0)
    unit = np.cumsum(first) - 1
    doc, no, length = doc[first], no[first], np.bincount(unit)
    if repeated:
        one = _merged(docs.column("number").to_numpy()[doc], no, length)
        at = np.unique(one, return_index=True)[1]
        unit, doc, no, length = one[unit], doc[at], no[at], length[at]
    return known, code, unit, doc, no, length


def _tally(docs: pa.Table, field: str, letter: np.ndarray, repeated: bool):
    """term, df, cf of some documents; the empty term stands for all units: their number and their terms."""
    parsed = _parsed(docs, field, letter, repeated)
    if not parsed:
        return None
    known, code, unit, _, _, length = parsed
    pairs = np.unique(code * len(length) + unit) // len(length)
    at = np.flatnonzero(cf := np.bincount(code, minlength=len(known)))
    df = np.bincount(pairs, minlength=len(known))[at]
    terms = pa.concat_arrays([known.take(pa.array(at)), pa.array([b""])]).cast(pa.string())
    return terms, pa.array(np.append(df, len(length))), pa.array(np.append(cf[at], length.sum()))


def _pack(docs: pa.Table, field: str, letter: np.ndarray, repeated: bool):
    """term and its postings as lists: doc_id, unit_no, unit_len, tf; the empty term has one posting a unit."""
    parsed = _parsed(docs, field, letter, repeated)
    if not parsed:
        return None
    known, code, unit, doc, no, length = parsed
    n = len(length)
    key, tf = np.unique(code * n + unit, return_counts=True)
    code, unit = np.divmod(key, n)
    first = np.flatnonzero(np.diff(code, prepend=-1))
    terms = pa.concat_arrays([known.take(pa.array(code[first])), pa.array([b""])]).cast(pa.string())
    ends, unit = pa.array(np.concatenate([first, [len(unit), len(unit) + n]]).astype(np.int32)), np.append(unit, np.arange(n))
    ids = docs.column("doc_id").combine_chunks().take(pa.array(doc[unit]))
    values = ids, pa.array(no[unit].astype(np.int32)), pa.array(length[unit].astype(np.int32)), pa.array(np.append(tf, np.ones(n, np.int64)))
    return terms, *(pa.ListArray.from_arrays(ends, v) for v in values)


def _of_words(docs: DataFrame, fields: tuple[str, ...], make, columns: dict[str, str]) -> DataFrame:
    """field, idx and what make (_tally, _pack) returns for stretches of documents.

    Rows that share an id come together; they are looked for by their ids alone and are dealt out only where there are some.
    """
    letter, names = docs.sparkSession.sparkContext.broadcast(letters(docs.sparkSession)), ["field", "idx", *columns]
    schema = ", ".join(f"{n} {t}" for n, t in {"field": "string", "idx": "string", **columns}.items())

    def each(table: pa.Table, repeated: bool):
        for idx in pc.unique(table.column("idx")).to_pylist():
            mine = pc.is_null(table.column("idx")) if idx is None else pc.fill_null(pc.equal(table.column("idx"), idx), False)
            some = table.filter(mine)
            for field in fields:
                if found := make(some, field, letter.value, repeated):
                    yield pa.record_batch([*(pa.array([x] * len(found[0]), pa.string()) for x in (field, idx)), *found], names)

    def singles(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, DOCUMENTS):
                yield from each(pa.Table.from_batches([batch.slice(a, DOCUMENTS)]), False)

    def groups(table: pa.Table) -> pa.Table:
        found = [*each(table, True)]
        return pa.Table.from_batches(found) if found else empty

    def empty_table():
        kinds = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
        return pa.schema([(n, kinds[t]) for n, t in {"field": "string", "idx": "string", **columns}.items()]).empty_table()

    empty = empty_table()
    texts = [F.lower(c).cast("binary").alias(c) for c in sorted({"title" if f == "title" else "text" for f in fields})]
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = settle(again.select("doc_id"), "repeated")
    n = again.count()
    if not n:
        return docs.select(doc_id, "idx", *texts).mapInArrow(singles, schema)
    same = docs["doc_id"].eqNullSafe(again["doc_id"])
    parts = docs.join(again, same, "left_anti").select(doc_id, "idx", *texts).mapInArrow(singles, schema)
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("number")
    more = docs.join(again, same, "left_semi").select(doc_id, number, "idx", *texts)
    dealt = more.withColumn("deal", F.pmod(F.xxhash64("number"), F.lit(n // DOCUMENTS + 1)))
    return parts.union(dealt.groupBy("deal").applyInArrow(groups, schema))


def _tallies(docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """field, idx, term, df, cf of documents, added up in each task before they are shuffled; the empty term: see _tally."""
    parts = _of_words(docs, fields, _tally, {"term": "string", "df": "long", "cf": "long"})
    return parts.groupBy("field", "idx", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def _packed(docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """field, idx, term, and lists of doc_id, unit_no, unit_len, tf: the postings of a term in a stretch of documents."""
    columns = {"doc_id": "array<long>", "unit_no": "array<int>", "unit_len": "array<int>", "tf": "array<long>"}
    return _of_words(docs, fields, _pack, {"term": "string", **columns})


def unpack(packed: DataFrame) -> DataFrame:
    """One row per posting."""
    lists = ["doc_id", "unit_no", "unit_len", "tf"]
    return packed.select(*(c for c in packed.columns if c not in lists), F.inline(F.arrays_zip(*lists)))


def publish_index(docs: DataFrame, path: str, fields: tuple[str, ...] = FIELDS, tables: tuple[str, ...] = TABLES) -> Index:
    """Write tables of the next version under a path; it becomes visible when the last one is complete."""
    spark = docs.sparkSession
    version = P.claim_version(spark, path)
    at = f"{path}/version={version}"
    if "documents" in tables:
        docs.select(*META).write.partitionBy("idx").parquet(f"{at}/documents")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = int(min(max(BUCKETS[0], size // BUCKET_BYTES), BUCKETS[1]))
    if "postings" in tables:
        postings = _packed(docs, fields).withColumn("bucket", bucket(F.col("term"), n))
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), size // BUCKET_BYTES)
        part = F.pmod(F.xxhash64(F.element_at("doc_id", 1)), F.lit(max(1, files // n)))  # a frequent term is cut by documents
        spread = postings.repartition(int(files), "field", "bucket", part).sortWithinPartitions("field", "bucket", "term")
        spread.write.partitionBy("field", "bucket").parquet(f"{at}/postings")
    counts = settle(_tallies(docs, fields), "tallies")
    terms = counts.where("term <> ''").withColumn("bucket", bucket(F.col("term"), n))
    terms.sortWithinPartitions("field", "bucket", "term").write.partitionBy("field", "bucket").parquet(f"{at}/terms")
    lengths = counts.where("term = ''").select("field", "idx", F.col("df").alias("n_units"), F.col("cf").alias("n_terms"))
    lengths.withColumn("buckets", F.lit(n)).coalesce(1).write.parquet(f"{at}/lengths")
    P.finish_version(spark, path, version)
    return Index(spark, at)


def open_index(spark: SparkSession, path: str) -> Index:
    version = P.current_version(spark, path)
    if not version:
        raise FileNotFoundError(f"no published index under {path}")
    return Index(spark, f"{path}/version={version}")


_published: dict[tuple, str] = {}


def published(spark: SparkSession, folder: str, fields: tuple[str, ...] = FIELDS, tables: tuple[str, ...] = TABLES) -> Index:
    """The index of a folder's documents, published to the shared folder at its first use and whenever their files change.

    A search that names the fields and tables it reads has no others published for it; terms and lengths always are.
    """
    key = (spark.sparkContext.applicationId, P.files(C.table(spark, folder, "documents")), fields, tables)
    if key not in _published:
        _published[key] = publish_index(C.corpus(spark, folder), shared_dir(spark, "index"), fields, tables).path
    return Index(spark, _published[key])
