"""Readers of rule files: synonyms, the API catalogue, suite rules and ranked passages, all as tables.

synonyms   one JSON object: term -> expansion
catalogue  one JSON object: "Product List" -> product -> [{"APG_Name", "API-Names-List", "Acronyms"}]
suites     one JSON object a file: {"suite", "hints", "extractors": [{"name", "capability", "weight", "patterns", "attrs",
           "url_patterns"}]}
passages   one JSON array: [{"text", "url", "title", "heading"}, ...], ranked by position

Rule tables are dimensions: a job takes them to the driver once, behind a check of their number.
"""

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions import rules as R
from quaestor.session import shared_dir

EXTRACTOR = "struct<name:string,capability:string,weight:double,patterns:array<string>,attrs:map<string,string>,url_patterns:array<string>>"
SUITE = f"struct<suite:string,hints:array<string>,extractors:array<{EXTRACTOR}>>"
GROUP = "struct<APG_Name:string,`API-Names-List`:array<string>,Acronyms:string>"
PASSAGE = "struct<text:string,url:string,title:string,heading:string>"
#: Suites that a job accepts; each pattern of each suite is a step of its plan or of its task function.
MOST_SUITES = 1000


def _whole(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """file, v: one row a file, null where it does not hold what is expected."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.input_file_name().alias("file"), F.from_json("value", kind).alias("v"))


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """term (lower case), expansion; of equal terms the first of a file counts."""
    rows = _whole(spark, path, "map<string,string>").select("file", F.posexplode(F.map_entries("v")).alias("pos", "e"))
    term = F.lower(F.trim("e.key"))
    return rows.groupBy(term.alias("term")).agg(F.min_by("e.value", F.struct("file", "pos")).alias("expansion"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """product, group_name, acronym, apis."""
    rows = _whole(spark, path, f"map<string,map<string,array<{GROUP}>>>")
    rows = rows.select(F.explode(F.element_at("v", F.lit("Product List"))).alias("product", "groups"))
    g = rows.select("product", F.explode("groups").alias("g"))
    return g.select(
        "product", F.col("g.APG_Name").alias("group_name"), F.nullif("g.Acronyms", F.lit("")).alias("acronym"), F.col("g.`API-Names-List`").alias("apis")
    )


def read_suites(spark: SparkSession, path: str) -> DataFrame:
    """suite, hints, extractors; a file that is no suite is an error, so no rule is lost in silence."""
    rows = _whole(spark, path, SUITE)
    broken = F.col("v").isNull() | F.col("v.suite").isNull()
    named = F.when(broken, F.raise_error(F.concat(F.lit("no suite rules: "), "file"))).otherwise(F.col("v.suite"))
    nothing = F.array().cast("array<string>")
    fixed = F.transform(
        "v.extractors",
        lambda e: F.struct(
            e["name"].alias("name"),
            e["capability"].alias("capability"),
            F.coalesce(e["weight"], F.lit(1.0)).alias("weight"),
            F.coalesce(e["patterns"], nothing).alias("patterns"),
            F.coalesce(e["attrs"], F.create_map().cast("map<string,string>")).alias("attrs"),
            F.coalesce(e["url_patterns"], nothing).alias("url_patterns"),
        ),
    )
    return rows.select(named.alias("suite"), F.coalesce("v.hints", nothing).alias("hints"), fixed.alias("extractors"))


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """file, rank (from 1), text, url, title, heading of ranked-passage files."""
    rows = _whole(spark, path, f"array<{PASSAGE}>").select("file", F.posexplode("v").alias("pos", "p"))
    return rows.select("file", (F.col("pos") + 1).alias("rank"), "p.text", "p.url", "p.title", "p.heading")


def suites_of(rules: DataFrame) -> dict:
    """The rules as the operators take them, suites in order of their names."""
    rows = rules.orderBy("suite").limit(MOST_SUITES + 1).collect()
    if len(rows) > MOST_SUITES:
        raise ValueError(f"more than {MOST_SUITES} suites")
    fields = ("name", "capability", "weight", "patterns", "attrs", "url_patterns")
    return {r["suite"]: {"hints": list(r["hints"]), "extractors": [tuple(e[f] for f in fields) for e in r["extractors"]]} for r in rows}


@dataclass(frozen=True)
class RuleFiles:
    """Folders that hold the files of each kind."""

    synonyms: str
    catalog: str
    suites: str


_written: dict[str, RuleFiles] = {}


def built_in(spark: SparkSession) -> RuleFiles:
    """The built-in rules as files in the shared folder, for sessions that bring none of their own."""
    app = spark.sparkContext.applicationId
    if app not in _written:
        products: dict = {}
        for product, group, acronym, apis in R.API_CATALOG:
            products.setdefault(product, []).append({"APG_Name": group, "API-Names-List": apis, "Acronyms": acronym or ""})
        fields = ("name", "capability", "weight", "patterns", "attrs", "url_patterns")
        suites = [
            {"suite": s, "hints": m["hints"], "extractors": [dict(zip(fields, e)) for e in m["extractors"]]} for s, m in R.SUITES.items()
        ]
        at = shared_dir(spark, "rules")
        for name, files in (("synonyms", [dict(R.SYNONYMS)]), ("catalog", [{"Product List": products}]), ("suites", suites)):
            rows = spark.createDataFrame([(json.dumps(f),) for f in files], "value string").repartition(len(files), "value")
            rows.write.option("maxRecordsPerFile", 1).text(f"{at}/{name}")
        _written[app] = RuleFiles(f"{at}/synonyms", f"{at}/catalog", f"{at}/suites")
    return _written[app]
