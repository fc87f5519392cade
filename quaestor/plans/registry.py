"""Registry of queries and their SQL checks."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _wide(df: DataFrame) -> DataFrame:
    """Reports use one integer and one floating type."""
    casts = {"integer": "long", "short": "long", "byte": "long", "float": "double"}
    return df.select(
        [F.col(f.name).cast(casts.get(f.dataType.typeName(), f.dataType)).alias(f.name) for f in df.schema.fields]
    )


def query(name: str, oracle: str | None = None):
    """Register a query under a name, with the SQL that must give the same rows where SQL can express it."""

    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, folder: _wide(fn(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add
