"""Session helpers."""

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(app: str = "quaestor", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and local benchmarks; on a cluster the submitted configuration is used instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


SHARED_KEY = "quaestor.shared.dir"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder the cluster names in spark.checkpoint.dir (or in quaestor.shared.dir).

    Only a session that runs on this machine alone (tests) may name none; it gets one temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(SHARED_KEY, None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"spark.checkpoint.dir (or {SHARED_KEY}) must name a folder shared by the driver and all executors")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(SHARED_KEY, base)
    return f"{base.rstrip('/')}/{name}-{os.urandom(6).hex()}"


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write an intermediate result that is used several times to the shared folder and go on from there.

    It is computed once, survives the loss of executors, and its known size lets the planner choose joins.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    size = int(str(back._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return spread(back) if size > 1 << 20 else back


def spread(df: DataFrame) -> DataFrame:
    """Deal a table out over the cores when it comes in fewer pieces than there are cores.

    That is the case for small tables in one file only; a large table is used as it is read, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text_bytes(df: DataFrame, *columns: str) -> tuple[int, int]:
    """Row count and total text size of a table: the size check that precedes a broadcast."""
    size = sum(F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in columns)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]
