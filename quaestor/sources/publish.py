"""Publishing tables as numbered versions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLAIM = "_claimed"  # readers pass over names that begin with an underscore


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _versions(spark: SparkSession, path: str, mark: str) -> list[int]:
    fs, at = _folder(spark, path)
    if not fs.exists(at):
        return []
    child = spark._jvm.org.apache.hadoop.fs.Path
    found = []
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if name.startswith("version=") and fs.exists(child(status.getPath(), mark)):
            found.append(int(name.split("=", 1)[1]))
    return found


def current_version(spark: SparkSession, path: str) -> int:
    """Highest finished version, 0 for none.  A write that died half-way has no success mark and is not seen."""
    return max(_versions(spark, path, "_SUCCESS"), default=0)


def claim_version(spark: SparkSession, path: str) -> int:
    """Take the next number.  Its claim is a file that only one writer can create, so writers never share a folder."""
    version = max(_versions(spark, path, CLAIM), default=current_version(spark, path)) + 1
    while True:
        fs, at = _folder(spark, f"{path}/version={version}/{CLAIM}")
        if fs.createNewFile(at):
            return version
        version += 1


def finish_version(spark: SparkSession, path: str, version: int) -> None:
    """Make a version of several tables visible."""
    fs, at = _folder(spark, f"{path}/version={version}/_SUCCESS")
    fs.create(at, True).close()


def publish(docs: DataFrame, path: str, partition_by: tuple[str, ...] = ("idx",)) -> int:
    """Write the corpus as the next version, partitioned for pruning; readers switch when the write is complete."""
    version = claim_version(docs.sparkSession, path)
    docs.write.mode("append").partitionBy(*partition_by).parquet(f"{path}/version={version}")
    return version


def read_current(spark: SparkSession, path: str) -> DataFrame:
    version = current_version(spark, path)
    if not version:
        raise FileNotFoundError(f"no published version under {path}")
    return spark.read.parquet(f"{path}/version={version}").withColumn("version", F.lit(version))


def files(df: DataFrame) -> tuple:
    """Name, size and time of every file that a table is read from."""
    out = []
    for name in sorted(df.inputFiles()):
        fs, at = _folder(df.sparkSession, name)
        status = fs.getFileStatus(at)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)
