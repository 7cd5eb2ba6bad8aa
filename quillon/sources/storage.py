"""Sinks and table maintenance over versioned Parquet folders.

A maintained table is a folder with one sub-folder ``v=<n>`` per version and a folder ``_current`` with an empty file
per finished version, the largest of which is live.  A version is complete before its file appears and nothing is
overwritten, so readers always find a whole table; of two writers of one version the later one fails.  All
file operations go through Hadoop's file systems, so any store that Spark writes to will do.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None, fmt: str = "parquet", files: int | None = None) -> None:
    out = (df.coalesce(files) if files else df).write.format(fmt).mode(mode)
    (out.partitionBy(*partition_by) if partition_by else out).save(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> dict[int, int]:
    """Version numbers and their modification times in milliseconds."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return {}
    return {int(s.getPath().getName()[2:]): s.getModificationTime() for s in fs.listStatus(p) if s.getPath().getName().startswith("v=")}


def current(spark: SparkSession, path: str) -> int | None:
    fs, p = _fs(spark, f"{path}/_current")
    return max((int(s.getPath().getName()) for s in fs.listStatus(p)), default=None) if fs.exists(p) else None


def commit_version(df: DataFrame, path: str) -> int:
    """Write a new version and make it the live one."""
    spark = df.sparkSession
    n = max(versions(spark, path), default=-1) + 1
    df.write.parquet(f"{path}/v={n}")
    fs, p = _fs(spark, f"{path}/_current/{n}")
    if not fs.createNewFile(p):
        raise FileExistsError(f"{path} has a version {n} already")
    return n


def read_current(spark: SparkSession, path: str) -> DataFrame:
    n = current(spark, path)
    if n is None:
        raise ValueError(f"no table at {path}")
    return spark.read.parquet(f"{path}/v={n}")


def compact(spark: SparkSession, path: str, files: int = 1) -> int:
    """The live version in fewer files."""
    return commit_version(read_current(spark, path).coalesce(files), path)


def cluster(spark: SparkSession, path: str, *keys: str, files: int = 8) -> int:
    """The live version range-partitioned and sorted by keys, so file statistics prune."""
    return commit_version(read_current(spark, path).repartitionByRange(files, *keys).sortWithinPartitions(*keys), path)


def vacuum(spark: SparkSession, path: str, retention_hours: float = 168) -> list[int]:
    """Delete superseded versions older than the retention; returns their numbers."""
    live, limit = current(spark, path), (time.time() - 3600 * retention_hours) * 1000
    gone = sorted(v for v, at in versions(spark, path).items() if live is not None and v < live and at <= limit)
    for v in gone:
        fs, p = _fs(spark, f"{path}/v={v}")
        fs.delete(p, True)
    return gone


def create_table_if_absent(spark: SparkSession, table: str, path: str, schema: str | None = None) -> None:
    columns = f"({schema}) " if schema else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} {columns}USING parquet LOCATION '{path}'")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """Source rows with new keys are added; for known keys the ``update`` columns take the source's values (none given:
    insert only).  Null keys match nothing, so their rows are added."""
    if not update:
        return target.unionByName(source.join(target.select(*keys).distinct(), keys, "left_anti").select(*target.columns))
    s = source.select(*[F.col(c).alias(f"__{c}") for c in source.columns], F.lit(True).alias("__here"))
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    both = target.withColumn("__there", F.lit(True)).join(s, same, "full_outer")
    return both.select(*[
        (F.when(F.col("__here") & F.col("__there"), F.col(f"__{c}")) if c in update else F.when(F.col("__there"), F.col(c))).otherwise(F.when(F.col("__there"), F.col(c)).otherwise(F.col(f"__{c}"))).alias(c)
        if f"__{c}" in s.columns else F.col(c) for c in target.columns
    ])


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_sorted_text(df: DataFrame, path: str, column: str = "name") -> None:
    """Distinct lines in order."""
    df.select(F.col(column).cast("string").alias("value")).where("value IS NOT NULL").distinct().orderBy("value").write.mode("overwrite").text(path)


def append_metrics(metrics: DataFrame, path: str, stage: str) -> None:
    """Metrics rows with stage and time, as JSON lines."""
    metrics.withColumns({"stage": F.lit(stage), "recorded_at": F.current_timestamp()}).write.mode("append").json(path)


def upload(spark: SparkSession, source: str, target: str) -> None:
    """Copy a local file into any store that Spark reaches."""
    fs, p = _fs(spark, target)
    fs.copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path(source), p)
