"""Shared helpers: work folders that every executor sees, stable row order, small expression tools."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = "[\\x20\\x09-\\x0D]+"


_own_root: str | None = None


def work_root(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.  Where it is unset, a session whose executor is
    the driver's own process (a local master, as in tests) gets a temporary folder; any other is refused, as a
    temporary folder would be another disk on every executor."""
    global _own_root
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="quillon-work-")
        atexit.register(shutil.rmtree, _own_root, ignore_errors=True)
    return _own_root


def materialise(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there, and a lost
    executor costs a re-read of shared files, not a recomputation.  ``codec``: "uncompressed" for small tables that are
    read again and again, as every decompression of a file takes buffers outside the heap."""
    spark = df.sparkSession
    path = f"{work_root(spark)}/quillon-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a materialised frame that nothing will read again."""
    path = getattr(df, "_quillon_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def block_sums(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums by ``k`` of the float64 vectors in (k long, p binary).  Tasks add before the driver gets a vector per k."""

    def add(batches):
        have = {}
        for b in batches:
            for k, p in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(p.as_buffer())
                if k in have:
                    have[k] += x
                else:
                    have[k] = x.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int64()), pa.array([x.tobytes() for x in have.values()], pa.binary())], ["k", "p"])

    return {r["k"]: np.frombuffer(bytes(r["p"])) for r in parts.repartition("k").mapInArrow(add, "k long, p binary").collect()}


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with as many underscores before it as it takes to differ from every column of ``frames``."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def own_columns(df: DataFrame) -> list[Column]:
    """Every column of ``df``, whatever its name holds."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and bind it in ``body`` (a lambda over a one-element array)."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RE), "")


def in_fold(column: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``, equals ``remainder`` (null ids: never)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Append ``_rank`` (0-based, gapless, in order of ``keys``) and ``_total`` without a one-task sort:
    range partitions are sorted and materialised, then shifted by the row counts of the partitions before.

    Only one row per partition meets in a single task.  Rows equal in every key may swap.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    laid = materialise(laid.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), name)
    return with_rank(laid)


def with_rank(laid: DataFrame, weight: Column | None = None) -> DataFrame:
    """Ranks for a frame that carries ``_part`` and ``_at`` of its sorted range partitions."""
    from pyspark.sql import Window

    counts = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select(  # one row per partition, so the broadcast is bounded by the number of partitions
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(every.orderBy("_part")).alias("_total"),
    )
    rank = F.col("_before") + F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33)
    return laid.join(F.broadcast(offsets), "_part").withColumn("_rank", rank).drop("_part", "_at", "_before")
