"""Sources: text lines, JSON lines, tables, in-memory rows, web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import storage

CORPUS = "id string, name string"
QUERIES = "id string, text string, target_id string, method string"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(name): trimmed lines that aren't blank."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")


def text_lines_with_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id, name): ids are raw line numbers from 0, so blank lines leave gaps.

    Lines are numbered per file partition and shifted by the partitions before; one row per partition is windowed."""
    rows = spark.read.text(path).select("value", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at"))
    counts = rows.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = rows.join(F.broadcast(before), "p").select((F.col("before") + F.col("at") - F.shiftleft(F.col("p").cast("long"), 33)).alias("id"), F.trim("value").alias("name"))
    return numbered.where("name <> ''")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def eval_queries(spark: SparkSession, path: str, limit: int | None = None, seed: int = 42) -> DataFrame:
    """Evaluation queries; with a limit, the ones of the smallest seeded hash (a sample that any cluster repeats)."""
    rows = json_lines(spark, path, QUERIES)
    return rows if limit is None else rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(limit)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", version: int | None = None) -> DataFrame:
    """A table by path; ``version`` picks a kept version of a versioned folder (or time travel, where the format has it)."""
    if version is None:
        return spark.read.format(fmt).load(path)
    if fmt == "delta":
        return spark.read.format(fmt).option("versionAsOf", version).load(path)
    return spark.read.format(fmt).load(f"{path}/v={version}")


def rows_to_df(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """In-memory rows; always with a schema, as inference fails on empty lists and all-null columns."""
    return spark.createDataFrame(rows, schema)


def upsample(names: DataFrame, n: int, order: str) -> DataFrame:
    """Repeat the rows as often as needed and keep the first n by (copy, order): the size is the operator's purpose."""
    have = max(1, names.count())
    copies = -(-n // have)
    return names.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).orderBy("copy", order).limit(n)


def sample(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement by seeded hash."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def anchors(pages: DataFrame, pattern: str = r"<li><a[^>]*>([^<]*)</a>", low: int = 5) -> DataFrame:
    """Distinct link texts of pages without leading digits, longer than ``low`` characters."""
    found = pages.select(F.explode(F.regexp_extract_all("html", F.lit(pattern), 1)).alias("name"))
    return found.select(F.trim(F.regexp_replace("name", r"^\d+\s*", "")).alias("name")).where(F.length("name") > low).distinct()


#: Links that are headings, as list pages of articles have them.
HEADINGS = r"(?s)<h2[^>]*>\s*<a[^>]*>([^<]*)</a>"


def refresh_list(pages: DataFrame, path: str, pattern: str = HEADINGS) -> DataFrame:
    """Add the link texts of all pages to a maintained list of names (column ``name``) and return it, sorted and distinct.  The
    new list is a version of its own, so it's complete before it replaces the one that it was read from."""
    spark, found = pages.sparkSession, anchors(pages, pattern)
    if storage.current(spark, path) is not None:
        found = union_distinct(storage.read_current(spark, path).select("name"), found)
    storage.commit_version(found.orderBy("name"), path)
    return storage.read_current(spark, path)


def union_distinct(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out.distinct()
