"""Deduplication by key: groups, representatives, flags, surrogate ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRATEGIES = ("first", "longest")


def group_stats(rows: DataFrame, key: str = "norm_key", name: str = "company_name", cleaned: str = "cleaned_name") -> DataFrame:
    """Per key: size and the sorted original and cleaned names."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("duplicate_group_size"), F.sort_array(F.collect_list(name)).alias("original_names"), F.sort_array(F.collect_list(cleaned)).alias("cleaned_names"))


def group_sizes(rows: DataFrame, key: str = "norm_key") -> DataFrame:
    """Sizes alone: combines before the shuffle, so a hot key costs one row per task."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("duplicate_group_size"))


def duplicate_totals(sizes: DataFrame) -> DataFrame:
    """Groups with more than one row, the rows in them, and the rows that deduplication drops (0 without any)."""
    many = sizes.where("duplicate_group_size > 1")
    n = F.coalesce(F.sum("duplicate_group_size"), F.lit(0))
    return many.agg(F.count(F.lit(1)).alias("n_groups"), n.alias("n_rows"), (n - F.count(F.lit(1))).alias("n_dropped"))


def canonical(rows: DataFrame, strategy: str = "first", key: str = "norm_key", row_id: str = "id", cleaned: str = "cleaned_name") -> DataFrame:
    """One row per key: the smallest id, or the longest cleaned name (then smallest id).

    The choice is a minimum over an ordering struct, which combines before the shuffle, unlike a window."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    order: list[Column] = ([-F.length(cleaned)] if strategy == "longest" else []) + [F.col(row_id)]
    packed = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*[F.col(c) for c in rows.columns]).alias("row"))
    return rows.groupBy(F.col(key).alias("__key")).agg(F.min(packed).alias("best")).select("best.row.*")


def with_ids(rows: DataFrame, order: str = "norm_key", name: str = "canonical_id") -> DataFrame:
    """Sequential ids from 0 in order of a unique key, without a one-task sort.

    Range partitions are numbered by the counts of the partitions before them; one row per partition meets in the driver."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()).cache()
    counts = laid.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    at = F.col("__at") - F.shiftleft(F.col("__part").cast("long"), 33)
    return laid.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + at).drop("__part", "__at", "__before")


def flagged(rows: DataFrame, strategy: str = "first", row_id: str = "id") -> DataFrame:
    """Canonical rows with group size, duplicate flag, all original names and a sequential canonical_id."""
    best = canonical(rows, strategy, row_id=row_id)
    groups = group_stats(rows).drop("cleaned_names")
    out = best.join(groups, "norm_key", "left").withColumn("is_duplicate", F.when(F.col("duplicate_group_size") > 1, True).otherwise(False))
    return with_ids(out)
