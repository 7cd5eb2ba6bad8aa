"""Validation and quality figures, each in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: names made of nothing but other characters than these are special-only.
SPECIAL_ONLY = "^[^a-zA-Z0-9À-ÿĂăĐđẠ-ỹ]+$"
REASONS = ("null", "empty", "too_short", "too_long", "special_only")


def name_problem(name: Column, low: int = 3, high: int = 200) -> Column:
    """Why a name is invalid, checked in order; null if it is valid."""
    t = F.trim(name)
    return F.when(name.isNull(), "null").when(t == "", "empty").when(F.length(t) < low, "too_short").when(F.length(t) > high, "too_long").when(t.rlike(SPECIAL_ONLY), "special_only")


def validate_names(rows: DataFrame, name: str = "company_name") -> tuple[DataFrame, DataFrame]:
    """The valid rows, trimmed, and one row of counts."""
    marked = rows.withColumn("__why", name_problem(F.col(name)))
    valid = marked.where("__why IS NULL").withColumn(name, F.trim(name)).drop("__why")
    return valid, name_stats(marked)


def name_stats(marked: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("__why") == r).alias(f"n_{r}") for r in REASONS]
    n, bad = F.count(F.lit(1)), F.count("__why")
    share = F.coalesce(F.try_divide(bad.cast("double"), n.cast("double")), F.lit(0.0))
    return marked.agg(n.alias("n_total"), *counts, (n - bad).alias("n_valid"), (share > 0.10).alias("many_invalid"))


def validate_scores(matches: DataFrame, score: str = "score") -> tuple[DataFrame, DataFrame]:
    """Matches with a score in [0, 1], and one row of counts."""
    s = F.col(score)
    ok = s.isNotNull() & (s >= 0) & (s <= 1)
    stats = matches.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(s.isNull()).alias("n_null"), F.count_if((s < 0) | (s > 1)).alias("n_out_of_range"), F.count_if(s == 0).alias("n_zero"), F.count_if(ok).alias("n_valid"))
    return matches.where(ok), stats


def quality_metrics(matches: DataFrame, score: str = "score") -> DataFrame:
    """Size, moments and confidence counts and rates of match scores: one aggregation."""
    s, n = F.col(score), F.count(F.lit(1))
    high, medium, low = F.count_if(s >= 0.90), F.count_if((s >= 0.75) & (s < 0.90)), F.count_if(s < 0.75)
    rate = lambda c: F.coalesce(F.try_divide(c.cast("double"), n.cast("double")), F.lit(0.0))
    return matches.agg(n.alias("total"), F.avg(s).alias("avg_score"), F.stddev(s).alias("std_score"), F.min(s).alias("min_score"), F.max(s).alias("max_score"), high.alias("n_high"), medium.alias("n_medium"), low.alias("n_low"), rate(high).alias("high_rate"), rate(medium).alias("medium_rate"), rate(low).alias("low_rate"))


def distribution(matches: DataFrame) -> DataFrame:
    """Confidence counts as one map."""
    counts = matches.groupBy("match_confidence").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("match_confidence", "n")))).alias("confidence_distribution"))


def quality_alerts(metrics: DataFrame, min_avg: float = 0.85, min_high: float = 0.90) -> DataFrame:
    """One row per threshold that the metrics miss."""
    checks = F.array(F.struct(F.lit("avg_score").alias("metric"), F.col("avg_score").alias("value"), F.lit(min_avg).alias("threshold")), F.struct(F.lit("high_rate").alias("metric"), F.col("high_rate").alias("value"), F.lit(min_high).alias("threshold")))
    return metrics.select(F.explode(checks).alias("c")).select("c.*").where("value < threshold")


def metrics_text(metrics: dict, labels: dict[str, int] | None = None) -> str:
    """The row of ``quality_metrics`` (and counts by confidence label) as lines to read; figures of no rows are left out."""
    number = lambda x: "-" if x is None else f"{x:.4f}"
    out = [f"matches: {metrics['total']:,}"]
    if metrics["total"]:
        out += [f"score {name}: {number(metrics[f'{name}_score'])}" for name in ("avg", "std", "min", "max")]
        out += [f"{name} confidence: {metrics[f'n_{name}']:,} ({metrics[f'{name}_rate']:.1%})" for name in ("high", "medium", "low")]
    return "\n".join(out + [f"label {k}: {n:,}" for k, n in sorted((labels or {}).items())])


def print_quality_metrics(metrics: dict, labels: dict[str, int] | None = None) -> None:
    print(metrics_text(metrics, labels))


def memory_probe(spark: SparkSession) -> dict[str, str | int]:
    """Peak resident bytes of the Python driver, used and largest heap bytes of its JVM, and the memory settings in force."""
    import resource
    import sys

    heap = spark._jvm.java.lang.Runtime.getRuntime()
    peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * (1 if sys.platform == "darwin" else 1024)
    named = {k: spark.conf.get(k, "unset") for k in ("spark.driver.memory", "spark.executor.memory", "spark.memory.fraction", "spark.sql.shuffle.partitions")}
    return {"driver_peak_bytes": peak, "heap_used_bytes": heap.totalMemory() - heap.freeMemory(), "heap_max_bytes": heap.maxMemory()} | named


def partition_balance(rows: DataFrame, factor: float = 3.0) -> DataFrame:
    """Rows per partition (empty ones included) and whether the largest exceeds ``factor`` times the mean."""
    n = rows.rdd.getNumPartitions()
    counts = rows.groupBy(F.spark_partition_id().cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.range(n).join(counts, "id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return every.agg(F.count(F.lit(1)).alias("partitions"), F.min("n").alias("min_rows"), F.max("n").alias("max_rows"), F.avg("n").alias("avg_rows"), (F.max("n") > factor * F.avg("n")).alias("skewed"))


def key_balance(rows: DataFrame, key: str, factor: float = 3.0) -> DataFrame:
    """The same over the values of a key: what a shuffle by it would meet."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("n_keys"), F.min("n").alias("min_rows"), F.max("n").alias("max_rows"), F.avg("n").alias("avg_rows"), (F.max("n") > factor * F.avg("n")).alias("skewed"))


def missing_columns(rows: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in rows.columns]


def require(rows: DataFrame, required: list[str]) -> None:
    if missing := missing_columns(rows, required):
        raise ValueError(f"missing columns: {missing}")
