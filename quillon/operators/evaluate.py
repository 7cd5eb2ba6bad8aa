"""Accuracy of ranked results: hits with ties, positions, sweeps, error tags, diagnosis."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import textnorm as T


def outcomes(queries: DataFrame, results: DataFrame, top_k: int = 5) -> DataFrame:
    """Per query (query_id, text, target, method): hit at 1 (ties with the first score count), hit in the list, the target's
    rank, the first score, whether nothing was returned."""
    w = Window.partitionBy("query_id")
    lead = results.withColumn("lead", F.max(F.when(F.col("rank") == 1, F.col("score"))).over(w))
    rows = queries.join(lead.select("query_id", "matched_company", "score", "rank", "lead"), "query_id", "left")
    same = F.col("matched_company") == F.col("target")
    out = rows.groupBy("query_id", "text", "target", "method").agg(
        F.coalesce(F.max(same & (F.col("score") == F.col("lead"))), F.lit(False)).alias("top1"),
        F.coalesce(F.max(same), F.lit(False)).alias("in_list"),
        F.min(F.when(same, F.col("rank"))).alias("target_rank"),
        F.max("lead").alias("top1_score"),
        F.max(F.when(F.col("rank") == 1, F.col("matched_company"))).alias("top1_company"),
        (F.count("matched_company") == 0).alias("suppressed"),
    )
    return out


def accuracy(results: DataFrame) -> DataFrame:
    """Shares over all queries, and over the answered ones."""
    n, answered = F.count(F.lit(1)), F.count_if(~F.col("suppressed"))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)
    hit = F.count_if(F.col("top1"))
    positional = [rate(F.count_if(F.col("target_rank") <= k), n).alias(f"strict_top{k}") for k in (1, 3, 5)]
    mrr = F.round(F.coalesce(F.sum(1.0 / F.col("target_rank")) / n, F.lit(0.0)), 6)
    return results.agg(n.alias("n"), rate(hit, n).alias("top1"), rate(F.count_if(F.col("in_list")), n).alias("top3"), *positional, rate(answered, n).alias("coverage"), rate(hit, answered).alias("precision"), mrr.alias("mrr"))


def sweep(results: DataFrame, step: int = 2) -> DataFrame:
    """Coverage, precision and F0.5 (in %) for thresholds 0.00, 0.02, ... 1.00.

    Each query falls into one slot (the last threshold it passes); slots are then summed from above, so the queries are
    read once and not once per threshold."""
    spark = results.sparkSession
    n_slots = 100 // step
    s = F.coalesce("top1_score", F.lit(0.0))
    passed = F.least(F.floor(F.round(s * 100 / step, 6)), F.lit(n_slots)).cast("int")
    slots = results.groupBy(passed.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("top1")).alias("hits"))
    grid = spark.range(n_slots + 1).select(F.col("id").cast("int").alias("slot"))
    up = Window.orderBy(F.desc("slot"))  # at most 101 rows
    every = Window.partitionBy(F.lit(1))
    rows = grid.join(slots, "slot", "left").fillna(0, ["n", "hits"])
    rows = rows.select(F.round(F.col("slot") * step / 100, 2).alias("threshold"), F.sum("n").over(up).alias("answered"), F.sum("hits").over(up).alias("correct"), F.sum("n").over(every).alias("total"))
    pct = lambda a, b: F.coalesce(F.try_divide(F.col(a) * 100.0, F.col(b).cast("double")), F.lit(0.0))
    rows = rows.withColumns({"coverage": pct("answered", "total"), "precision": pct("correct", "answered")})
    f05 = F.coalesce(F.try_divide(1.25 * F.col("precision") * F.col("coverage"), 0.25 * F.col("precision") + F.col("coverage")), F.lit(0.0))
    return rows.select("threshold", F.round("coverage", 6).alias("coverage"), F.round("precision", 6).alias("precision"), "correct", "answered", F.round(f05, 6).alias("f05"))


def recommended(table: DataFrame) -> DataFrame:
    """First threshold that reaches 95, 98 and 99 % precision (null: none), and the one of the best F0.5."""
    reach = [F.min(F.when(F.col("precision") >= p, F.col("threshold"))).alias(f"at_{p}") for p in (95, 98, 99)]
    best = F.max(F.struct(F.col("f05"), -F.col("threshold")))
    return table.agg(*reach, (-best["col2"]).alias("best_threshold"), best["f05"].alias("best_f05"))


def error_tags(query: Column, target: Column, method: Column) -> Column:
    """What kind of query this is, as tags."""
    q = F.trim(query)
    n = F.size(T.tokens(q))
    a, b = F.lower(T.strip_accents(q)), F.lower(T.strip_accents(target))
    x, y = F.array_sort(F.array_distinct(T.tokens(a))), F.array_sort(F.array_distinct(T.tokens(b)))
    overlap = T.token_jaccard(q, target)
    tags = F.array(
        F.concat(F.lit("method:"), method),
        F.when(T.is_no_accent(q), "no_accent").otherwise("accented"),
        F.when(T.is_all_upper(q), "all_upper").when(F.lower(q) == q, "all_lower").otherwise("mixed_case"),
        F.when(n == 1, "single_token").when(n <= 3, "short_query").otherwise("long_query"),
        F.when(T.is_abbreviated(q, target), "abbreviated"),
        F.when((x == y) & (a != b), "word_reorder"),
        F.when(overlap == 0, "no_token_overlap").when(overlap < 0.3, "low_token_overlap"),
    )
    return F.filter(tags, lambda t: t.isNotNull())


def failure_tags(results: DataFrame) -> DataFrame:
    """How often each tag occurs among the failures."""
    tags = F.concat(error_tags(F.col("text"), F.col("target"), F.col("method")), F.when(F.col("suppressed"), F.array(F.lit("suppressed"))).otherwise(F.array().cast("array<string>")))
    return results.where(~F.col("top1")).select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def method_errors(results: DataFrame) -> DataFrame:
    return results.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("top1")).alias("n_failed"), F.round(F.avg((~F.col("top1")).cast("double")), 6).alias("error_rate"))


def score_histogram(results: DataFrame) -> DataFrame:
    """Failures by first score in [0,.1) [.1,.3) [.3,.5) [.5,.7) [.7,1.01); suppressed ones are left out."""
    s = F.col("top1_score")
    slot = F.when(s < 0.1, "0.0-0.1").when(s < 0.3, "0.1-0.3").when(s < 0.5, "0.3-0.5").when(s < 0.7, "0.5-0.7").otherwise("0.7-1.0")
    return results.where(~F.col("top1") & ~F.col("suppressed")).groupBy(slot.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def failure_stats(results: DataFrame) -> DataFrame:
    """One row: failures, nearly-hits, score percentiles, overlap of cleaned names, short targets."""
    failed = results.where(~F.col("top1"))
    q, t = T.clean_name(F.col("text")), T.clean_name(F.col("target"))
    rows = failed.withColumns({"q": q, "t": t})
    overlap = F.when(F.col("t") != "", T.token_jaccard(F.col("q"), F.col("t")))
    rows = rows.withColumn("overlap", overlap)
    return rows.agg(F.count(F.lit(1)).alias("n_failed"), F.count_if(F.col("in_list")).alias("n_in_list"), F.round(F.percentile("top1_score", 0.5), 6).alias("median_score"), F.round(F.avg("overlap"), 6).alias("mean_overlap"), F.count_if(F.col("overlap") == 0).alias("n_no_overlap"), F.count_if(F.size(T.tokens(F.col("target"))) <= 3).alias("n_short_targets"))


def confusable_prefixes(results: DataFrame) -> DataFrame:
    """Failures whose wrong first result begins like the target (three characters of the cleaned names)."""
    rows = results.where(~F.col("top1") & F.col("top1_company").isNotNull()).select(F.substring(T.clean_name(F.col("target")), 1, 3).alias("prefix"), F.substring(T.clean_name(F.col("top1_company")), 1, 3).alias("other"))
    return rows.where("prefix = other").groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))


# Share of failures (in %) from which a diagnosis is given.
DIAGNOSES = [("low_token_overlap", 20), ("word_reorder", 5), ("no_accent", 30), ("abbreviated", 15), ("single_token", 15), ("suppressed", 10)]


def diagnosis(tags: DataFrame, n_failed: int) -> DataFrame:
    """Tags whose share of the failures reaches their threshold."""
    rules = tags.sparkSession.createDataFrame(DIAGNOSES, "tag string, threshold int")
    share = F.round(100.0 * F.col("n") / F.lit(max(1, n_failed)), 6)
    return tags.join(rules, "tag").withColumn("share", share).where("share >= threshold")


def accuracy_by(results: DataFrame, category: str = "method") -> DataFrame:
    """Strict accuracy of the first 1, 3 and 5 results per category."""
    hits = [F.round(F.avg((F.coalesce("target_rank", F.lit(1 << 30)) <= k).cast("double")), 6).alias(f"strict_top{k}") for k in (1, 3, 5)]
    return results.groupBy(category).agg(F.count(F.lit(1)).alias("n"), *hits)


def errors(results: DataFrame) -> DataFrame:
    """What failed: the query, its target, and what was found in its place (null: nothing)."""
    return results.where(~F.col("top1")).select("query_id", "text", "target", "method", "top1_company", "top1_score")


def latency_stats(milliseconds: list[float]) -> dict[str, float]:
    """Mean and the values at places n / 2, 0.95 n and 0.99 n of the sorted measurements; empty for none."""
    xs = sorted(milliseconds)
    if not xs:
        return {}
    return {"avg": sum(xs) / len(xs)} | {f"p{p}": xs[min(len(xs) - 1, p * len(xs) // 100)] for p in (50, 95, 99)}


def timed(calls) -> list[float]:
    """Milliseconds that each of the calls took."""
    out = []
    for call in calls:
        began = time.perf_counter()
        call()
        out.append(1000 * (time.perf_counter() - began))
    return out


def percentiles(values: DataFrame, column: str) -> DataFrame:
    """Mean, p50, p95 and p99 (linear between neighbours)."""
    return values.agg(F.round(F.avg(column), 6).alias("avg"), *[F.round(F.percentile(column, p), 6).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)])
