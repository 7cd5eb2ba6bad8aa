"""Fusion and rerank strategies over two score relations (query_id, doc_id, score): lexical and dense."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import textnorm as T
from .score import blend


def clip(scores: DataFrame) -> DataFrame:
    return scores.withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))


def top(scores: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def weighted(lexical: DataFrame, dense: DataFrame, a: float = 0.5, b: float = 0.5) -> DataFrame:
    return blend(lexical, clip(dense), a, b)


def rrf(lists: list[DataFrame], docs: DataFrame, queries: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal ranks, summed over the lists.  A document that a list lacks ranks behind the list's own, by doc_id:
    its place among the missing is its place among all documents less the listed ones before it, both counted by
    windows, so each list costs one sort per query."""
    every = docs.select("doc_id").join(queries.select("query_id"))
    out = every
    for i, scores in enumerate(lists):
        full = every.join(scores, ["query_id", "doc_id"], "left")
        w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "doc_id")
        ranked = full.select("query_id", "doc_id", (1.0 / (k + F.row_number().over(w))).alias(f"s{i}"))
        out = out.join(ranked, ["query_id", "doc_id"])
    total = sum((F.col(f"s{i}") for i in range(len(lists))), F.lit(0.0))
    return out.select("query_id", "doc_id", F.round(total, 9).alias("score"))


def rerank(lexical: DataFrame, dense: DataFrame, n: int) -> DataFrame:
    """The n best lexical documents by their dense score."""
    return top(lexical, n).select("query_id", "doc_id").join(dense, ["query_id", "doc_id"])


def union_rerank(lexical: DataFrame, dense: DataFrame, n: int) -> DataFrame:
    """The n best of either list by their dense score."""
    both = top(lexical, n).select("query_id", "doc_id").union(top(dense, n).select("query_id", "doc_id")).distinct()
    return both.join(dense, ["query_id", "doc_id"])


def undecided(lexical: DataFrame, gap: float) -> DataFrame:
    """query_id and whether the first two scores are nearer than ``gap`` (a lone result counts as decided by itself)."""
    first = top(lexical, 2).groupBy("query_id").agg(F.max("score").alias("a"), F.when(F.count(F.lit(1)) > 1, F.min("score")).otherwise(F.lit(0.0)).alias("b"))
    return first.select("query_id", (F.round(F.col("a") - F.col("b"), 9) < gap).alias("open"))


def adaptive(lexical: DataFrame, dense: DataFrame, n: int, gap: float) -> DataFrame:
    """Rerank only the queries whose lexical result is undecided; dense rows of the others are never joined."""
    state = undecided(lexical, gap)
    opened = lexical.join(state.where("open"), "query_id", "left_semi")
    settled = lexical.join(state.where("NOT open"), "query_id", "left_semi")
    return settled.select("query_id", "doc_id", "score").unionByName(rerank(opened, dense, n).select("query_id", "doc_id", "score"))


def cross_rerank(lexical: DataFrame, queries: DataFrame, docs: DataFrame, n: int, scorer) -> DataFrame:
    """The n best lexical documents by the sigmoid of a pair scorer, a function of two Columns (query, name)."""
    pairs = top(lexical, n).select("query_id", "doc_id").join(queries.select("query_id", "query_text"), "query_id").join(docs.select("doc_id", "name"), "doc_id")
    return pairs.select("query_id", "doc_id", F.round(T.sigmoid(scorer(F.col("query_text"), F.col("name"))), 6).alias("score"))
