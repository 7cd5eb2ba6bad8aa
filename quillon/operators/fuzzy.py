"""Fuzzy string baselines.  Longest common subsequences have no built-in form: one Arrow-batched UDF scores
every query with every name, as typing errors leave pairs without a common token."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions import textnorm as T


def indel_ratio(a: str, b: str) -> float:
    """2 * LCS / (len(a) + len(b)), by bit-parallel rows."""
    if not a and not b:
        return 1.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & places.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return 2 * (len(a) - s.bit_count()) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> int:
    """Integer percent: the best ratio among the shared tokens and each side's shared tokens with its own."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100
    left, right = (both + " " + " ".join(sorted(x - y))).strip(), (both + " " + " ".join(sorted(y - x))).strip()
    best = max(indel_ratio(left, right), *([indel_ratio(both, left), indel_ratio(both, right)] if both else [0.0]))
    return round(100 * best)


@F.pandas_udf(IntegerType())
def token_set_scores(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


def match(queries: DataFrame, docs: DataFrame, top_k: int = 5) -> DataFrame:
    """The top_k names per query by token-set ratio / 100 of the cleaned texts, over all names; ties by doc_id."""
    q = queries.select("query_id", T.clean_name(F.col("query_text")).alias("q"))
    d = docs.select("doc_id", T.clean_name(F.col("name")).alias("d"))
    scored = d.crossJoin(q).select("query_id", "doc_id", (token_set_scores("q", "d") / 100).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def with_fallback(matches: DataFrame, fuzzy: DataFrame, docs: DataFrame, queries: DataFrame, below: float = 0.5, least: float = 0.8) -> DataFrame:
    """Queries whose first result scores under ``below`` take the first fuzzy result instead, if it scores over ``least``."""
    weak = queries.select("query_id", "query_text").join(matches.where((F.col("rank") == 1) & (F.col("score") >= below)).select("query_id"), "query_id", "left_anti")
    better = fuzzy.where((F.col("rank") == 1) & (F.col("score") > least)).join(weak, "query_id").join(docs.select("doc_id", "name"), "doc_id")
    new = better.select("query_id", "query_text", F.col("name").alias("matched_company"), F.col("doc_id").cast("string").alias("canonical_id"), "score", F.col("rank").cast("int").alias("rank"), T.confidence(F.col("score")).alias("match_confidence"))
    return matches.join(new.select("query_id"), "query_id", "left_anti").unionByName(new)
