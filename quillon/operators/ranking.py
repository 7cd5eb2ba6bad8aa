"""From scores to ranked results: oversampling, key groups, penalty, legal-form promotion, abstention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import textnorm as T
from .index import Index

REPEAT_PENALTY, ENTITY_GAP = 0.85, 0.20


def oversample(scores: DataFrame, top_k: int, factor: int = 5) -> DataFrame:
    """The best factor * top_k documents per query with a positive score; ties by doc_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.where("score > 0").withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= factor * top_k)


def groups(best: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per query and key: its best score and position, and how many names share the key."""
    size = docs.groupBy("norm_key").agg(F.count(F.lit(1)).alias("members"))
    keyed = best.join(docs.select("doc_id", "norm_key"), "doc_id")
    return keyed.groupBy("query_id", "norm_key").agg(F.max("score").alias("score"), F.min("pos").alias("pos")).join(size, "norm_key")


def stop_rule(grouped: DataFrame, top_k: int) -> DataFrame:
    """Groups in order until top_k names are out; the last group stays whole."""
    before = Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return grouped.withColumn("before", F.coalesce(F.sum("members").over(before), F.lit(0))).where(F.col("before") < top_k).drop("before", "members")


def expand(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """All names of each kept key, with its score, numbered in order."""
    rows = kept.join(docs.select("doc_id", "name", "norm_key"), "norm_key")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("pos", "doc_id")))


def penalise(rows: DataFrame, digits: int = 6) -> DataFrame:
    """Names with repeated words lose; then a stable sort by score."""
    score = F.when(T.has_repeats(F.col("norm_key")), F.round(F.col("score") * REPEAT_PENALTY, digits)).otherwise(F.col("score"))
    again = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "old"))
    return rows.withColumn("score", score).withColumnRenamed("pos", "old").withColumn("pos", again).drop("old")


def promote(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """If the query names a legal form that the first result lacks, the best result that has it moves first,
    provided it is within ENTITY_GAP of the first."""
    typed = rows.withColumn("kind", T.entity_type(F.col("norm_key"))).join(queries.select("query_id", T.entity_type(F.col("cleaned")).alias("wanted")), "query_id")
    w = Window.partitionBy("query_id")
    first = F.col("pos") == 1
    typed = typed.withColumns(
        {
            "top": F.max(F.when(first, F.col("score"))).over(w),
            "fits": F.max(F.when(first, F.col("kind").eqNullSafe(F.col("wanted")))).over(w),
            "j": F.min(F.when(F.col("kind") == F.col("wanted"), F.col("pos"))).over(w),
        }
    )
    typed = typed.withColumn("near", F.max(F.when(F.col("pos") == F.col("j"), F.round(F.col("top") - F.col("score"), 9) <= ENTITY_GAP)).over(w))
    move = F.col("wanted").isNotNull() & ~F.col("fits") & F.col("j").isNotNull() & F.coalesce("near", F.lit(False))
    pos = F.when(move & (F.col("pos") == F.col("j")), 1).when(move & (F.col("pos") < F.col("j")), F.col("pos") + 1).otherwise(F.col("pos"))
    return typed.withColumn("pos", pos).drop("kind", "wanted", "top", "fits", "j", "near")


def abstain(rows: DataFrame, min_score: float) -> DataFrame:
    """No result at all for queries whose first result is below min_score."""
    if min_score <= 0:
        return rows
    lead = F.max(F.when(F.col("pos") == 1, F.col("score"))).over(Window.partitionBy("query_id"))
    return rows.withColumn("lead", lead).where(F.col("lead") >= min_score).drop("lead")


def rank(scores: DataFrame, queries: DataFrame, index: Index, top_k: int = 5, min_score: float = 0.0) -> DataFrame:
    """query_id, query_text, matched_company, canonical_id, score, rank, match_confidence."""
    kept = stop_rule(groups(oversample(scores, top_k), index.docs), top_k)
    rows = abstain(promote(penalise(expand(kept, index.docs), index.config.digits), queries), min_score)
    out = rows.join(queries.select("query_id", "query_text"), "query_id")
    return out.select("query_id", "query_text", F.col("name").alias("matched_company"), F.col("doc_id").cast("string").alias("canonical_id"), "score", F.col("pos").cast("int").alias("rank"), T.confidence(F.col("score")).alias("match_confidence"))


def boost(matches: DataFrame, exact: float = 1.2, prefix: float = 1.1) -> DataFrame:
    """Business-rule rerank: equal cleaned names, then common beginnings, gain; scores stay at most 1."""
    q, m = T.clean_name(F.col("query_text")), T.clean_name(F.col("matched_company"))
    gain = F.when(q == m, exact).when((q != "") & m.startswith(q), prefix).otherwise(1.0)
    scored = matches.withColumn("score", F.round(F.least(F.lit(1.0), F.col("score") * gain), 6)).withColumn("old", F.col("rank"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "old")).cast("int")).drop("old")
