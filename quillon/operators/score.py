"""Scores of queries against an index: joins on terms and sums, never one query at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import textnorm as T
from .index import Index, MatchConfig, model_of, term_counts, token_counts


def clean_queries(queries: DataFrame, config: MatchConfig) -> DataFrame:
    """(query_id, query_text) with the cleaned text; cleaned once."""
    return queries.select("query_id", "query_text", T.clean_name(F.col("query_text"), config.remove_stopwords).alias("cleaned"))


def tfidf(queries: DataFrame, index: Index) -> DataFrame:
    """Cosine of sublinear, smoothed TF-IDF weights of character n-grams; pairs without a common gram score 0 and are absent.

    The idf of both sides sits on the query's terms, so the postings are joined as they are stored."""
    q = term_counts(queries, "query_id", "cleaned", index.config).join(index.gram_idf, "term")
    q = q.withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("qnorm"))
    terms = q.select("query_id", "term", (F.col("w") * F.col("idf")).alias("w"))
    dots = terms.join(index.grams, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * (1 + F.log("tf"))).alias("dot"))
    return dots.join(norm, "query_id").join(index.gram_norms, "doc_id").select("query_id", "doc_id", F.round(F.col("dot") / (F.col("qnorm") * F.col("norm")), index.config.digits).alias("score"))


def bm25(queries: DataFrame, index: Index) -> DataFrame:
    """BM25 over white-space tokens, repeated query tokens counted as often."""
    c, avgdl = index.config, max(index.stats["avgdl"], 1e-9)
    q = token_counts(queries, "query_id", "cleaned").select("query_id", "token", F.col("tf").alias("qtf")).join(index.word_idf, "token")
    tf = F.col("tf")
    part = F.col("qtf") * F.col("idf") * tf * (c.k1 + 1) / (tf + c.k1 * (1 - c.b + c.b * F.col("dl") / avgdl))
    return q.join(index.words, "token").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), c.digits).alias("score"))


def over_best(scores: DataFrame) -> DataFrame:
    """Scores over the query's best, if that is positive (documents without a score have 0)."""
    best = F.greatest(F.max("score").over(Window.partitionBy("query_id")), F.lit(0.0))
    return scores.select("query_id", "doc_id", F.when(best > 0, F.col("score") / best).otherwise(F.col("score")).alias("score"))


def blend(left: DataFrame, right: DataFrame, a: float, b: float, digits: int = 6) -> DataFrame:
    """a * left + b * right, with 0 where a side has no row."""
    both = left.withColumnRenamed("score", "x").join(right.withColumnRenamed("score", "y"), ["query_id", "doc_id"], "full")
    return both.select("query_id", "doc_id", F.round(a * F.coalesce("x", F.lit(0.0)) + b * F.coalesce("y", F.lit(0.0)), digits).alias("score"))


def hybrid(queries: DataFrame, index: Index) -> DataFrame:
    c = index.config
    return blend(tfidf(queries, index), over_best(bm25(queries, index)), c.tfidf_weight, c.bm25_weight, c.digits)


def substring(queries: DataFrame, docs: DataFrame, limit: int = 3) -> DataFrame:
    """Names that contain the query's first token: score 1, ``limit`` per query (smallest doc_id).

    Every substring of a token-sized needle lies within a run of the cleaned name, so names are matched through
    their distinct substrings of the needles' lengths: an equi-join, not a pairing of all rows."""
    needle = F.get(T.tokens(F.col("cleaned")), F.lit(0))
    q = queries.select("query_id", needle.alias("needle")).where("needle IS NOT NULL")
    sizes = [r["n"] for r in q.select(F.length("needle").alias("n")).distinct().collect()]  # distinct token lengths
    if not sizes:
        return q.select("query_id", F.lit(0).cast("long").alias("doc_id"), F.lit(1.0).alias("score")).where("false")

    def substrings(n):
        return F.when(F.length("cleaned") >= n, F.transform(F.sequence(F.lit(1), F.length("cleaned") - n + 1), lambda i: F.substring("cleaned", i, n))).otherwise(F.array().cast("array<string>"))

    pieces = F.flatten(F.array(*map(substrings, sorted(sizes))))
    parts = docs.select("doc_id", F.explode(F.array_distinct(pieces)).alias("needle")).join(q.select("needle").distinct(), "needle", "left_semi")
    hits = q.join(parts, "needle")
    return hits.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))).where(F.col("rn") <= limit).select("query_id", "doc_id", F.lit(1.0).alias("score"))


def sparse(queries: DataFrame, index: Index) -> DataFrame:
    """Scores of the index's own lexical model."""
    model = model_of(index.config.model)
    lexical = {"tfidf": tfidf, "bm25": bm25, "hybrid": hybrid}
    if model not in lexical:
        raise ValueError(f"{model} is no lexical model; use operators.search.scores")
    return lexical[model](queries, index)
