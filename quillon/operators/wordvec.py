"""Hashed word vectors: term frequencies in a fixed number of buckets, smoothed idf, cosine; joins on buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import textnorm as T

BUCKETS = 10_000


def bucket(token: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of a token: 28 bits of its MD5, modulo ``buckets``."""
    return (F.conv(F.substring(F.md5(F.encode(token, "UTF-8")), 1, 7), 16, 10).cast("long") % buckets).cast("int")


def frequencies(rows: DataFrame, key: str, cleaned: str = "cleaned", buckets: int = BUCKETS) -> DataFrame:
    """(key, bucket, tf) of the white-space tokens."""
    return rows.select(key, F.explode(T.tokens(F.col(cleaned))).alias("token")).select(key, bucket(F.col("token"), buckets).alias("bucket")).groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("tf"))


def topk(queries: DataFrame, docs: DataFrame, k: int = 5, buckets: int = BUCKETS) -> DataFrame:
    """The k most similar documents per query by the cosine of tf * ln((n + 1) / (df + 1)); both sides carry ``cleaned``.

    Documents with similarity 0 are absent, ties go to the smaller doc_id.  A bucket that is in every document weighs 0 and
    is dropped before the join, so the hottest words never pair rows; at most ``buckets`` idf rows are broadcast."""
    d = frequencies(docs, "doc_id", buckets=buckets)
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    idf = d.groupBy("bucket").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n)).select("bucket", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf")).where("idf > 0")
    weigh = lambda f: f.join(F.broadcast(idf), "bucket").withColumn("w", F.col("tf") * F.col("idf"))
    dw, qw = weigh(d), weigh(frequencies(queries, "query_id", buckets=buckets))
    norm = lambda f, key, name: f.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias(name))
    dots = qw.select("query_id", "bucket", F.col("w").alias("v")).join(dw.select("doc_id", "bucket", "w"), "bucket").groupBy("query_id", "doc_id").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    scored = dots.join(norm(qw, "query_id", "a"), "query_id").join(norm(dw, "doc_id", "b"), "doc_id").select("query_id", "doc_id", F.round(F.col("dot") / (F.col("a") * F.col("b")), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
