"""Scores of an index's model: lexical, latent, or lexical and dense together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dense, fusion, score
from .index import Index, model_of, term_counts


def latent(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """The k nearest names in the latent space; the index's stored vectors, if it has them."""
    docs, terms = index.latent or dense.latent(index)
    w = term_counts(queries, "query_id", "cleaned", index.config).join(terms, "term").select("query_id", "col", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    return dense.topk(dense.project(w, terms.select("col", "vector"), "query_id"), docs, k).drop("rank")


def with_vectors(queries: DataFrame, index: Index, encoder: dense.Encoder, cleaned: bool = False) -> tuple[DataFrame, DataFrame]:
    """Queries and names with vectors of the raw, lower-cased or cleaned text."""
    q, n = (F.col("cleaned"), F.col("cleaned")) if cleaned else (F.lower("query_text"), F.lower("name"))
    return queries.withColumn("vector", encoder.encode(q)), index.docs.withColumn("vector", encoder.encode(n))


def fused(lexical: DataFrame, queries: DataFrame, index: Index, encoder: dense.Encoder, k: int, strategy: str) -> DataFrame:
    """A lexical relation and the encoder's vectors under a fusion strategy.  Only pairs that either side ranks are scored."""
    c = index.config
    q, docs = with_vectors(queries, index, encoder)
    near = lambda pairs: dense.pair_scores(pairs.select("query_id", "doc_id"), q, docs)
    if strategy == "tfidf-rerank":
        return near(fusion.top(lexical, c.rerank_n))
    if strategy == "adaptive-rerank":
        return fusion.adaptive(lexical, near(fusion.top(lexical, c.rerank_n)), c.rerank_n, c.gap_threshold)
    far = dense.topk(q, docs, max(k, c.rerank_n)).drop("rank")
    if strategy == "union-rerank":
        return fusion.union_rerank(lexical, near(fusion.top(lexical, c.rerank_n).select("query_id", "doc_id").union(fusion.top(far, c.rerank_n).select("query_id", "doc_id")).distinct()).unionByName(far).distinct(), c.rerank_n)
    pairs = lexical.select("query_id", "doc_id").union(far.select("query_id", "doc_id")).distinct()
    if strategy == "rrf":
        return fusion.rrf([lexical, near(pairs)], index.docs, queries)
    if strategy == "weighted":
        return fusion.weighted(lexical, near(pairs), 1 - c.dense_weight, c.dense_weight)
    raise ValueError(f"unknown fusion strategy {strategy!r}")


def scores(queries: DataFrame, index: Index, top_k: int = 5, encoder: dense.Encoder | None = None) -> DataFrame:
    """(query_id, doc_id, score) of cleaned queries by the index's model; ``encoder`` serves the models with a dense side (by
    default a hashed stand-in, as no learned encoder is assumed)."""
    model, encoder = model_of(index.config.model), encoder or dense.HashedNgrams()
    if model == "lsa":
        return latent(queries, index, 5 * top_k)
    if model == "tfidf-dense":
        return fused(score.tfidf(queries, index), queries, index, encoder, 5 * top_k, index.config.fusion)
    if model == "bm25-dense":
        return fused(score.over_best(score.bm25(queries, index)), queries, index, encoder, 5 * top_k, "weighted")
    if model == "gap-rerank":
        lexical = fusion.top(score.tfidf(queries, index), 4 * top_k)
        return fused(lexical, queries, index, encoder, 5 * top_k, "adaptive-rerank")
    return score.sparse(queries, index)
