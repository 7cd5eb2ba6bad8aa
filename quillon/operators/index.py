"""Inverted index of names as DataFrames: postings, document frequencies, norms."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import textnorm as T


@dataclass(frozen=True)
class MatchConfig:
    """Everything that shapes an index and a search; stored with the index."""

    model: str = "tfidf"
    remove_stopwords: bool = True
    tfidf_weight: float = 0.5
    bm25_weight: float = 0.5
    dense_weight: float = 0.5
    fusion: str = "adaptive-rerank"
    rerank_n: int = 50
    gap_threshold: float = 0.08
    ngram_low: int = 2
    ngram_high: int = 5
    lsa_dims: int = 512
    max_features: int = 100_000
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    digits: int = 6
    max_df: float | None = None


#: Accepted model names and what they run as.
ALIASES = {"tfidf": "tfidf", "tfidf-char-ngram": "tfidf", "bm25": "bm25", "tfidf-bm25": "hybrid", "hybrid": "hybrid", "tfidf-lsa": "lsa", "lsa": "lsa", "tfidf-dense": "tfidf-dense", "bm25-dense": "bm25-dense", "tfidf-wordllama": "gap-rerank", "hybrid-cross-lang": "gap-rerank"}


def model_of(name: str) -> str:
    """The engine's model for a name; unknown names fall back to TF-IDF with a warning."""
    if name not in ALIASES:
        import warnings

        warnings.warn(f"unknown model {name!r}: using tfidf", stacklevel=2)
    return ALIASES.get(name, "tfidf")


@dataclass
class Index:
    """docs(doc_id, name, cleaned, norm_key); grams(term, doc_id, tf); gram_idf(term, idf); gram_norms(doc_id, norm);
    words(token, doc_id, tf, dl); word_idf(token, idf); sizes as plain numbers."""

    docs: DataFrame
    grams: DataFrame
    gram_idf: DataFrame
    gram_norms: DataFrame
    words: DataFrame
    word_idf: DataFrame
    config: MatchConfig
    stats: dict = field(default_factory=dict)
    #: Of a latent model: vectors (doc_id, vector) and the projection (term, col, idf, vector).
    latent: tuple[DataFrame, DataFrame] | None = None

    TABLES = ("docs", "grams", "gram_idf", "gram_norms", "words", "word_idf")

    def save(self, path: str) -> None:
        """Parquet tables, postings clustered by term, and a JSON manifest."""
        for name in self.TABLES:
            df = getattr(self, name)
            key = {"grams": "term", "words": "token"}.get(name)
            (df.repartition(F.col(key)).sortWithinPartitions(key) if key else df).write.mode("overwrite").parquet(f"{path}/{name}")
        for name, df in zip(("latent_docs", "latent_terms"), self.latent or (), strict=False):
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.docs.sparkSession
        manifest = json.dumps({"config": asdict(self.config), "stats": self.stats, "latent": self.latent is not None})
        spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        manifest = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/manifest").collect()))
        latent = tuple(spark.read.parquet(f"{path}/{n}") for n in ("latent_docs", "latent_terms")) if manifest.get("latent") else None
        return cls(*[spark.read.parquet(f"{path}/{n}") for n in cls.TABLES], MatchConfig(**manifest["config"]), manifest["stats"], latent)


def term_counts(rows: DataFrame, key: str, cleaned: str, config: MatchConfig) -> DataFrame:
    """(key, term, tf) of character n-grams.  The short names are dealt by key, so their many grams are not."""
    grams = T.char_ngrams(F.col(cleaned), config.ngram_low, config.ngram_high)
    return rows.select(key, F.explode(grams).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def token_counts(rows: DataFrame, key: str, cleaned: str) -> DataFrame:
    """(key, token, tf, dl) of white-space tokens."""
    t = rows.select(key, T.tokens(F.col(cleaned)).alias("ts")).select(key, F.size("ts").alias("dl"), F.explode("ts").alias("token"))
    return t.groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))


def build_index(names: DataFrame, config: MatchConfig = MatchConfig()) -> Index:
    """Index ``names`` (doc_id, name).  Only counts and averages reach the driver."""
    cleaned = T.clean_name(F.col("name"), config.remove_stopwords)
    docs = names.select("doc_id", "name", cleaned.alias("cleaned")).withColumn("norm_key", T.matcher_key(F.col("cleaned"))).repartition("doc_id").cache()
    grams = term_counts(docs, "doc_id", "cleaned", config)
    n = docs.count()
    df = grams.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if config.max_df is not None:
        df = df.where(F.col("df") <= config.max_df * n)
    gram_idf = df.select("term", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    norms = grams.join(gram_idf, "term").groupBy("doc_id").agg(F.sqrt(F.sum(F.pow((1 + F.log("tf")) * F.col("idf"), 2))).alias("norm"))
    words = token_counts(docs, "doc_id", "cleaned")
    wdf = words.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    raw = wdf.select("token", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = docs.agg(F.avg(F.size(T.tokens(F.col("cleaned")))).alias("dl")).first()["dl"] or 0.0
    floor = config.epsilon * (raw.agg(F.avg("idf").alias("m")).first()["m"] or 0.0)
    word_idf = raw.select("token", F.when(F.col("idf") < 0, F.lit(floor)).otherwise(F.col("idf")).alias("idf"))
    return Index(docs, grams, gram_idf, norms, words, word_idf, config, {"n": n, "avgdl": float(mean)})
