"""The ten operators and the pipeline as queries over a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import avi, hilbert, langid, lm, mixing, pieces, quality, rules, simhash, tokenfile

#: Wanted token shares of the domains, for the query and the pipeline.
WEIGHTS = {"high": 0.90, "low": 0.07, "toxic": 0.03}
SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of the Hilbert order under the law ``rows``."""
    docs = table(spark, sf_dir, "documents")
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    carry = {"doc_id": F.col("doc_id"), "size": (F.octet_length(text) + 16).cast("long"), "text_crc32": F.crc32(text)}
    out = hilbert.hilbert_shards(docs, ["source", "lang", "n_chars", "doc_id"], SHARDS, carry=carry, ties=["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors, rates and copies that bring the token shares to WEIGHTS."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), WEIGHTS, scale=1.0)[0]


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_table(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.op6(table(spark, sf_dir, "documents"))


def op7_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.op7(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op8(table(spark, sf_dir, "documents"))


def op9_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.op9(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def op10_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.op10(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    every = [op1_hilbert, op2_mixing, op3_sentencepiece, op4_quality, op5_langid, op6_rules, op7_avi, op8_simhash, op9_attention, op10_huffman, pipeline]
    return {q.__name__: q for q in every}


def oracle_sql() -> dict[str, str]:
    return {"op6_rules": rules.ORACLE}
