"""A training-data pipeline over ``documents``: rules, language, near-duplicates, mixing, pieces.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and all but the last return
the columns of ``documents``.  Nothing is sampled between stages.

Rows with null, empty or wordless texts end at the first stage; very long texts are read whole; repeated rows share
their fate, but for near_dedup, which keeps one; null ids are kept by the rules of each operator; an empty table
passes through as an empty table; extra columns of any name are carried to the last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import langid, mixing, pieces, rules, simhash
from quillon.llm.common import materialise
from quillon.llm.queries import WEIGHTS, table, tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.  Null, empty and wordless texts are rejected; repeated rows agree."""
    return rules.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language that the labelled rows teach.  Letterless and undecided texts go; a table
    without labelled rows teaches nothing and keeps nothing."""
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates, by SimHash fingerprints in multi-index tables, an
    exact check of what they find, and an exact search for what lies beyond their reach: five-word shingle sets with a Jaccard
    similarity of 0.8 or more, and what such links join.  Of rows without an id, one per text stays, if no id does."""
    return simhash.keep_one(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says; the wanted domain is never thinned, so the others make room.  Repeated rows
    get equal copies; without labels all posteriors are equal and so are the rates."""
    return mixing.resample(docs, table(spark, sf_dir, "labels"), WEIGHTS, protect="high")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every remaining row, decoded again for the proof of the round trip."""
    return pieces.encode_table(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_dedup", near_dedup), ("mix_domains", mix_domains), ("sentencepiece", sentencepiece)]

#: Learned models, hashes and Viterbi paths have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
