"""The batch pipeline: extract, deduplicate, index, match, with metrics and alerts.  Every step is distributed."""

from __future__ import annotations

import functools
import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import textnorm as T
from ..operators import dedup, dense, quality, ranking, score, search
from ..operators.index import Index, MatchConfig, build_index, model_of
from ..sources import storage
from .config import PipelineConfig

log = logging.getLogger(__name__)


def logged(stage: str):
    """Log a stage's duration, and its failure."""

    def wrap(f):
        @functools.wraps(f)
        def run(*args, **kwargs):
            began = time.perf_counter()
            try:
                return f(*args, **kwargs)
            except Exception:
                log.exception("%s failed after %.1f s", stage, time.perf_counter() - began)
                raise
            finally:
                log.info("%s: %.1f s", stage, time.perf_counter() - began)

        return run

    return wrap


def silver(bronze: DataFrame, name: str = "company_name", validate: bool = True) -> DataFrame:
    """Valid rows with cleaned_name, no_accent_name, norm_key and processed_timestamp; other columns stay."""
    quality.require(bronze, [name])
    rows = quality.validate_names(bronze, name)[0] if validate else bronze
    rows = rows.withColumn("cleaned_name", T.clean_name(F.col(name)))
    return rows.withColumns({"no_accent_name": T.strip_accents(F.col("cleaned_name")), "norm_key": T.pipeline_key(F.col(name)), "processed_timestamp": F.current_timestamp()})


@logged("extract")
def run_extract(spark: SparkSession, bronze_path: str, silver_path: str, num_partitions: int = 200, validate: bool = True, fmt: str = "parquet") -> DataFrame:
    bronze = spark.read.format(fmt).load(bronze_path)
    if validate:
        stats = quality.validate_names(bronze)[1].first()
        if stats["many_invalid"]:
            log.warning("more than 10 %% of the names are invalid: %s", stats.asDict())
    storage.write_table(silver(bronze, validate=validate).repartition(num_partitions, "norm_key"), silver_path, fmt=fmt)
    return spark.read.format(fmt).load(silver_path)


@logged("deduplicate")
def run_dedup(spark: SparkSession, silver_path: str, out_path: str, strategy: str = "first", keep_originals: bool = True, row_id: str = "id", fmt: str = "parquet") -> DataFrame:
    rows = spark.read.format(fmt).load(silver_path)
    out = dedup.flagged(rows, strategy, row_id)
    columns = ["canonical_id", "company_name", "cleaned_name", "no_accent_name", "norm_key", "is_duplicate", "duplicate_group_size", *(["original_names"] if keep_originals else []), "processed_timestamp"]
    storage.write_table(out.select(*columns), out_path, fmt=fmt)
    return spark.read.format(fmt).load(out_path)


@logged("index")
def run_index(spark: SparkSession, dedup_path: str, index_path: str, config: MatchConfig = MatchConfig(), force: bool = False, fmt: str = "parquet") -> Index:
    """Reuse a stored index of the same configuration; otherwise build and store one."""
    if not force:
        try:
            have = Index.load(spark, index_path)
            if have.config == config:
                return have
        except Exception as e:  # absent or unreadable: rebuilt
            log.info("no usable index at %s (%s)", index_path, type(e).__name__)
    rows = spark.read.format(fmt).load(dedup_path).select(F.col("canonical_id").alias("doc_id"), F.col("company_name").alias("name"))
    index = build_index(rows, config)
    if model_of(config.model) == "lsa":
        index.latent = dense.latent(index)
    index.save(index_path)
    index.docs.unpersist()
    return Index.load(spark, index_path)


@logged("match")
def match(queries: DataFrame, index: Index, top_k: int = 5, min_score: float = 0.0, encoder: dense.Encoder | None = None) -> DataFrame:
    """Ranked matches of (query_id, query_text) by the index's model: lexical, latent, or with a dense side (``encoder``)."""
    quality.require(queries, ["query_id", "query_text"])
    cleaned = score.clean_queries(queries, index.config)
    return ranking.rank(search.scores(cleaned, index, top_k, encoder), cleaned, index, top_k, min_score)


def run_match(queries: DataFrame, index: Index, out_path: str, top_k: int = 5, min_score: float = 0.0, fmt: str = "parquet") -> DataFrame:
    """Matches with scores in [0, 1], written and read again."""
    valid, _ = quality.validate_scores(match(queries, index, top_k, min_score))
    storage.write_table(valid, out_path, fmt=fmt)
    return queries.sparkSession.read.format(fmt).load(out_path)


class Pipeline:
    """All stages in order; stages 1 to 3 can be skipped when their output is there."""

    def __init__(self, spark: SparkSession, config: PipelineConfig):
        self.spark, self.config = spark, config
        self.match_config = MatchConfig(model=config.model_name, remove_stopwords=config.remove_stopwords, fusion=config.fusion, rerank_n=config.rerank_n, gap_threshold=config.rerank_threshold, lsa_dims=config.lsa_dims, max_features=config.max_features)

    def run(self, queries: DataFrame, skip: tuple[int, ...] = ()) -> dict:
        c, spark = self.config, self.spark
        done: dict = {"status": "running", "stages": []}
        try:
            if 1 not in skip:
                run_extract(spark, c.bronze_path, c.silver_path, c.num_partitions, fmt=c.table_format)
                done["stages"].append("extract")
            if 2 not in skip:
                run_dedup(spark, c.silver_path, c.silver_path + "_dedup", c.dedup_strategy, fmt=c.table_format)
                done["stages"].append("deduplicate")
            index = run_index(spark, c.silver_path + "_dedup", c.index_path, self.match_config, force=3 not in skip, fmt=c.table_format)
            done["stages"].append("index")
            return done | self.match_only(queries, index) | {"status": "success", "stages": [*done["stages"], "match"]}
        except Exception as e:
            done |= {"status": "failed", "error": str(e)}
            self.last = done
            raise

    def match_only(self, queries: DataFrame, index: Index | None = None) -> dict:
        c = self.config
        index = index or Index.load(self.spark, c.index_path)
        matches = run_match(queries, index, c.gold_path, c.top_k, c.min_score, c.table_format)
        metrics = quality.quality_metrics(matches)
        storage.append_metrics(metrics, c.metrics_path, "match")
        alerts = [r.asDict() for r in quality.quality_alerts(metrics, c.min_avg_score, c.min_high_rate).collect()]  # two rows at most
        return {"status": "success", "matches": matches, "metrics": metrics.first().asDict(), "alerts": alerts}

    def cleanup(self) -> None:
        """Drop cached data and stop the session."""
        self.spark.catalog.clearCache()
        self.spark.stop()
