"""Pipeline and session configuration: defaults, YAML profiles, environment overrides."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, fields

from pyspark.sql import SparkSession


@dataclass
class PipelineConfig:
    app_name: str = "quillon"
    master: str = "local[*]"
    remote: str | None = None
    token: str | None = None
    bronze_path: str = "data/bronze"
    silver_path: str = "data/silver"
    gold_path: str = "data/gold"
    index_path: str = "data/index"
    metrics_path: str = "data/metrics"
    model_name: str = "tfidf-lsa"
    fusion: str = "adaptive-rerank"
    rerank_n: int = 50
    rerank_threshold: float = 0.08
    remove_stopwords: bool = True
    lsa_dims: int = 512
    max_features: int = 100_000
    num_partitions: int = 200
    shuffle_partitions: int = 200
    dedup_strategy: str = "first"
    top_k: int = 5
    min_score: float = 0.0
    min_avg_score: float = 0.85
    min_high_rate: float = 0.90
    table_format: str = "parquet"

    SECRET = ("token",)


PREFIX = "QUILLON_"


def _typed(kind: str, value):
    if not isinstance(value, str):
        return value
    if kind == "bool":
        return value.strip().lower() in ("1", "true", "yes", "on")
    return int(value) if kind == "int" else float(value) if kind == "float" else value


def load_config(path: str | None = None, profile: str | None = None, env: dict[str, str] | None = None) -> PipelineConfig:
    """Defaults, then the file's base section or, if named, the profile in its place, then QUILLON_* variables."""
    values: dict = {}
    if path:
        import yaml

        with open(path) as f:
            doc = yaml.safe_load(f) or {}
        if profile:
            values = doc["profiles"][profile]
        else:
            values = doc.get("base") or {k: v for k, v in doc.items() if k != "profiles"}
    kinds = {f.name: f.type for f in fields(PipelineConfig)}
    known = {k: _typed(kinds[k], v) for k, v in values.items() if k in kinds}
    for name, kind in kinds.items():
        if (v := (os.environ if env is None else env).get(PREFIX + name.upper())) is not None:
            known[name] = _typed(kind, v)
    return PipelineConfig(**known)


def save_config(config: PipelineConfig, path: str) -> None:
    """As YAML, without secrets."""
    import yaml

    with open(path, "w") as f:
        yaml.safe_dump({"base": {k: v for k, v in asdict(config).items() if k not in PipelineConfig.SECRET}}, f)


def session(config: PipelineConfig) -> SparkSession:
    """A local or remote session with adaptive execution and Arrow."""
    builder = SparkSession.builder.appName(config.app_name)
    builder = builder.remote(config.remote) if config.remote else builder.master(config.master)
    options = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.shuffle.partitions": str(config.shuffle_partitions), "spark.sql.session.timeZone": "UTC"}
    if config.table_format == "delta":
        options |= {"spark.sql.extensions": "io.delta.sql.DeltaSparkSessionExtension", "spark.sql.catalog.spark_catalog": "org.apache.spark.sql.delta.catalog.DeltaCatalog"}
    for k, v in options.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def remote_from_env(env: dict[str, str] | None = None) -> str | None:
    """A Spark Connect address from QUILLON_CONNECT_HOST, _PORT and _TOKEN; None if no host is set."""
    e = os.environ if env is None else env
    host = e.get(PREFIX + "CONNECT_HOST")
    token = e.get(PREFIX + "CONNECT_TOKEN")
    return None if not host else f"sc://{host}:{e.get(PREFIX + 'CONNECT_PORT', '15002')}" + (f"/;token={token}" if token else "")
