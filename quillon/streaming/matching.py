"""Streaming extension: query streams against a stored index, and windowed event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.index import Index
from ..plans.pipeline import match


def match_stream(queries: DataFrame, index: Index, out_path: str, checkpoint: str, top_k: int = 5, min_score: float = 0.0):
    """Match every micro-batch of (query_id, query_text) and append the results; a repeated batch overwrites its own folder."""

    def run(batch: DataFrame, number: int) -> None:
        match(batch, index, top_k, min_score).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and type, with a watermark where the input is a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
