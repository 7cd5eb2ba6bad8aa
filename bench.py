"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Every query runs once on the smallest tables first, so that the figures are those of a warm JVM; queries under
QUICK seconds are timed three times and their median counts."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["clean_names", "ngram_statistics", "match_tfidf", "match_bm25", "match_hybrid", "match_hashed_words", "fusion_rrf", "dense_topk", "dedup_first", "dedup_flagged", "validation_stats", "quality_metrics", "eval_sweep", "document_copies", "page_anchors", "upsert_rows", "event_windows"]

QUICK = 3.0


def main() -> None:
    from pyspark.sql import SparkSession

    from quillon.plans import registry

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # starts the JVM's readers
    queries, times = registry.queries(), {}

    def run(name: str, folder: str) -> float:
        began = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - began
        spark.catalog.clearCache()
        return took

    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for name in HEADLINE:
        run(name, small if os.path.isdir(small) else sf_dir)
    for name in HEADLINE:
        took = [run(name, sf_dir)]
        if took[0] < QUICK:
            took += [run(name, sf_dir) for _ in range(2)]
        times[name] = round(statistics.median(took), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "warm": True, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
