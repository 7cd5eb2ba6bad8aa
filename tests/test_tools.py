import hashlib
import math
from collections import Counter

import pytest
from labelled import PAIRS, TARGETS
from pyspark.sql import functions as F

from quillon.operators import dense, evaluate, quality, wordvec
from quillon.operators.index import build_index
from quillon.plans import pipeline
from quillon.sources import readers, storage



def test_hashed_words_equal_a_plain_loop(spark):
    texts = ["hoa sen viet", "hoa phat", "sen sen viet", "", "hoa", "viet viet hoa phat"]
    asked = ["hoa sen", "viet", "none", "", "sen phat phat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, cleaned string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, cleaned string")
    got = {(r.query_id, r.doc_id): r.score for r in wordvec.topk(queries, docs, 9, 7).collect()}  # 7 buckets collide

    def counts(s):
        return Counter(int(hashlib.md5(t.encode()).hexdigest()[:7], 16) % 7 for t in s.split())

    df = Counter(b for s in texts for b in counts(s))
    weigh = lambda s: {b: n * math.log((len(texts) + 1) / (df[b] + 1)) for b, n in counts(s).items() if df[b]}
    want = {}
    for i, q in enumerate(map(weigh, asked)):
        for j, d in enumerate(map(weigh, texts)):
            dot = sum(w * d.get(b, 0) for b, w in q.items())
            if dot > 0:
                want[i, j] = dot / math.sqrt(sum(w * w for w in q.values()) * sum(w * w for w in d.values()))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert wordvec.topk(queries, docs.limit(0)).count() == 0 == wordvec.topk(queries.limit(0), docs).count()


def test_hashed_words_cut_and_ties(spark):
    docs = spark.createDataFrame([(5, "a"), (3, "a"), (4, "a b"), (9, "c")], "doc_id long, cleaned string")
    out = wordvec.topk(spark.createDataFrame([(1, "a")], "query_id long, cleaned string"), docs, 2).orderBy("rank").collect()
    assert [(r.doc_id, r.rank) for r in out] == [(3, 1), (5, 2)]


def test_metrics_text(spark):
    rows = spark.createDataFrame([(0.95,), (0.8,), (0.1,), (0.2,)], "score double")
    text = quality.metrics_text(quality.quality_metrics(rows).first().asDict(), {"low": 2, "high": 1})
    assert "matches: 4" in text and "score avg: 0.5125" in text and "low confidence: 2 (50.0%)" in text and text.endswith("label high: 1\nlabel low: 2")
    assert quality.metrics_text(quality.quality_metrics(rows.limit(0)).first().asDict()) == "matches: 0"
    one = quality.metrics_text(quality.quality_metrics(rows.limit(1)).first().asDict())
    assert "score std: -" in one


def test_memory_probe(spark):
    got = quality.memory_probe(spark)
    assert 0 < got["heap_used_bytes"] <= got["heap_max_bytes"] and got["driver_peak_bytes"] > 1 << 20 and got["spark.sql.shuffle.partitions"] == "8"


def test_latency():
    assert evaluate.latency_stats([]) == {} and evaluate.latency_stats([3.0]) == {"avg": 3.0, "p50": 3.0, "p95": 3.0, "p99": 3.0}
    assert evaluate.latency_stats(list(map(float, range(100, 0, -1)))) == {"avg": 50.5, "p50": 51.0, "p95": 96.0, "p99": 100.0}
    assert len(evaluate.timed([lambda: None] * 3)) == 3


def test_similarity_table_and_sweep(spark):
    pairs = spark.createDataFrame([("hoa sen", "hoa sen"), ("hoa sen", "quantum"), (None, "a")], "original string, variant string")
    got = [r.similarity for r in dense.similarity_table(pairs, dense.HashedNgrams()).collect()]
    assert got[0] == 1.0 and got[1] < 0.5 and len(got) == 3
    table = dense.batch_sweep(pairs, lambda n: dense.HashedNgrams(batch=n), "variant", (1, 2))
    assert [r["batch"] for r in table] == [1, 2] and all(r["rows"] == 3 and r["rows_per_second"] > 0 for r in table)


def test_list_of_names_grows(spark, tmp_path):
    path = str(tmp_path / "names")
    pages = spark.createDataFrame([("<h2 class='t'>\n<a href='x'>1 Hoa Sen Group</a></h2><a>Not a heading</a>",), ("<h2><a>abc</a></h2><h2><a>Sao Mai Group</a></h2>",), (None,)], "html string")
    assert [r.name for r in readers.refresh_list(pages.limit(1), path).collect()] == ["Hoa Sen Group"]
    assert [r.name for r in readers.refresh_list(pages, path).collect()] == ["Hoa Sen Group", "Sao Mai Group"]


def test_versions_are_never_overwritten(spark, tmp_path):
    path = str(tmp_path / "t")
    assert storage.current(spark, path) is None
    for n in range(12):
        assert storage.commit_version(spark.range(n), path) == n
    spark.range(3).write.parquet(f"{path}/v=12")  # a writer that isn't done: neither read nor vacuumed
    assert storage.current(spark, path) == 11 and storage.read_current(spark, path).count() == 11
    assert storage.vacuum(spark, path, 0) == list(range(11)) and 12 in storage.versions(spark, path)


@pytest.mark.parametrize("model", ["tfidf", "tfidf-bm25"])
def test_labelled_pairs(spark, model):
    """Strict accuracy of each category on the labelled fixture."""
    from quillon.operators.index import MatchConfig

    index = build_index(spark.createDataFrame(list(enumerate(TARGETS)), "doc_id long, name string"), MatchConfig(model=model))
    asked = spark.createDataFrame([(i, q, t, c) for i, (q, t, c) in enumerate(PAIRS) if t], "query_id long, text string, target string, method string")
    found = pipeline.match(asked.select("query_id", F.col("text").alias("query_text")), index, 5)
    got = {r.method: r for r in evaluate.accuracy_by(evaluate.outcomes(asked, found)).collect()}
    assert {c: r.n for c, r in got.items()} == Counter(c for _, t, c in PAIRS if t)
    assert all(r.strict_top1 <= r.strict_top3 <= r.strict_top5 for r in got.values())
    assert got["capitals"].strict_top1 == got["no_accent"].strict_top1 == got["short_form"].strict_top1 == 1.0
