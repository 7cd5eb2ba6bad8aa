import pytest
from pyspark.sql import functions as F

from quillon.operators import dedup, evaluate, quality, variants
from quillon.plans import pipeline
from quillon.plans.config import PipelineConfig, load_config, remote_from_env, save_config
from quillon.sources import readers, storage


def test_dedup(spark):
    rows = spark.createDataFrame([(2, "A x", "a x", "k"), (1, "A", "a", "k"), (3, "B", "b", "m")], "id long, company_name string, cleaned_name string, norm_key string")
    assert {r.id for r in dedup.canonical(rows, "first").collect()} == {1, 3}
    assert {r.id for r in dedup.canonical(rows, "longest").collect()} == {2, 3}
    out = {r.norm_key: r for r in dedup.flagged(rows).collect()}
    assert (out["k"].canonical_id, out["k"].is_duplicate, out["k"].original_names) == (0, True, ["A", "A x"]) and (out["m"].canonical_id, out["m"].is_duplicate) == (1, False)
    none = dedup.duplicate_totals(dedup.group_sizes(rows.where("id = 3"))).first()
    assert tuple(none) == (0, 0, 0)
    with pytest.raises(ValueError):
        dedup.canonical(rows, "other")


def test_validation(spark):
    names = [None, "", "  ", "ab", " abc ", "x" * 200, "x" * 201, "***", "đ!"]
    rows = spark.createDataFrame([(n,) for n in names], "company_name string")
    valid, stats = quality.validate_names(rows)
    assert {r[0] for r in valid.collect()} == {"abc", "x" * 200}
    s = stats.first().asDict()
    assert (s["n_null"], s["n_empty"], s["n_too_short"], s["n_too_long"], s["n_special_only"], s["many_invalid"]) == (1, 2, 2, 1, 1, True)
    assert quality.validate_names(rows.limit(0))[1].first()["many_invalid"] is False


def test_metrics_of_nothing(spark):
    m = quality.quality_metrics(spark.createDataFrame([], "score double"))
    assert m.first()["total"] == 0 and m.first()["high_rate"] == 0.0
    assert [r.metric for r in quality.quality_alerts(m).collect()] == ["high_rate"]


def test_partition_balance_counts_empty_ones(spark):
    b = quality.partition_balance(spark.range(1).repartition(4)).first()
    assert (b.partitions, b.min_rows, b.max_rows, b.skewed) == (4, 0, 1, True)


def test_variants(spark):
    rows = spark.createDataFrame([("Công ty TNHH ABC",), ("ABC",)], "name string")
    got = {r.name: r.v for r in rows.select("name", variants.combinatorial(F.col("name")).alias("v")).collect()}
    assert "co.,ltd abc" in got["Công ty TNHH ABC"] and "TNHH ABC" in got["Công ty TNHH ABC"] and "công ty tnhh abc" not in got["Công ty TNHH ABC"]
    assert got["ABC"] == ["ABC"]
    made = {r.name: r.v for r in rows.select("name", variants.company_variants(F.col("name")).alias("v")).collect()}
    assert len(made["ABC"]) == 3 and all("ABC" in v for v in made["ABC"]) and all("TNHH" not in v for v in made["Công ty TNHH ABC"])
    bad = spark.createDataFrame([("not json",), ('[{"original":"A","variations":[{"text":"a","type":"typo"}]}]',)], "reply string")
    assert [tuple(r) for r in variants.parse_replies(bad).collect()] == [("A", "a", "typo")]
    writer = variants.VariantWriter(lambda p: (_ for _ in ()).throw(OSError()), delay=0)
    assert writer.reply(["x"]) is None


def test_evaluation(spark):
    q = spark.createDataFrame([(1, "a", "A", "m"), (2, "b", "B", "m"), (3, "c", "C", "m")], "query_id long, text string, target string, method string")
    r = spark.createDataFrame([(1, "X", 0.9, 1), (1, "A", 0.9, 2), (2, "X", 0.8, 1), (2, "B", 0.5, 2)], "query_id long, matched_company string, score double, rank int")
    o = evaluate.outcomes(q, r)
    a = evaluate.accuracy(o).first()
    assert (a.top1, a.top3, a.strict_top1, a.coverage, a.precision) == (0.333333, 0.666667, 0.0, 0.666667, 0.5)
    s = {t.threshold: t for t in evaluate.sweep(o).collect()}
    assert len(s) == 51 and (s[0.0].answered, s[0.82].answered, s[0.82].correct, s[0.92].answered) == (3, 1, 1, 0)
    assert evaluate.recommended(evaluate.sweep(o)).first().at_95 == 0.82


def test_storage(spark, tmp_path):
    path = str(tmp_path / "t")
    assert storage.commit_version(spark.range(10).repartition(4), path) == 0
    assert storage.compact(spark, path) == 1
    assert storage.read_current(spark, path).count() == 10 and readers.read_table(spark, path, version=0).count() == 10
    assert storage.vacuum(spark, path) == [] and storage.vacuum(spark, path, 0) == [0]
    a = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string")
    b = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "k long, v string")
    assert sorted(map(tuple, storage.upsert(a, b, ["k"], ["v"]).collect()), key=repr) == sorted([(1, "a"), (2, "B"), (3, "C"), (None, "n"), (None, "N")], key=repr)
    assert sorted(map(tuple, storage.upsert(a, b, ["k"]).collect()), key=repr) == sorted([(1, "a"), (2, "b"), (3, "C"), (None, "n"), (None, "N")], key=repr)


def test_text_sources(spark, tmp_path):
    (tmp_path / "names.txt").write_text("b\n\n a \nc\n")
    path = str(tmp_path / "names.txt")
    assert [r.name for r in readers.text_lines(spark, path).collect()] == ["b", "a", "c"]
    assert [tuple(r) for r in readers.text_lines_with_ids(spark, path).orderBy("id").collect()] == [(0, "b"), (2, "a"), (3, "c")]
    storage.write_sorted_text(readers.text_lines(spark, path), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a", "b", "c"]
    assert readers.upsample(readers.text_lines(spark, path), 7, "name").count() == 7


def test_config(tmp_path):
    path = str(tmp_path / "c.yaml")
    save_config(PipelineConfig(token="s", top_k=7), path)
    assert "token" not in open(path).read()
    c = load_config(path, env={"QUILLON_MIN_SCORE": "0.5", "QUILLON_REMOVE_STOPWORDS": "no"})
    assert (c.top_k, c.min_score, c.remove_stopwords, c.token) == (7, 0.5, False, None)
    assert remote_from_env({}) is None and remote_from_env({"QUILLON_CONNECT_HOST": "h", "QUILLON_CONNECT_TOKEN": "t"}) == "sc://h:15002/;token=t"


def test_pipeline(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    names = [(0, "Công ty TNHH Hoa Sen"), (1, "CÔNG TY TNHH HOA SEN"), (2, "CTCP Hòa Phát"), (3, None), (4, "**")]
    spark.createDataFrame(names, "id long, company_name string").write.parquet(p("b"))
    config = PipelineConfig(bronze_path=p("b"), silver_path=p("s"), gold_path=p("g"), index_path=p("i"), metrics_path=p("m"), num_partitions=2)
    queries = spark.createDataFrame([(7, "hoa sen tnhh"), (8, None)], "query_id int, query_text string")
    out = pipeline.Pipeline(spark, config).run(queries)
    assert out["status"] == "success"
    rows = out["matches"].where("query_id = 7 and rank = 1").collect()
    assert rows[0].query_text == "hoa sen tnhh" and rows[0].canonical_id is not None and "oa" in rows[0].matched_company.lower()
    again = pipeline.Pipeline(spark, config).run(queries, skip=(1, 2, 3))
    assert again["metrics"] == out["metrics"]
    with pytest.raises(ValueError):
        pipeline.match(spark.range(1), None)
