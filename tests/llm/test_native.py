"""Sharding, mixing and rules against brute force, with odd rows."""

import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import hilbert, mixing, rules


@pytest.mark.parametrize("n,bits", [(1, 3), (2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(spark, n, bits):
    at = [F.expr(f"(id div {(2**bits) ** i}) % {2**bits}") for i in range(n)]
    rows = spark.range((2**bits) ** n).select(F.array(*at).alias("c")).select("c", hilbert.hilbert_index(F.col("c"), n, bits).alias("h")).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(len(rows)))
    assert all(sum(abs(x - y) for x, y in zip(a.c, b.c, strict=True)) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_shards(spark, odd, none):
    carry = {"doc_id": F.col("doc_id"), "crc": F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))}
    out = hilbert.hilbert_shards(odd, ["source", "lang", "n_chars", "doc_id"], 5, carry=carry, ties=["doc_id", "crc"]).collect()
    assert sorted(Counter(r.shard for r in out).values()) == [2, 2, 2, 3, 3]
    for s in range(5):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    order = [r.curve for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    want = sorted(zlib.crc32((r.text or "").encode()) for r in odd.collect())
    assert sorted(r.crc for r in out) == want
    assert hilbert.hilbert_shards(none, ["source", "doc_id"], 5, carry=carry, ties=["doc_id"]).count() == 0


def test_coordinates_follow_the_values(spark):
    df = spark.range(64).select(F.col("id"), F.format_string("http://h%02d", "id").alias("s"))
    at = hilbert.quantise(df, ["id", "s"], 3)
    rows = df.select("id", at["id"].alias("a"), at["s"].alias("b")).orderBy("id").collect()
    assert [r.a for r in rows] == sorted(r.a for r in rows) and [r.b for r in rows] == sorted(r.b for r in rows)
    assert {r.a for r in rows} == {r.b for r in rows} == set(range(8))
    zones = hilbert.zone_map(hilbert.hilbert_shards(df, ["id", "s"], 8, bits=3, carry={"id": F.col("id")}, ties=["id"]), ["id"]).collect()
    assert all(z.n_rows == 8 and z.max_id - z.min_id == 7 for z in zones)  # two equal dimensions: runs are ranges


def repeated(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)})


def test_rules(spark, odd, none):
    out = {(r.doc_id, r.n_words): r for r in rules.op6(odd).collect()}
    for r in odd.collect():
        text = r.text or ""
        words = [w.decode() for w in text.encode().split()]
        got = out[r.doc_id, len(words)]
        lines = [x for x in text.split("\n") if x.encode().strip()]
        assert (got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == (sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated(words))
        assert got.base_failed == (len(words) < 10 or 100 * got.n_repeat_words > 20 * len(words)) and not (got.kept and got.base_failed)
    assert rules.op6(none).count() == 0 and rules.keep_good(none).count() == 0
    kept = rules.keep_good(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {k[0] for k, r in out.items() if r.kept}


def test_order_is_rejection_per_cost():
    assert rules.order([("a", 1.0, 0.1), ("b", 2.0, 0.9), ("c", 1.0, 0.0), ("d", 0.5, 0.0)]) == ["b", "a", "d", "c"]


def test_rules_skip_and_survive_long_texts(spark):
    bad = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    never = {"few_words": rules.RULES["few_words"], "boom": lambda f: F.raise_error(F.concat(F.lit("evaluated "), f["n_upper"].cast("string"))).isNull()}
    known = lambda t, words: rules.verdict(rules.Features(t, words), ["few_words", "boom"], never)
    assert [r.v for r in bad.select(rules.bound(F.col("text"), known).alias("v")).collect()] == ["few_words"] * 2
    with pytest.raises(Exception, match="evaluated"):  # the counter-proof: a row that no rule before it rejects gets there
        spark.createDataFrame([("a " * 12,)], "text string").select(rules.bound(F.col("text"), known)).collect()
    long = spark.createDataFrame([(1, " ".join(f"word{i % 97} is{i}" for i in range(20_000)))], "doc_id long, text string")
    began = time.perf_counter()
    kept = rules.keep_good(long)
    assert kept.count() == 1 and rules.judge(long).where("judged.rejected_by is null").count() == 1
    assert time.perf_counter() - began < 60
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 3  # words; lines, for two rules


def test_owed_features_are_free():
    measured = [("a", 1.0, 0.9), ("b", 2.0, 0.1), ("c", 1.0, 0.2)]
    assert rules.order(measured, ["b", "c"]) == ["c", "b", "a"]
    assert rules.used_by(rules.RULES["long_words"]) == {"word_chars", "n_words"}


def test_mix(spark, odd, none, labels):
    weights = {"high": 0.5, "low": 0.3, "toxic": 0.2}
    out, told = mixing.mix(odd, labels, weights, scale=1.0)
    rows = out.collect()
    assert len(rows) == odd.count() and all(r.rate >= 0 and abs(r.p_high + r.p_low + r.p_toxic - 1) < 1e-9 for r in rows)
    for d in mixing.DOMAINS:
        assert abs(sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) - told["got"][d]) < 1e-3
    assert sum((told["got"][d] - told["goal"][d]) ** 2 for d in told["goal"]) <= sum((told["start"][d] - told["goal"][d]) ** 2 for d in told["goal"])
    again = mixing.resample(odd, labels, weights, scale=1.0)
    assert again.columns == odd.columns
    want = Counter({k: 0 for k in {r.doc_id for r in rows}})
    want.update({k: sum(r.copies for r in rows if r.doc_id == k) for k in want})
    assert Counter(r.doc_id for r in again.collect()) == +want
    even = {"high": 1, "low": 1, "toxic": 1}
    empty, told = mixing.mix(none, labels.limit(0), even, protect="high")
    assert empty.count() == 0 and mixing.resample(none, labels.limit(0), even).count() == 0
    clash = odd.withColumnsRenamed({"score": "rate", "fp": "n_tokens", "word": "row", "label": "cell"})
    assert mixing.resample(clash, labels, weights).columns == clash.columns
    with pytest.raises(ValueError, match="rate"):
        mixing.mix(clash, labels, weights, carry=["doc_id", "rate"])


@pytest.mark.parametrize("weights,least", [((0.5, 0.3, 0.2), 0.0), ((0.05, 0.05, 0.9), 0.0), ((0.02, 0.9, 0.08), 1.0)])
def test_solver_against_plain_projected_gradient(spark, weights, least):
    r = np.random.default_rng(1)
    n, P = r.integers(1, 500, 60), r.dirichlet([4, 1, 0.3], 60)
    low = np.where(np.arange(60) % 3 == 0, least, 0.0)
    cells = spark.createDataFrame([([i], [float(v) for v in P[i]], float(n[i]), float(low[i])) for i in range(60)], "cell array<int>, p array<double>, n double, low double")
    rates, told = mixing.solve(cells, dict(zip(mixing.DOMAINS, weights, strict=True)), 1.0)
    x, A, goal = np.maximum(low, 1.0), P * n[:, None], np.array(weights) * n.sum()
    L = np.linalg.eigvalsh(A.T @ A).max()
    for _ in range(100_000):
        x = np.maximum(low, x - A @ (A.T @ x - goal) / L)
    best = ((A.T @ x - goal) ** 2).sum()
    own = np.zeros(60)
    for row in rates.collect():
        own[row.cell[0]] = row.rate
    assert (own >= low).all() and told["converged"]
    assert ((A.T @ own - goal) ** 2).sum() <= best * 1.001 + (1e-4 * n.sum()) ** 2
    assert np.allclose([told["got"][d] for d in mixing.DOMAINS], A.T @ own, rtol=1e-6)


def test_cells_keep_the_totals(spark):
    r = np.random.default_rng(2)
    P = r.dirichlet([1, 1, 1], 500)
    soft = spark.createDataFrame([(int(i % 9), [float(v) for v in P[i]]) for i in range(500)], "n long, p array<double>").withColumn("cell", mixing.cell(F.col("p"), F.lit(0)))
    cells = mixing.cells_of(soft).collect()
    assert len(cells) <= 500 and np.allclose(sum(np.array(c.p) * c.n for c in cells), (P * (np.arange(500) % 9)[:, None]).sum(0))
