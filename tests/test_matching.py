import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.operators import dense, fusion, ranking, score
from quillon.operators.index import Index, MatchConfig, build_index, model_of
from quillon.plans import pipeline

NAMES = ["Công ty TNHH Hoa Sen", "CTCP Hoa Sen", "Tập đoàn Hòa Phát", "Công ty TNHH XNK ABC", "Công ty TNHH Xuất nhập khẩu ABC", "Nam Sơn Sơn Sơn", ""]


@pytest.fixture(scope="module")
def index(spark):
    return build_index(spark.createDataFrame(list(enumerate(NAMES)), "doc_id long, name string"))


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query_text string")


def grams(s):
    return Counter(s[i : i + n] for n in range(2, 6) for i in range(len(s) - n + 1))


def test_tfidf_equals_a_plain_loop(spark, index):
    docs = {r.doc_id: r.cleaned for r in index.docs.collect()}
    df = Counter(t for d in docs.values() for t in grams(d))
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items()}

    def vector(s):
        w = {t: (1 + math.log(n)) * idf[t] for t, n in grams(s).items() if t in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        return {t: v / norm for t, v in w.items()}

    q = score.clean_queries(queries(spark, "hoa sen jsc", "zzz"), index.config)
    got = {(r.query_id, r.doc_id): r.score for r in score.tfidf(q, index).collect()}
    a = vector("hoa sen cp")
    want = {(0, i): round(sum(v * vector(d).get(t, 0) for t, v in a.items()), 6) for i, d in docs.items() if d and set(a) & set(grams(d))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_groups_are_not_cut(spark, index):
    q = score.clean_queries(queries(spark, "tnhh abc"), index.config)
    rows = ranking.rank(score.tfidf(q, index), q, index, top_k=1).orderBy("rank").collect()
    assert [r.canonical_id for r in rows] == ["3", "4"] and rows[0].score == rows[1].score  # one key, two names, top_k of 1


def test_promotion_and_penalty(spark, index):
    rows = spark.createDataFrame([(0, 1, "cp x", "a", 0.9, 1), (0, 2, "tnhh x", "b", 0.71, 2), (1, 1, "cp x", "a", 0.9, 1), (1, 2, "tnhh x", "b", 0.69, 2)], "query_id long, doc_id long, norm_key string, name string, score double, pos int")
    q = spark.createDataFrame([(0, "tnhh x"), (1, "tnhh x")], "query_id long, cleaned string")
    got = {(r.query_id, r.doc_id): r.pos for r in ranking.promote(rows, q).collect()}
    assert got == {(0, 2): 1, (0, 1): 2, (1, 1): 1, (1, 2): 2}
    again = ranking.penalise(rows.withColumn("norm_key", F.when(F.col("doc_id") == 1, "ab ab").otherwise("x")))
    assert {(r.query_id, r.doc_id): (r.pos, r.score) for r in again.collect()}[(0, 1)] == (1, 0.765)


def test_abstention(spark, index):
    q = score.clean_queries(queries(spark, "hoa sen", "qqqq hoa"), index.config)
    s = score.tfidf(q, index)
    first = {r.query_id: r.score for r in ranking.rank(s, q, index).where("rank = 1").collect()}
    limit = (first[0] + first[1]) / 2
    assert {r.query_id for r in ranking.rank(s, q, index, min_score=limit).collect()} == {0}


def test_models_and_reload(spark, index, tmp_path):
    index.save(str(tmp_path / "i"))
    again = Index.load(spark, str(tmp_path / "i"))
    q = score.clean_queries(queries(spark, "hoa sen"), index.config)
    assert again.config == index.config and again.stats == index.stats
    for f in (score.tfidf, score.bm25, score.hybrid):
        assert sorted(f(q, index).collect()) == sorted(f(q, again).collect())
    assert model_of("tfidf-char-ngram") == "tfidf"
    with pytest.warns(UserWarning):
        assert model_of("nonsense") == "tfidf"


@pytest.mark.parametrize("model,fused", [("tfidf-lsa", ""), ("tfidf-dense", "weighted"), ("tfidf-dense", "rrf"), ("tfidf-dense", "tfidf-rerank"), ("tfidf-dense", "union-rerank"), ("tfidf-dense", "adaptive-rerank"), ("bm25-dense", ""), ("hybrid-cross-lang", "")])
def test_every_model_searches(spark, model, fused, tmp_path):
    names = spark.createDataFrame([(0, "Công ty TNHH Hoa Sen"), (1, "CTCP Hòa Phát"), (2, "Tập đoàn Vingroup"), (3, "Ngân hàng Á Châu")], "doc_id long, name string")
    index = build_index(names, MatchConfig(model=model, fusion=fused, lsa_dims=3))
    if model == "tfidf-lsa":
        index.latent = dense.latent(index)
        index.save(str(tmp_path / "i"))
        index = Index.load(spark, str(tmp_path / "i"))
    rows = pipeline.match(queries(spark, "tnhh hoa sen", "ctcp hoa phat"), index).where("rank = 1").collect()
    assert {r.query_id: r.canonical_id for r in rows} == {0: "0", 1: "1"}


def test_lexical_scores_refuse_other_models(spark, index):
    with pytest.raises(ValueError, match="lsa"):
        score.sparse(queries(spark, "a"), build_index(spark.createDataFrame([(0, "a b")], "doc_id long, name string"), MatchConfig(model="lsa")))


def test_empty_inputs(spark):
    empty = build_index(spark.createDataFrame([], "doc_id long, name string"), MatchConfig(model="hybrid"))
    q = score.clean_queries(queries(spark, "a b", None), empty.config)
    assert ranking.rank(score.sparse(q, empty), q, empty).count() == 0


def test_rrf_ranks_missing_documents(spark):
    docs = spark.range(4).withColumnRenamed("id", "doc_id")
    q = spark.createDataFrame([(0,)], "query_id long")
    s = spark.createDataFrame([(0, 3, 0.5)], "query_id long, doc_id long, score double")
    got = {r.doc_id: r.score for r in fusion.rrf([s], docs, q).collect()}
    assert got == {3: round(1 / 61, 9), 0: round(1 / 62, 9), 1: round(1 / 63, 9), 2: round(1 / 64, 9)}


def test_fuzzy_scores_names_without_a_common_token(spark):
    from quillon.operators import fuzzy

    names = spark.createDataFrame([(1, "Vinamilk"), (2, "Hòa Phát"), (3, "Xyz")], "doc_id long, name string")
    asked = spark.createDataFrame([(1, "vinamlik"), (2, "hoa phat")], "query_id long, query_text string")
    got = {r.query_id: (r.doc_id, r.score) for r in fuzzy.match(asked, names, 1).collect()}
    assert got == {1: (1, 0.88), 2: (2, 1.0)}


@pytest.mark.parametrize("exact", [4096, 0])
def test_latent_vectors_equal_a_plain_decomposition(spark, exact, monkeypatch):
    import numpy as np

    monkeypatch.setattr(dense, "EXACT", exact)
    words = ["sen", "hoa", "vang", "bac", "nam", "song", "dong", "minh", "xanh", "long"]
    names = spark.createDataFrame([(i, f"{words[i % 10]} {words[i // 10 % 10]} {words[i * 7 // 3 % 10]}") for i in range(100)], "doc_id long, name string")
    index = build_index(names, MatchConfig(model="lsa", lsa_dims=6))
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    docs, terms = dense.latent(index)
    got = {r.doc_id: np.array(r.vector) for r in docs.collect()}
    assert len(tracker.getJobIdsForGroup()) - before < (30 if exact else 150)
    cols = {r.term: (r.col, r.idf) for r in terms.collect()}
    a = np.zeros((100, len(cols)))
    for r in index.grams.collect():
        a[r.doc_id, cols[r.term][0]] = (1 + np.log(r.tf)) * cols[r.term][1]
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    x = a @ np.linalg.svd(a, full_matrices=False)[2][:6].T
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = np.array([got[i] for i in range(100)])
    assert g.shape == (100, 6) and np.abs(g @ g.T - x @ x.T).max() < (1e-9 if exact else 1e-3)
