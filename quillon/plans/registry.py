"""The engine's operators as queries over the driver's tables, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import textnorm as T
from ..operators import dedup, dense, evaluate, fusion, fuzzy, quality, ranking, score, search, variants, wordvec
from ..operators.index import MatchConfig, build_index
from ..sources import readers, storage
from ..streaming import matching as streaming
from . import sqlgen as S

_queries: dict = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _queries[f.__name__] = f
        if sql is not None:
            _oracles[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def raw_names(spark: SparkSession, d: str) -> DataFrame:
    """(id, company_name): a synthetic Vietnamese company name for every part."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(S.NAME).alias("company_name"))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return dedup.with_ids(raw_names(spark, d).select(F.col("company_name").alias("name")).distinct(), "name", "doc_id").select("doc_id", "name")


def name_queries(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select("p_name").distinct()
    return dedup.with_ids(names, "p_name", "query_id").select("query_id", F.concat(F.lit("JSC "), F.upper("p_name"), F.lit(" small")).alias("query_text"))


# --- names -------------------------------------------------------------------------------------------------------


@query(f"SELECT p_partkey AS id, {S.clean(S.NAME)} AS cleaned FROM part")
def clean_names(spark, d):
    return raw_names(spark, d).select("id", T.clean_name(F.col("company_name")).alias("cleaned"))


@query(f"SELECT p_partkey AS id, {S.clean(S.NAME, False)} AS cleaned FROM part")
def clean_names_keep_stopwords(spark, d):
    return raw_names(spark, d).select("id", T.clean_name(F.col("company_name"), False).alias("cleaned"))


@query(f"SELECT p_partkey AS id, {S.decoded(S.entity(S.lowered(S.NAME)))} AS entity, {S.decoded(S.functional(S.entity(S.lowered(S.NAME))))} AS functional FROM part")
def canonical_terms(spark, d):
    rows = raw_names(spark, d).withColumn("entity", T.normalize_entity_types(T.normalize_text(F.col("company_name"))))
    return rows.select("id", "entity", T.normalize_functional_terms(F.col("entity")).alias("functional"))


@query(f"SELECT p_partkey AS id, {S.clean(S.NAME)} AS cleaned, {S.clean(S.NAME)} AS no_accent, {S.pipeline_key(S.NAME)} AS norm_key FROM part")
def preprocess_struct(spark, d):
    return raw_names(spark, d).select("id", T.preprocess(F.col("company_name")).alias("p")).select("id", "p.*")


@query(f"SELECT doc_id, {S.accents('text')} AS plain FROM documents")
def strip_accents(spark, d):
    return table(spark, d, "documents").select("doc_id", T.strip_accents(F.col("text")).alias("plain"))


@query(f"SELECT doc_id, regexp_replace(lower(nfc_normalize(coalesce(text, ''))), '^\\s+|\\s+$', '', 'g') AS normal FROM documents")
def normalize_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("normal"))


@query(f"SELECT doc_id, name, cleaned, {S.entity_type('cleaned')} AS kind, {S.has_repeats('cleaned')} AS repeats FROM (SELECT doc_id, name, {S.clean('name')} AS cleaned FROM ({'WITH ' + S.NAMES + ' SELECT * FROM names'}))")
def name_types(spark, d):
    rows = corpus(spark, d).withColumn("cleaned", T.clean_name(F.col("name")))
    return rows.select("doc_id", "name", "cleaned", T.entity_type(F.col("cleaned")).alias("kind"), T.has_repeats(F.col("cleaned")).alias("repeats"))


@query("SELECT p_partkey AS id, CASE WHEN c LIKE 'cong ty%' THEN 'company' WHEN c LIKE 'tap doan%' THEN 'conglomerate' WHEN c LIKE 'ngan hang%' THEN 'bank' ELSE 'other' END AS category FROM (SELECT p_partkey, " + S.accents(f"lower({S.NAME})") + " AS c FROM part)")
def name_categories(spark, d):
    return raw_names(spark, d).select("id", T.category(T.strip_accents(F.lower("company_name"))).alias("category"))


@query(f"WITH {S.NAMES}, {S.DOCS}, dg AS ({S._grams('docs', 'doc_id')}), nd AS (SELECT count(*) AS n FROM docs) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf, round(ln((1 + n) / (1.0 + count(*))) + 1, 6) AS idf FROM dg, nd GROUP BY term, n")
def ngram_statistics(spark, d):
    index = build_index(corpus(spark, d))
    counts = index.grams.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))
    return counts.join(index.gram_idf, "term").select("term", "df", "tf", F.round("idf", 6).alias("idf"))


@query(f"WITH {S.NAMES}, {S.DOCS} SELECT doc_id, unnest(list_distinct([cleaned])) AS variant FROM docs WHERE cleaned <> ''")
def index_variants(spark, d):
    rows = corpus(spark, d).select("doc_id", T.clean_name(F.col("name")).alias("cleaned"))
    return rows.select("doc_id", F.explode(T.dual_variants(F.col("cleaned"))).alias("variant"))


@query("""WITH c AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS t FROM conversations)
SELECT a.conv_id, a.turn, CASE WHEN len(list_distinct(list_concat(a.t, b.t))) = 0 THEN 0.0 ELSE round(len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(list_concat(a.t, b.t))) AS DOUBLE), 6) END AS overlap
FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def token_overlap(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.token_jaccard(F.col("text"), F.col("next")), 6).alias("overlap"))


@query()
def char_similarity(spark, d):
    rows = table(spark, d, "part").select("p_name", "p_type").distinct()
    return rows.select("p_name", "p_type", F.round(T.char_ratio(F.lower("p_name"), F.lower("p_type")), 6).alias("ratio"))


# --- matching ----------------------------------------------------------------------------------------------------


def _match(spark, d, model, top_k=5, min_score=0.0):
    index = build_index(corpus(spark, d), MatchConfig(model=model))
    cleaned = score.clean_queries(name_queries(spark, d), index.config)
    return ranking.rank(search.scores(cleaned, index, top_k), cleaned, index, top_k, min_score)


@query(S.match_sql("tfidf"))
def match_tfidf(spark, d):
    return _match(spark, d, "tfidf")


@query(S.match_sql("bm25"))
def match_bm25(spark, d):
    return _match(spark, d, "bm25")


@query(S.match_sql("hybrid", 3, 0.6))
def match_hybrid(spark, d):
    return _match(spark, d, "tfidf-bm25", 3, 0.6)


@query("WITH " + ", ".join([S.NAMES, S.QUERIES, S.DOCS, S.CLEAN_QUERIES]) + ", hits AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rn FROM qs JOIN docs ON contains(docs.cleaned, string_split(qs.cleaned, ' ')[1]) WHERE qs.cleaned <> '') SELECT query_id, doc_id, CAST(1.0 AS DOUBLE) AS score FROM hits WHERE rn <= 3")
def match_substring(spark, d):
    docs = corpus(spark, d).select("doc_id", T.clean_name(F.col("name")).alias("cleaned"))
    return score.substring(score.clean_queries(name_queries(spark, d), MatchConfig()), docs)


_BUCKET = "CAST(('0x' || substr(md5(token), 1, 7)) AS BIGINT) % 10000"


def _buckets(table: str, key: str) -> str:
    return f"SELECT {key}, {_BUCKET} AS bucket, sum(tf) AS tf FROM ({S._tokens(table, key)}) GROUP BY ALL"


@query(f"""WITH {", ".join([S.NAMES, S.QUERIES, S.DOCS, S.CLEAN_QUERIES])}, d AS ({_buckets("docs", "doc_id")}), q AS ({_buckets("qs", "query_id")}),
idf AS (SELECT bucket, ln(((SELECT count(*) FROM docs) + 1) / (count(*) + 1.0)) AS idf FROM d GROUP BY bucket),
dw AS (SELECT doc_id, bucket, tf * idf AS w FROM d JOIN idf USING (bucket)), qw AS (SELECT query_id, bucket, tf * idf AS w FROM q JOIN idf USING (bucket)),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS b FROM dw GROUP BY doc_id), qn AS (SELECT query_id, sqrt(sum(w * w)) AS a FROM qw GROUP BY query_id),
s AS (SELECT query_id, doc_id, round(dot / (a * b), 6) AS score FROM (SELECT query_id, doc_id, sum(qw.w * dw.w) AS dot FROM qw JOIN dw USING (bucket) GROUP BY ALL) JOIN qn USING (query_id) JOIN dn USING (doc_id) WHERE dot > 0)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0 QUALIFY rank <= 5""")
def match_hashed_words(spark, d):
    docs = corpus(spark, d).select("doc_id", T.clean_name(F.col("name")).alias("cleaned"))
    return wordvec.topk(score.clean_queries(name_queries(spark, d), MatchConfig()), docs)


@query()
def match_fuzzy(spark, d):
    return fuzzy.match(name_queries(spark, d), corpus(spark, d))


@query()
def match_with_fallback(spark, d):
    names, queries = corpus(spark, d), name_queries(spark, d)
    return fuzzy.with_fallback(_match(spark, d, "tfidf"), fuzzy.match(queries, names), names, queries, below=0.8, least=0.5)


@query()
def match_lsa(spark, d):
    return _match(spark, d, "tfidf-lsa")


@query()
def match_dense_hashed(spark, d):
    """Weighted TF-IDF and dense scores of the stand-in encoder, over all names that either side can rank."""
    index = build_index(corpus(spark, d), MatchConfig(model="tfidf-dense", fusion="weighted"))
    cleaned = score.clean_queries(name_queries(spark, d), index.config)
    return ranking.rank(search.scores(cleaned, index), cleaned, index)


@query()
def match_bm25_dense(spark, d):
    return _match(spark, d, "bm25-dense")


@query()
def match_gap_rerank(spark, d):
    """TF-IDF unless its first two results are close; then the best by the names' vectors."""
    return _match(spark, d, "hybrid-cross-lang")


_JACCARD = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1})) / CAST(len(list_distinct(list_concat({0}, {1}))) AS DOUBLE) END"


def _token_set(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda w: w <> ''))"


_CROSS = f"""cross10 AS MATERIALIZED (SELECT query_id, doc_id, round(1 / (1 + exp(-(6 * ({_JACCARD.format('a', 'b')}) - 3))), 6) AS score
FROM (SELECT query_id, doc_id, {_token_set('qs.cleaned')} AS a, {_token_set('docs.cleaned')} AS b FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM tfidf) JOIN qs USING (query_id) JOIN docs USING (doc_id) WHERE r <= 10))"""


@query("WITH " + ", ".join([S.NAMES, S.QUERIES, S.DOCS, S.CLEAN_QUERIES, S.TFIDF, _CROSS, S.ranked("cross10")]) + " " + S.RESULT)
def match_cross_rerank(spark, d):
    index = build_index(corpus(spark, d))
    cleaned = score.clean_queries(name_queries(spark, d), index.config)
    scorer = lambda q, n: 6 * T.token_jaccard(T.clean_name(q), T.clean_name(n)) - 3
    return ranking.rank(fusion.cross_rerank(score.tfidf(cleaned, index), cleaned, index.docs, 10, scorer), cleaned, index)


@query(f"""WITH found AS (SELECT *, {S.clean('query_text')} AS q, {S.clean('matched_company')} AS m FROM ({S.match_sql("tfidf")})),
gained AS (SELECT *, round(least(1.0, score * CASE WHEN q = m THEN 1.2 WHEN q <> '' AND starts_with(m, q) THEN 1.1 ELSE 1.0 END), 6) AS s FROM found)
SELECT query_id, query_text, matched_company, canonical_id, s AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS INTEGER) AS rank, match_confidence FROM gained""")
def match_boosted(spark, d):
    return ranking.boost(_match(spark, d, "tfidf"))


# --- dense side and fusion: embeddings; queries are the first vector of each label, the lexical side is made of ids ----

_EMB = """docs AS (SELECT vec_id AS doc_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings),
qs AS (SELECT doc_id AS query_id, v, label FROM docs WHERE doc_id IN (SELECT min(doc_id) FROM docs GROUP BY label)),
dense AS MATERIALIZED (SELECT query_id, doc_id, round(list_cosine_similarity(qs.v, docs.v), 6) AS score FROM qs, docs),
lex AS MATERIALIZED (SELECT query_id, doc_id, round(1.0 / (1 + abs(query_id - doc_id) / 7.0), 6) AS score FROM qs JOIN docs USING (label))"""
_TOP = "SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {0}) WHERE rank <= 10"


def _vectors(spark, d):
    docs = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    first = docs.groupBy("label").agg(F.min("doc_id").alias("doc_id"))
    queries = docs.join(first, ["label", "doc_id"]).select(F.col("doc_id").alias("query_id"), "vector", "label")
    pairs = queries.select("query_id", "label").join(docs.select("doc_id", "label"), "label")
    lexical = pairs.select("query_id", "doc_id", F.round(1.0 / (1 + F.abs(F.col("query_id") - F.col("doc_id")) / 7.0), 6).alias("score"))
    return queries, docs, lexical


def _ranked(scores):
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.select("query_id", "doc_id", "score", F.row_number().over(w).cast("int").alias("rank")).where(F.col("rank") <= 10)


def _all_dense(queries, docs):
    """Every query against every vector (ranks over all documents are what the strategy is about)."""
    return dense.topk(queries, docs, docs.count()).drop("rank")


@query(f"WITH {_EMB} {_TOP.format('dense')}")
def dense_topk(spark, d):
    queries, docs, _ = _vectors(spark, d)
    return dense.topk(queries, docs, 10).withColumn("rank", F.col("rank").cast("int"))


@query(f"WITH {_EMB}, f AS (SELECT query_id, doc_id, round(0.5 * coalesce(l.score, 0) + 0.5 * coalesce(least(greatest(d.score, 0), 1), 0), 6) AS score FROM lex l FULL JOIN dense d USING (query_id, doc_id)) {_TOP.format('f')}")
def fusion_weighted(spark, d):
    queries, docs, lexical = _vectors(spark, d)
    return _ranked(fusion.weighted(lexical, _all_dense(queries, docs)))


@query(f"""WITH {_EMB}, ev AS (SELECT query_id, doc_id FROM qs, docs),
a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, doc_id) AS r FROM ev LEFT JOIN lex USING (query_id, doc_id)),
b AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, doc_id) AS r FROM ev LEFT JOIN dense USING (query_id, doc_id)),
f AS (SELECT query_id, doc_id, round(1.0 / CAST(60 + a.r AS DOUBLE) + 1.0 / CAST(60 + b.r AS DOUBLE), 9) AS score FROM a JOIN b USING (query_id, doc_id)) {_TOP.format('f')}""")
def fusion_rrf(spark, d):
    queries, docs, lexical = _vectors(spark, d)
    return _ranked(fusion.rrf([lexical, _all_dense(queries, docs)], docs, queries))


_T5 = "SELECT query_id, doc_id FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM {0}) WHERE r <= 5"


@query(f"WITH {_EMB}, f AS (SELECT * FROM dense SEMI JOIN ({_T5.format('lex')}) USING (query_id, doc_id)) {_TOP.format('f')}")
def fusion_rerank(spark, d):
    queries, docs, lexical = _vectors(spark, d)
    return _ranked(dense.pair_scores(fusion.top(lexical, 5).select("query_id", "doc_id"), queries, docs))


@query(f"WITH {_EMB}, f AS (SELECT * FROM dense SEMI JOIN ({_T5.format('lex')} UNION {_T5.format('dense')}) USING (query_id, doc_id)) {_TOP.format('f')}")
def fusion_union_rerank(spark, d):
    queries, docs, lexical = _vectors(spark, d)
    return _ranked(fusion.union_rerank(lexical, _all_dense(queries, docs), 5))


@query(f"""WITH {_EMB}, two AS (SELECT query_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM lex),
st AS (SELECT query_id, round(max(score) - (CASE WHEN count(*) > 1 THEN min(score) ELSE 0 END), 9) < 0.3 AS open FROM two WHERE r <= 2 GROUP BY query_id),
f AS (SELECT l.* FROM lex l JOIN st USING (query_id) WHERE NOT open UNION ALL SELECT dn.* FROM dense dn JOIN st USING (query_id) SEMI JOIN ({_T5.format('lex')}) USING (query_id, doc_id) WHERE open) {_TOP.format('(SELECT query_id, doc_id, score FROM f)')}""".replace("SELECT l.* FROM lex l", "SELECT l.query_id, l.doc_id, l.score FROM lex l").replace("SELECT dn.* FROM dense dn", "SELECT dn.query_id, dn.doc_id, dn.score FROM dense dn"))
def fusion_adaptive(spark, d):
    queries, docs, lexical = _vectors(spark, d)
    return _ranked(fusion.adaptive(lexical, _all_dense(queries, docs), 5, 0.3))


@query("SELECT vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform((SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1), lambda x: CAST(x AS DOUBLE))), 6) AS cosine FROM embeddings")
def cosine_to_first(spark, d):
    e = table(spark, d, "embeddings")
    first = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("f"))
    return e.join(F.broadcast(first)).select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("f")), 6).alias("cosine"))


# --- deduplication -----------------------------------------------------------------------------------------------

_SILVER = f"silver AS MATERIALIZED (SELECT p_partkey AS id, {S.NAME} AS company_name, {S.clean(S.NAME)} AS cleaned_name, {S.pipeline_key(S.NAME)} AS norm_key FROM part)"


def _silver(spark, d):
    rows = raw_names(spark, d).withColumn("cleaned_name", T.clean_name(F.col("company_name")))
    return rows.withColumn("norm_key", T.pipeline_key(F.col("company_name")))


@query(f"WITH {_SILVER} SELECT id, company_name, cleaned_name, norm_key FROM (SELECT *, row_number() OVER (PARTITION BY norm_key ORDER BY id) AS r FROM silver) WHERE r = 1")
def dedup_first(spark, d):
    return dedup.canonical(_silver(spark, d), "first")


@query(f"WITH {_SILVER} SELECT id, company_name, cleaned_name, norm_key FROM (SELECT *, row_number() OVER (PARTITION BY norm_key ORDER BY length(cleaned_name) DESC, id) AS r FROM silver) WHERE r = 1")
def dedup_longest(spark, d):
    return dedup.canonical(_silver(spark, d), "longest")


@query(f"WITH {_SILVER} SELECT norm_key, count(*) AS duplicate_group_size, CAST(hash_n AS BIGINT) AS n_names FROM (SELECT *, count(*) OVER (PARTITION BY norm_key) AS hash_n FROM silver) GROUP BY norm_key, hash_n")
def dedup_groups(spark, d):
    g = dedup.group_stats(_silver(spark, d))
    return g.select("norm_key", "duplicate_group_size", F.size("original_names").cast("long").alias("n_names"))


@query(f"WITH {_SILVER}, g AS (SELECT count(*) AS n FROM silver GROUP BY norm_key HAVING count(*) > 1) SELECT count(*) AS n_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows, CAST(coalesce(sum(n), 0) - count(*) AS BIGINT) AS n_dropped FROM g")
def dedup_totals(spark, d):
    return dedup.duplicate_totals(dedup.group_sizes(_silver(spark, d)))


@query(f"""WITH {_SILVER}, b AS (SELECT *, row_number() OVER (PARTITION BY norm_key ORDER BY id) AS r, count(*) OVER (PARTITION BY norm_key) AS n FROM silver)
SELECT id, company_name, norm_key, n AS duplicate_group_size, n > 1 AS is_duplicate, CAST(row_number() OVER (ORDER BY norm_key) - 1 AS BIGINT) AS canonical_id FROM b WHERE r = 1""")
def dedup_flagged(spark, d):
    return dedup.flagged(_silver(spark, d)).select("id", "company_name", "norm_key", "duplicate_group_size", "is_duplicate", "canonical_id")


@query("SELECT md5(coalesce(text, '')) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def document_copies(spark, d):
    return table(spark, d, "documents").groupBy(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


# --- validation and quality --------------------------------------------------------------------------------------

_WHY = "CASE WHEN text IS NULL THEN 'null' WHEN trim(text) = '' THEN 'empty' WHEN length(trim(text)) < 3 THEN 'too_short' WHEN length(trim(text)) > 200 THEN 'too_long' WHEN NOT regexp_matches(trim(text), '[a-zA-Z0-9À-ÿĂăĐđẠ-ỹ]') THEN 'special_only' END"


@query(f"SELECT count(*) AS n_total, " + ", ".join(f"count(*) FILTER (w = '{r}') AS n_{r}" for r in quality.REASONS) + f", count(*) - count(w) AS n_valid, count(w) * 1.0 / count(*) > 0.10 AS many_invalid FROM (SELECT {_WHY} AS w FROM documents)")
def validation_stats(spark, d):
    return quality.validate_names(table(spark, d, "documents"), "text")[1]


@query(f"SELECT doc_id, trim(text) AS text FROM documents WHERE ({_WHY}) IS NULL")
def validated_names(spark, d):
    return quality.validate_names(table(spark, d, "documents").select("doc_id", "text"), "text")[0]


_SCORES = "(SELECT l_orderkey, l_linenumber, round(l_extendedprice / (50.0 * 2100), 6) AS score FROM lineitem)"


def _scores(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / (50.0 * 2100), 6).alias("score"))


@query(f"SELECT count(*) AS n_total, count(*) FILTER (score IS NULL) AS n_null, count(*) FILTER (score < 0 OR score > 1) AS n_out_of_range, count(*) FILTER (score = 0) AS n_zero, count(*) FILTER (score >= 0 AND score <= 1) AS n_valid FROM {_SCORES}")
def score_validation(spark, d):
    return quality.validate_scores(_scores(spark, d))[1]


_METRICS = f"""SELECT count(*) AS total, round(avg(score), 6) AS avg_score, round(stddev_samp(score), 6) AS std_score, min(score) AS min_score, max(score) AS max_score, count(*) FILTER (score >= 0.9) AS n_high, count(*) FILTER (score >= 0.75 AND score < 0.9) AS n_medium, count(*) FILTER (score < 0.75) AS n_low,
round(count(*) FILTER (score >= 0.9) / CAST(count(*) AS DOUBLE), 6) AS high_rate, round(count(*) FILTER (score >= 0.75 AND score < 0.9) / CAST(count(*) AS DOUBLE), 6) AS medium_rate, round(count(*) FILTER (score < 0.75) / CAST(count(*) AS DOUBLE), 6) AS low_rate FROM {_SCORES}"""


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(_METRICS)
def quality_metrics(spark, d):
    return _rounded(quality.quality_metrics(_scores(spark, d)))


@query(f"WITH m AS ({_METRICS}) SELECT 'avg_score' AS metric, avg_score AS value, CAST(0.85 AS DOUBLE) AS threshold FROM m WHERE avg_score < 0.85 UNION ALL SELECT 'high_rate', high_rate, CAST(0.9 AS DOUBLE) FROM m WHERE high_rate < 0.9")
def quality_alerts(spark, d):
    return _rounded(quality.quality_alerts(quality.quality_metrics(_scores(spark, d))))


@query(f"SELECT CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.75 THEN 'medium' ELSE 'low' END AS match_confidence, count(*) AS n FROM {_SCORES} GROUP BY 1")
def confidence_distribution(spark, d):
    return _scores(spark, d).groupBy(T.confidence(F.col("score")).alias("match_confidence")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n_keys, min(n) AS min_rows, max(n) AS max_rows, round(avg(n), 6) AS avg_rows, max(n) > 3 * avg(n) AS skewed FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def key_balance(spark, d):
    return _rounded(quality.key_balance(table(spark, d, "orders"), "o_custkey"))


@query()
def partition_balance(spark, d):
    return quality.partition_balance(table(spark, d, "orders").repartition(8, "o_custkey"))


# --- generation --------------------------------------------------------------------------------------------------


@query()
def variants_combinatorial(spark, d):
    return corpus(spark, d).select("doc_id", F.explode(variants.combinatorial(F.col("name"))).alias("variant"))


@query()
def variants_substituted(spark, d):
    return corpus(spark, d).select("doc_id", F.explode(variants.company_variants(F.col("name"))).alias("variant"))


@query()
def corpus_augmented(spark, d):
    return variants.augment(corpus(spark, d).select("name"))


@query(f"SELECT 'CORP_' || CASE WHEN doc_id < 10000 THEN lpad(CAST(doc_id AS VARCHAR), 4, '0') ELSE CAST(doc_id AS VARCHAR) END AS id, name FROM (WITH {S.NAMES} SELECT * FROM names)")
def eval_corpus(spark, d):
    return variants.eval_corpus(corpus(spark, d))


@query()
def eval_queries(spark, d):
    return variants.eval_queries(variants.eval_corpus(corpus(spark, d)))


@query("SELECT p_partkey AS id, p_name AS original, unnest([lower(p_name), upper(p_name)]) AS text, unnest(['informal', 'no_accent']) AS type FROM part")
def llm_replies(spark, d):
    reply = F.to_json(F.array(F.struct(F.col("p_name").alias("original"), F.array(F.struct(F.lower("p_name").alias("text"), F.lit("informal").alias("type")), F.struct(F.upper("p_name").alias("text"), F.lit("no_accent").alias("type"))).alias("variations"))))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("```json\n"), reply, F.lit("\n```")).alias("reply"))
    return variants.parse_replies(rows, carry=("id",))


# --- evaluation: orders are the queries, their lines the ranked results ----------------------------------------------

_RES = """q AS (SELECT o_orderkey AS query_id, o_orderpriority AS text, 'name ' || (o_custkey % 7) AS target, o_orderstatus AS method FROM orders),
r AS (SELECT l_orderkey AS query_id, 'name ' || (l_partkey % 7) AS matched_company, round(1.0 - l_linenumber / 10.0 - l_tax, 6) AS score, l_linenumber AS rank FROM lineitem),
lead AS (SELECT query_id, max(CASE WHEN rank = 1 THEN score END) AS lead, max(CASE WHEN rank = 1 THEN matched_company END) AS first FROM r GROUP BY query_id),
o AS (SELECT q.query_id, q.text, q.target, q.method, coalesce(bool_or(matched_company = target AND score = lead), false) AS top1, coalesce(bool_or(matched_company = target), false) AS in_list, min(CASE WHEN matched_company = target THEN rank END) AS target_rank, max(lead) AS top1_score, max(first) AS top1_company, count(matched_company) = 0 AS suppressed
FROM q LEFT JOIN r USING (query_id) LEFT JOIN lead USING (query_id) GROUP BY q.query_id, q.text, q.target, q.method)"""


def _outcomes(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    q = o.select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("text"), F.concat(F.lit("name "), (F.col("o_custkey") % 7).cast("string")).alias("target"), F.col("o_orderstatus").alias("method"))
    r = li.select(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("name "), (F.col("l_partkey") % 7).cast("string")).alias("matched_company"), F.round(1.0 - F.col("l_linenumber") / 10.0 - F.col("l_tax"), 6).alias("score"), F.col("l_linenumber").alias("rank"))
    return evaluate.outcomes(q, r)


@query(f"WITH {_RES} SELECT * REPLACE (coalesce(target_rank, 0) AS target_rank, coalesce(top1_score, -1.0) AS top1_score, coalesce(top1_company, '') AS top1_company) FROM o")
def eval_outcomes(spark, d):
    return _outcomes(spark, d).fillna(0, ["target_rank"]).fillna(-1.0, ["top1_score"]).fillna("", ["top1_company"])


@query(f"""WITH {_RES} SELECT count(*) AS n, round(count(*) FILTER (top1) / CAST(count(*) AS DOUBLE), 6) AS top1, round(count(*) FILTER (in_list) / CAST(count(*) AS DOUBLE), 6) AS top3, {', '.join(f"round(count(*) FILTER (target_rank <= {k}) / CAST(count(*) AS DOUBLE), 6) AS strict_top{k}" for k in (1, 3, 5))},
round(count(*) FILTER (NOT suppressed) / CAST(count(*) AS DOUBLE), 6) AS coverage, round(count(*) FILTER (top1) / CAST(count(*) FILTER (NOT suppressed) AS DOUBLE), 6) AS precision, round(sum(1.0 / target_rank) / count(*), 6) AS mrr FROM o""")
def eval_accuracy(spark, d):
    return evaluate.accuracy(_outcomes(spark, d))


_SWEEP = f"""{_RES}, g AS (SELECT t, round(t / 100.0, 2) AS threshold FROM (SELECT unnest(generate_series(0, 100, 2)) AS t)),
s AS (SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (coalesce(top1_score, 0) >= threshold) AS answered, count(*) FILTER (coalesce(top1_score, 0) >= threshold AND top1) AS correct, count(*) AS total FROM o, g GROUP BY threshold),
p AS (SELECT *, answered * 100.0 / total AS cov, CASE WHEN answered = 0 THEN 0 ELSE correct * 100.0 / answered END AS prec FROM s),
sweep AS (SELECT threshold, round(cov, 6) AS coverage, round(prec, 6) AS precision, CAST(correct AS BIGINT) AS correct, CAST(answered AS BIGINT) AS answered, round(CASE WHEN prec + cov > 0 THEN 1.25 * prec * cov / (0.25 * prec + cov) ELSE 0 END, 6) AS f05 FROM p)"""


@query(f"WITH {_SWEEP} SELECT * FROM sweep")
def eval_sweep(spark, d):
    return evaluate.sweep(_outcomes(spark, d))


@query(f"WITH {_SWEEP} SELECT min(threshold) FILTER (precision >= 95) AS at_95, min(threshold) FILTER (precision >= 98) AS at_98, min(threshold) FILTER (precision >= 99) AS at_99, (SELECT threshold FROM sweep ORDER BY f05 DESC, threshold LIMIT 1) AS best_threshold, max(f05) AS best_f05 FROM sweep")
def eval_recommended(spark, d):
    return evaluate.recommended(evaluate.sweep(_outcomes(spark, d)))


@query(f"WITH {_RES} SELECT method, count(*) AS n, count(*) FILTER (NOT top1) AS n_failed, round(avg(CASE WHEN top1 THEN 0.0 ELSE 1.0 END), 6) AS error_rate FROM o GROUP BY method")
def eval_method_errors(spark, d):
    return evaluate.method_errors(_outcomes(spark, d))


@query(f"WITH {_RES} SELECT CASE WHEN top1_score < 0.1 THEN '0.0-0.1' WHEN top1_score < 0.3 THEN '0.1-0.3' WHEN top1_score < 0.5 THEN '0.3-0.5' WHEN top1_score < 0.7 THEN '0.5-0.7' ELSE '0.7-1.0' END AS bucket, count(*) AS n FROM o WHERE NOT top1 AND NOT suppressed GROUP BY 1")
def eval_histogram(spark, d):
    return evaluate.score_histogram(_outcomes(spark, d))


@query()
def eval_failure_tags(spark, d):
    return evaluate.failure_tags(_outcomes(spark, d))


@query(f"""WITH {_RES}, f AS (SELECT *, {_token_set(S.clean('text'))} AS a, {_token_set(S.clean('target'))} AS b, {S.clean('target')} AS t FROM o WHERE NOT top1),
v AS (SELECT *, CASE WHEN t <> '' THEN {_JACCARD.format('a', 'b')} END AS overlap FROM f)
SELECT count(*) AS n_failed, count(*) FILTER (in_list) AS n_in_list, round(quantile_cont(top1_score, 0.5), 6) AS median_score, round(avg(overlap), 6) AS mean_overlap, count(*) FILTER (overlap = 0) AS n_no_overlap, count(*) FILTER (len(list_filter(string_split(target, ' '), lambda w: w <> '')) <= 3) AS n_short_targets FROM v""")
def eval_failure_stats(spark, d):
    return evaluate.failure_stats(_outcomes(spark, d))


@query(f"WITH {_RES}, p AS (SELECT substr({S.clean('target')}, 1, 3) AS prefix, substr({S.clean('top1_company')}, 1, 3) AS other FROM o WHERE NOT top1 AND top1_company IS NOT NULL) SELECT prefix, count(*) AS n FROM p WHERE prefix = other GROUP BY prefix")
def eval_confusable_prefixes(spark, d):
    return evaluate.confusable_prefixes(_outcomes(spark, d))


@query(f"WITH {_RES} SELECT method, count(*) AS n, {', '.join(f'round(avg(CASE WHEN target_rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS strict_top{k}' for k in (1, 3, 5))} FROM o GROUP BY method")
def eval_accuracy_by_method(spark, d):
    return evaluate.accuracy_by(_outcomes(spark, d))


@query(f"WITH {_RES} SELECT query_id, text, target, method, coalesce(top1_company, '') AS top1_company, coalesce(top1_score, -1.0) AS top1_score FROM o WHERE NOT top1")
def eval_errors(spark, d):
    return evaluate.errors(_outcomes(spark, d)).fillna(-1.0, ["top1_score"]).fillna("", ["top1_company"])


@query()
def eval_diagnosis(spark, d):
    o = _outcomes(spark, d)
    return evaluate.diagnosis(evaluate.failure_tags(o), o.where(~F.col("top1")).count())


@query("SELECT round(avg(o_totalprice), 6) AS avg, round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.95), 6) AS p95, round(quantile_cont(o_totalprice, 0.99), 6) AS p99 FROM orders")
def eval_percentiles(spark, d):
    return evaluate.percentiles(table(spark, d, "orders"), "o_totalprice")


# --- sources, sinks, relational --------------------------------------------------------------------------------------


@query("SELECT DISTINCT trim(regexp_replace(x, '^\\d+\\s*', '')) AS name FROM (SELECT unnest(regexp_extract_all(html, '<li><a[^>]*>([^<]*)</a>', 1)) AS x FROM pages) WHERE length(trim(regexp_replace(x, '^\\d+\\s*', ''))) > 5")
def page_anchors(spark, d):
    return readers.anchors(table(spark, d, "pages"))


@query("SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def names_union(spark, d):
    return readers.union_distinct(table(spark, d, "nation").select(F.col("n_name").alias("name")), table(spark, d, "region").select(F.col("r_name").alias("name")))


@query("SELECT c_custkey AS k, CASE WHEN o.k IS NULL THEN c_acctbal ELSE o.v END AS v FROM customer LEFT JOIN (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders GROUP BY 1) o ON o.k = c_custkey UNION ALL SELECT k, v FROM (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders GROUP BY 1) WHERE k NOT IN (SELECT c_custkey FROM customer)")
def upsert_rows(spark, d):
    target = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    source = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return storage.upsert(target, source, ["k"], ["v"])


@query("SELECT c_custkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT k, v FROM (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders GROUP BY 1) WHERE k NOT IN (SELECT c_custkey FROM customer)")
def insert_new_rows(spark, d):
    target = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    source = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return storage.upsert(target, source, ["k"])


@query("SELECT c_custkey, c_name, length(c_name) AS n, c_mktsegment FROM customer WHERE c_name LIKE 'Customer#%' AND regexp_matches(c_name, '\\w{5,}')")
def sql_view(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("quillon_customer")
    return spark.sql(r"SELECT c_custkey, c_name, CAST(length(c_name) AS BIGINT) AS n, c_mktsegment FROM quillon_customer WHERE c_name LIKE 'Customer#%' AND c_name RLIKE '\\w{5,}'")


@query("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1")
def grouped_statistics(spark, d):
    p = F.col("o_totalprice")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 4).alias("mean"), F.round(F.stddev(p), 4).alias("sd"), F.min(p).alias("low"), F.max(p).alias("high"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return streaming.windowed_counts(table(spark, d, "events"))


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
