"""DuckDB SQL for the oracles, generated from the same fixed values as the engine's expressions.

DuckDB's regular expressions know ASCII word boundaries only.  Lower-case text has no ASCII capitals, so every
accented letter is spelled as two capitals first; then boundaries and classes mean what they mean in Unicode.
"""

from __future__ import annotations

from ..functions import vocabulary as V

_LETTERS = sorted({c for c in V.ACCENTED if c.islower()})
_CODES = {c: "QWX"[i // 26] + chr(65 + i % 26) for i, c in enumerate(_LETTERS)}


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def spelled(s: str) -> str:
    return "".join(_CODES.get(c, c) for c in s)


def encoded(x: str) -> str:
    for c, code in _CODES.items():
        x = f"replace({x}, {lit(c)}, {lit(code)})"
    return x


def stripped(x: str) -> str:
    base = dict(zip(V.ACCENTED, V.PLAIN, strict=True))
    for c, code in _CODES.items():
        x = f"replace({x}, {lit(code)}, {lit(base[c])})"
    return x


def decoded(x: str) -> str:
    for c, code in _CODES.items():
        x = f"replace({x}, {lit(code)}, {lit(c)})"
    return x


def rewrites(x: str, rules: list[tuple[str, str]]) -> str:
    for pattern, to in rules:
        if "(?=" in pattern:  # no lookahead here: capture it and put it back
            head, _, tail = pattern.partition("(?=")
            pattern, to = head + "(" + tail, to + "\\1"
        x = f"regexp_replace({x}, {lit(spelled(pattern))}, {lit(to)}, 'g')"
    return x


def lowered(x: str) -> str:
    return encoded(f"regexp_replace(lower(nfc_normalize(coalesce({x}, ''))), '^\\s+|\\s+$', '', 'g')")


def entity(x: str) -> str:
    return rewrites(x, V.ENTITY_REWRITES)


def functional(x: str) -> str:
    return rewrites(x, V.FUNCTIONAL_REWRITES)


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def clean(x: str, stopwords: bool = True) -> str:
    y = f"regexp_replace({functional(entity(lowered(x)))}, '[^a-zA-Z0-9\\s&+\\-]', ' ', 'g')"
    if stopwords:
        y = rewrites(y, [(rf"\b{w}\b", "") for w in V.STOP_WORDS])
        y = rewrites(stripped(y), [(rf"\b{w}\b", "") for w in V.STOP_WORDS_PLAIN])
    else:
        y = stripped(y)
    return trimmed(f"regexp_replace({y}, '\\s+', ' ', 'g')")


def pipeline_key(x: str) -> str:
    return trimmed(stripped(functional(entity(lowered(x)))))


def accents(x: str) -> str:
    return f"translate(coalesce({x}, ''), {lit(V.ACCENTED)}, {lit(V.PLAIN)})"


NAME = "CASE p_size % 4 WHEN 0 THEN 'CÔNG TY TNHH ' WHEN 1 THEN 'CTCP ' WHEN 2 THEN 'Tập đoàn ' ELSE 'Công ty CP Thương mại Dịch vụ ' END || p_name || ' ' || p_type"
NAMES = f"names AS (SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS BIGINT) AS doc_id, name FROM (SELECT DISTINCT {NAME} AS name FROM part))"
QUERIES = "queries AS (SELECT CAST(row_number() OVER (ORDER BY p_name) - 1 AS BIGINT) AS query_id, 'JSC ' || upper(p_name) || ' small' AS query_text FROM (SELECT DISTINCT p_name FROM part))"
DOCS = f"docs AS MATERIALIZED (SELECT doc_id, name, {clean('name')} AS cleaned FROM names)"
CLEAN_QUERIES = f"qs AS MATERIALIZED (SELECT query_id, query_text, {clean('query_text')} AS cleaned FROM queries)"


def _grams(table: str, key: str) -> str:
    return f"SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(flatten(list_transform([2, 3, 4, 5], lambda n: list_transform(generate_series(1, length(cleaned) - n + 1), lambda i: substr(cleaned, i, n))))) AS term FROM {table}) GROUP BY ALL"


def _tokens(table: str, key: str) -> str:
    return f"SELECT {key}, token, count(*) AS tf, max(dl) AS dl FROM (SELECT {key}, len(t) AS dl, unnest(t) AS token FROM (SELECT {key}, list_filter(string_split(cleaned, ' '), lambda x: x <> '') AS t FROM {table})) GROUP BY {key}, token"


TFIDF = f"""dg AS MATERIALIZED ({_grams('docs', 'doc_id')}), qg AS ({_grams('qs', 'query_id')}),
nd AS (SELECT count(*) AS n FROM docs),
idf AS MATERIALIZED (SELECT term, ln((1 + n) / (1.0 + count(*))) + 1 AS idf FROM dg, nd GROUP BY term, n),
dw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM dg JOIN idf USING (term)),
qw AS (SELECT query_id, term, (1 + ln(tf)) * idf AS w FROM qg JOIN idf USING (term)),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM dw GROUP BY doc_id), qn AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY query_id),
tfidf AS MATERIALIZED (SELECT query_id, doc_id, round(dot / (qn.n * dn.n), 6) AS score FROM (SELECT query_id, doc_id, sum(qw.w * dw.w) AS dot FROM qw JOIN dw USING (term) GROUP BY ALL) JOIN qn USING (query_id) JOIN dn USING (doc_id))"""

BM25 = f"""dt AS MATERIALIZED ({_tokens('docs', 'doc_id')}), qt AS ({_tokens('qs', 'query_id')}),
bn AS (SELECT count(*) AS n, avg(len(list_filter(string_split(cleaned, ' '), lambda x: x <> ''))) AS avgdl FROM docs),
raw AS (SELECT token, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM dt, bn GROUP BY token, n),
tidf AS (SELECT token, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
bm25 AS MATERIALIZED (SELECT query_id, doc_id, round(sum(qt.tf * idf * dt.tf * 2.5 / (dt.tf + 1.5 * (0.25 + 0.75 * dt.dl / avgdl))), 6) AS score FROM qt JOIN tidf USING (token) JOIN dt USING (token), bn GROUP BY query_id, doc_id)"""

HYBRID = """best AS (SELECT query_id, doc_id, CASE WHEN greatest(max(score) OVER (PARTITION BY query_id), 0) > 0 THEN score / greatest(max(score) OVER (PARTITION BY query_id), 0) ELSE score END AS score FROM bm25),
hybrid AS (SELECT query_id, doc_id, round(0.5 * coalesce(t.score, 0) + 0.5 * coalesce(b.score, 0), 6) AS score FROM tfidf t FULL JOIN best b USING (query_id, doc_id))"""

_TYPES = "[" + ", ".join(map(lit, V.ENTITY_TYPES)) + "]"


def entity_type(x: str) -> str:
    return f"list_filter({_TYPES}, lambda e: list_contains(string_split({x}, ' '), e))[1]"


def has_repeats(x: str) -> str:
    t = f"list_filter(string_split({x}, ' '), lambda w: w <> '')"
    return f"(len(list_filter(generate_series(1, len({t}) - 1), lambda i: {t}[i] = {t}[i + 1] AND length({t}[i]) > 1)) > 0 OR len(list_filter(generate_series(1, len({t}) - 3), lambda i: {t}[i] = {t}[i + 2] AND {t}[i + 1] = {t}[i + 3])) > 0)"


def ranked(scores: str, top_k: int = 5, min_score: float = 0.0) -> str:
    """CTEs that end in ``final`` (query_id, name, doc_id, score, pos)."""
    return f"""over_k AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS pos FROM {scores} WHERE score > 0) WHERE pos <= {5 * top_k}),
members AS (SELECT cleaned AS k, count(*) AS m FROM docs GROUP BY cleaned),
grp AS (SELECT query_id, cleaned AS k, max(score) AS score, min(pos) AS pos FROM over_k JOIN docs USING (doc_id) GROUP BY query_id, cleaned),
kept AS (SELECT * FROM (SELECT grp.*, coalesce(sum(m) OVER (PARTITION BY query_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM grp JOIN members USING (k)) WHERE before < {top_k}),
spread AS (SELECT query_id, doc_id, name, k, CASE WHEN {has_repeats('k')} THEN round(kept.score * 0.85, 6) ELSE kept.score END AS score, row_number() OVER (PARTITION BY query_id ORDER BY pos, doc_id) AS old FROM kept JOIN docs ON docs.cleaned = kept.k),
sorted AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS pos FROM spread),
typed AS (SELECT s.*, {entity_type('k')} AS kind, {entity_type('qs.cleaned')} AS wanted FROM sorted s JOIN qs USING (query_id)),
tops AS (SELECT query_id, max(CASE WHEN pos = 1 THEN score END) AS top, bool_or(pos = 1 AND kind IS NOT DISTINCT FROM wanted) AS fits, min(CASE WHEN kind = wanted THEN pos END) AS j FROM typed GROUP BY query_id),
near AS (SELECT t.query_id, round(top - score, 9) <= 0.2 AS near FROM typed t JOIN tops USING (query_id) WHERE pos = j),
placed AS (SELECT t.*, (wanted IS NOT NULL AND NOT fits AND j IS NOT NULL AND coalesce(near, false)) AS go, j FROM typed t JOIN tops USING (query_id) LEFT JOIN near USING (query_id)),
done AS (SELECT query_id, doc_id, name, score, CASE WHEN go AND pos = j THEN 1 WHEN go AND pos < j THEN pos + 1 ELSE pos END AS pos FROM placed),
final AS (SELECT * FROM (SELECT *, max(CASE WHEN pos = 1 THEN score END) OVER (PARTITION BY query_id) AS lead FROM done) WHERE lead >= {min_score})"""


CONFIDENCE = "CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.75 THEN 'medium' ELSE 'low' END"
RESULT = f"SELECT query_id, query_text, name AS matched_company, CAST(doc_id AS VARCHAR) AS canonical_id, score, CAST(pos AS INTEGER) AS rank, {CONFIDENCE} AS match_confidence FROM final JOIN queries USING (query_id)"


def match_sql(model: str, top_k: int = 5, min_score: float = 0.0) -> str:
    parts = {"tfidf": [TFIDF], "bm25": [BM25], "hybrid": [TFIDF, BM25, HYBRID]}[model]
    return "WITH " + ",\n".join([NAMES, QUERIES, DOCS, CLEAN_QUERIES, *parts, ranked(model, top_k, min_score)]) + "\n" + RESULT
