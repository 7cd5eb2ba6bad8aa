"""Mixing sources to target weights (native): soft domain membership and nonnegative document rates."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise, release, words_of

DOMAINS = ("high", "low", "toxic")
#: Steps of the posterior grid per domain, of which documents in one cell share a rate.
GRID = 128
#: Files of the table of cells, which has 2 * (GRID + 1)^2 rows at most and is read in every round.
FILES = 4


def domain_of(labels: DataFrame) -> DataFrame:
    """One row per labelled doc_id; conflicting labels take the worse one, rows without a label go."""
    one = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("doc_id IS NOT NULL AND q IS NOT NULL")
    return one.select("doc_id", F.when(F.col("t") == 1, "toxic").when(F.col("q") == 1, "high").otherwise("low").alias("domain"))


def lexicon(docs: DataFrame, labelled: DataFrame, rows: int = 1000, words: int = 16, least: int = 5) -> dict[str, list[str]]:
    """Per domain, the words whose document share most exceeds that of the other domains.

    Learned from ``rows`` labelled rows per domain (a bounded sample, smallest id hash first); the driver
    receives ``words`` words per domain.
    """
    from pyspark.sql import Window

    pick = labelled.withColumn("rn", F.row_number().over(Window.partitionBy("domain").orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("rn") <= rows).drop("rn")
    # Materialised, as Spark would push the split of the texts below the join, to every document.
    have = materialise(docs.join(F.broadcast(pick), "doc_id").select("domain", "text"), "labelled")  # pick: at most rows x domains ids
    seen = have.select("domain", F.explode(F.array_distinct(words_of(F.lower("text")))).alias("word"))
    seen = materialise(seen.groupBy("word").pivot("domain", list(DOMAINS)).count().fillna(0), "lexicon")
    size = {r["domain"]: r["n"] for r in have.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = {}
    for d in DOMAINS:
        rest = sum((F.col(o) for o in DOMAINS if o != d), F.lit(0))
        lift = F.log((F.col(d) + 0.5) / (size.get(d, 0) + 1.0)) - F.log((rest + 0.5) / (sum(v for k, v in size.items() if k != d) + 1.0))
        best = seen.where(F.col(d) >= max(least, size.get(d, 0) // 50)).where(lift > 2).orderBy(lift.desc(), "word").limit(words)
        out[d] = [r["word"] for r in best.select("word").collect()]
    return out


INPUTS = ("symbols", "upper", "distinct", "log_words", "word_length", *(f"lex_{d}" for d in DOMAINS))


def features(text: Column, words: dict[str, list[str]]) -> Column:
    """A struct of ``n`` (words) and the classifier's inputs ``x`` (in the order of INPUTS), from the row alone.  Text, words
    and distinct words are bound inside the expression, so each is computed once."""
    every = F.array(*map(F.lit, sorted({w for d in DOMAINS for w in words.get(d) or ["\0"]})))

    def body(t, w, seen):
        n_chars, n = F.greatest(F.length(t), F.lit(1)), F.greatest(F.size(w), F.lit(1))
        x = [F.regexp_count(t, F.lit("[#*$%&|<>!]")) / n_chars, F.regexp_count(t, F.lit("[A-Z]")) / n_chars, F.size(seen) / n, F.log1p(F.size(w).cast("double")), F.length(t) / n]
        own = lambda hit, d: F.log1p(F.size(F.array_intersect(hit, F.array(*map(F.lit, words.get(d) or ["\0"])))).cast("double"))
        lex = let(F.array_intersect(seen, every), lambda hit: F.array(*[own(hit, d) for d in DOMAINS]))
        return F.struct(F.size(w).cast("long").alias("n"), F.concat(F.array(*[v.cast("double") for v in x]), lex).alias("x"))

    return let(F.coalesce(text, F.lit("")), lambda t: let(words_of(F.lower(t)), lambda w: let(F.array_distinct(w), lambda seen: body(t, w, seen))))


def fit(known: DataFrame) -> dict[str, tuple[float, list[tuple[float, float]]]]:
    """Log prior, and mean and variance of every input, per domain: one aggregation over all labelled rows (domain, x)."""
    stats = [f(F.col("x")[i]).alias(f"{k}{i}") for i in range(len(INPUTS)) for k, f in (("m", F.avg), ("v", F.var_pop))]
    rows = known.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), *stats).collect()
    total = sum(r["n"] for r in rows)
    return {r["domain"]: (math.log(r["n"] / total), [(r[f"m{i}"], r[f"v{i}"] + 1e-3) for i in range(len(INPUTS))]) for r in rows}


def posteriors(model: dict, x: Column) -> Column:
    """P(domain | inputs) as one array in the order of DOMAINS; uniform where no row is labelled, 0 for a domain without
    labelled rows.  The log scores are tempered by half, as the inputs are not independent."""
    if not model:
        return F.array(*[F.lit(1.0 / len(DOMAINS)) for _ in DOMAINS])
    scores = []
    for d in DOMAINS:
        if d not in model:
            scores.append(F.lit(float("-inf")))
            continue
        prior, stats = model[d]
        # -(x - m)^2 / 2v - log(v) / 2, multiplied out, so that each input occurs once
        constant = prior - sum(m * m / (2 * v) + 0.5 * math.log(v) for m, v in stats)
        scores.append(sum((x[i] * (m / v - x[i] * (0.5 / v)) for i, (m, v) in enumerate(stats)), F.lit(constant)) / 2)
    weights = lambda s: let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top)))
    total = lambda w: F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    return let(let(F.array(*scores), weights), lambda w: let(total(w), lambda z: F.transform(w, lambda x: x / z)))


def cell(p: Column, low: Column) -> Column:
    """The grid cell of a posterior (K - 1 shares in steps of 1 / GRID; the last one follows) and the rate's lower bound."""
    return F.concat(F.transform(F.slice(p, 1, len(DOMAINS) - 1), lambda v: F.floor(v * GRID).cast("int")), F.array(low.cast("int")))


def cells_of(soft: DataFrame) -> DataFrame:
    """Rows (cell, p, n, low) that stand for all documents of a cell: their tokens, and the token-weighted mean of their
    posteriors, so that n * p is exactly the sum of their expected tokens.  The grid bounds their number, not the corpus."""
    n = F.col("n").cast("double")
    sums = soft.groupBy("cell").agg(F.sum(n).alias("n"), *[F.sum(n * F.col("p")[i]).alias(f"a{i}") for i in range(len(DOMAINS))], *[F.avg(F.col("p")[i]).alias(f"m{i}") for i in range(len(DOMAINS))])
    p = F.array(*[F.when(F.col("n") > 0, F.col(f"a{i}") / F.col("n")).otherwise(F.col(f"m{i}")) for i in range(len(DOMAINS))])
    return sums.select("cell", p.alias("p"), "n", F.element_at("cell", -1).cast("double").alias("low"))


def replay(rate: Column, steps: list[list[float]], p: Column, low: Column) -> Column:
    """A cell's rate after steps g: rate' = max(low, rate - p . g).  Steps are one array literal, so every round runs the
    same plan and the same compiled code."""
    all_steps = F.array(*[F.array(*[F.lit(float(v)) for v in g]) for g in steps]) if steps else F.array().cast("array<array<double>>")
    return F.aggregate(all_steps, rate, lambda r, g: F.greatest(low, r - sum((p[i] * g[i] for i in range(len(DOMAINS))), F.lit(0.0))))


def solve(cells: DataFrame, weights: dict[str, float], scale: float | None = None, protect: str | None = None, rounds: int = 150, keep: int = 12, tol: float = 1e-6) -> tuple[DataFrame, dict]:
    """Distributed projected-gradient least squares for nonnegative rates r: min sum_k (sum_i n_i p_ik r_i - target_k)^2, r >= low.

    The gradient of r_i is n_i p_i . g with g the residual per domain.  In the variables sqrt(n_i) r_i, in which large
    documents don't dwarf small ones, a step is r_i - size * p_i . g, and the projection still is max(low, .).  Sizes are spectral
    (Barzilai-Borwein: the last move's square over that of the change of totals); one that doesn't bring the residual
    under the largest of the last ten is cut by four, down to 1 / L, with L the largest eigenvalue of
    H = sum_i n_i p_i p_i', where descent is certain.  A round is one aggregation over ``cells``; after ``keep`` steps the
    rates are written, so that no plan grows.  It ends when the residual is under ``tol`` of the goal, or a step of at least
    1 / L moves under ``tol`` of the tokens (``told["converged"]``), else after ``rounds``.

    ``scale``: wanted total over the present total (None: as much as keeps the ``protect`` domain at its present size).
    Returns (cell, rate) and what is told of the solution.  Targets that no rates reach get the nearest totals.
    """
    import numpy as np

    K = range(len(DOMAINS))
    now = materialise(cells.withColumn("rate", F.lit(1.0)).coalesce(FILES), "cells", "uncompressed")  # bounded by the grid
    n, p, low = F.col("n"), F.col("p"), F.col("low")
    first = now.agg(*[F.sum(n * p[i]).alias(f"t{i}") for i in K], *[F.sum(n * p[i] * p[j]).alias(f"h{i}{j}") for i in K for j in K]).first()
    got = start = np.array([float(first[f"t{i}"] or 0) for i in K])
    total = float(start.sum())
    least = 1 / max(float(np.linalg.eigvalsh(np.array([[float(first[f"h{i}{j}"] or 0) for j in K] for i in K])).max()), 1e-12)
    w = np.array([weights.get(d, 0.0) for d in DOMAINS]) / sum(weights.values())
    if scale is None:
        k = DOMAINS.index(protect) if protect else 0
        scale = max(1.0, start[k] / (w[k] * total)) if total and protect and w[k] else 1.0
    goal = w * total * scale
    steps: list[list[float]] = []
    left = lambda t: float(((t - goal) ** 2).sum())

    def look(step):
        """Totals after the kept steps and this one, and by how much it moves the rates: token-weighted square and sum."""
        moved = now.select("n", "p", "low", replay(F.col("rate"), steps, p, low).alias("r")).select("n", "p", "r", replay(F.col("r"), [step], p, low).alias("s"))
        row = moved.agg(*[F.sum(n * p[i] * F.col("s")).alias(f"t{i}") for i in K], F.sum(n * (F.col("s") - F.col("r")) ** 2).alias("q"), F.sum(n * F.abs(F.col("s") - F.col("r"))).alias("d")).first()
        return np.array([float(row[f"t{i}"] or 0) for i in K]), float(row["q"] or 0), float(row["d"] or 0) / max(total, 1.0)

    size, past, used, moved, done = least, [left(got)], 0, 0.0, not total
    while not done and used < rounds:
        step = (size * (got - goal)).tolist()
        new, square, moved = look(step)
        used += 1
        if left(new) > max(past[-10:]) and size > least:
            size = max(least, size / 4)
            continue
        change = float(((new - got) ** 2).sum())
        steps, got = [*steps, step], new
        past.append(left(got))
        done = moved <= tol or math.sqrt(past[-1]) <= tol * float(goal.sum())
        size = max(least, square / change) if change > 0 else least
        if len(steps) == keep and not done:
            old, now = now, materialise(now.withColumn("rate", replay(F.col("rate"), steps, p, low)), "cells", "uncompressed")
            release(old)
            steps = []
    rates = materialise(now.select("cell", replay(F.col("rate"), steps, p, low).alias("rate")), "rates")
    release(now)
    by = lambda v: dict(zip(DOMAINS, map(float, v), strict=True))
    return rates, {"goal": by(goal), "got": by(got), "start": by(start), "rounds": used, "converged": bool(done), "moved": moved}


def copies_of(rate: Column, key: Column) -> Column:
    """Whole copies with the rate as expectation: the fraction falls by a hash of the row's key, the same at every run."""
    u = F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def solved(docs: DataFrame, labels: DataFrame, weights: dict[str, float], text: str, key: str, scale: float | None, protect: str | None, carry: list[str]) -> tuple[DataFrame, dict]:
    """(row, n, p, rate, copies) for every row of ``docs``, its ``carry`` columns packed in ``row``."""
    labelled = domain_of(labels)
    words = lexicon(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), labelled)
    whole = lambda c: F.col("`" + c.replace("`", "``") + "`")
    row = F.struct(*[whole(c).alias(c) for c in carry])
    table = materialise(docs.select(row.alias("row"), whole(key).alias("key"), features(whole(text), words).alias("f")), "mix")
    model = fit(table.select(F.col("key").alias("doc_id"), F.col("f.x").alias("x")).join(labelled, "doc_id"))
    soft = table.select("row", "key", F.col("f.n").alias("n"), posteriors(model, F.col("f.x")).alias("p"))
    low = F.when(F.col("p")[DOMAINS.index(protect)] >= 0.5, 1).otherwise(0) if protect else F.lit(0)
    soft = soft.withColumn("cell", cell(F.col("p"), low))
    rates, told = solve(cells_of(soft), weights, scale, protect)
    if not told["converged"]:
        warnings.warn(f"mixing stopped after {told['rounds']} rounds at {told['got']}, short of {told['goal']}", stacklevel=3)
    out = soft.join(F.broadcast(rates), "cell")  # at most 2 * (GRID + 1)^2 cells, whatever the corpus
    return out.select("row", "n", "p", "rate", copies_of(F.col("rate"), F.col("key")).alias("copies")), told | {"model": model, "lexicon": words}


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], text: str = "text", key: str = "doc_id", scale: float | None = None, protect: str | None = None, carry: list[str] | None = None) -> tuple[DataFrame, dict]:
    """Per row of ``docs``: carried columns (default: the key), ``n_tokens``, ``p_<domain>``, ``rate`` and ``copies``.

    ``weights``: wanted share of tokens per domain; ``scale``: wanted total over the present total (None: as
    much as keeps the ``protect`` domain at its present size at least).  With ``protect``, rows that more
    likely than not belong to that domain keep a rate of 1 at least.  Documents whose posteriors fall into one cell of the
    grid share a rate; the totals use every document's own posterior.  Null and empty texts have no tokens: any rate
    fits them and theirs follows their posterior.  An empty table gives no rows; repeated rows get equal rates and
    copies; without labels posteriors are uniform; carried columns that bear a result's name are refused.  Only
    model parameters and domain totals reach the driver.
    """
    carry = carry or [key]
    own = ["n_tokens", *[f"p_{d}" for d in DOMAINS], "rate", "copies"]
    if set(own) & set(carry):
        raise ValueError(f"carried columns have names of results: {sorted(set(own) & set(carry))}")
    out, told = solved(docs, labels, weights, text, key, scale, protect, carry)
    return out.select("row.*", F.col("n").alias("n_tokens"), *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", "copies"), told


def resample(docs: DataFrame, labels: DataFrame, weights: dict[str, float], text: str = "text", key: str = "doc_id", scale: float | None = None, protect: str | None = None) -> DataFrame:
    """The rows of ``docs`` as often as their copies say, with their own columns, whatever the names.  Nulls, empty tables
    and repeated rows as in ``mix``."""
    out, _ = solved(docs, labels, weights, text, key, scale, protect, docs.columns)
    return out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
