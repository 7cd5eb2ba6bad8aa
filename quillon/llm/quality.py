"""Quality classifier: Bradley-Terry pairwise ranking over text features, cut at a score quantile.

Features are shares of kinds of characters, words and lines, and what the labels teach about n-grams: the mean log
ratio, good over bad, of a text's hashed byte trigrams.  The ratios of each half of the labelled rows serve the
other half while the ranking is fitted, so that no row is judged by its own label; new texts get the mean of both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_sums, in_fold, materialise, numbered, release

CUT = 0.3
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NAMES = ("symbols", "upper", "digits", "marks", "distinct", "distinct2", "repeat_lines", "log_words", "word_length", "bars", "short", "trigrams", "least_trigrams")
#: Buckets of the hashed trigrams.
GRAMS = 1 << 16
#: Bits of the filter that tells most unlabelled ids.
FILTER = 1 << 24


def trigrams(b: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of a text, white space included."""
    a = np.frombuffer(b, np.uint8).astype(np.uint32)
    return ((a[:-2] | a[1:-1] << np.uint32(8) | a[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(16)


def features(text: str | None, ratios: np.ndarray) -> list[float]:
    """Shares and counts over the whole text, and the mean of its trigrams' log ratios and of the worst tenth of its parts; null
    counts as empty."""
    b = (text or "").encode()
    n = max(1, len(b))
    words = b.split()
    nw = max(1, len(words))
    lines = [x for x in b.split(b"\n") if x.strip()]
    gone = lambda chars: (len(b) - len(b.translate(None, chars))) / n
    distinct = len(set(words)) / nw
    found = ratios[trigrams(b)]
    parts = np.add.reduceat(found, np.arange(0, len(found), 256)) / np.diff(np.append(np.arange(0, len(found), 256), len(found))) if len(found) else np.zeros(1)
    return [
        min(1.0, 8 * gone(b"#*$%&<>")), min(1.0, 3 * gone(UPPER)), min(1.0, 5 * gone(b"0123456789")), min(1.0, 10 * gone(b"!?")), distinct, max(0.0, 0.6 - distinct) * 3,
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(words)) / 8, min(1.0, len(b) / nw / 20), min(1.0, 4 * b.count(b"|") / nw), 1.0 if len(words) < 5 else 0.0,
        float(found.mean()) if len(found) else 0.0, float(np.sort(parts)[: -(-len(parts) // 10)].mean()),
    ]


def pair_sums(rows: DataFrame, w: np.ndarray, width: float) -> tuple[np.ndarray, ...]:
    """Of the labelled rows (y, x), by label and by cells of their scores x w: counts, mean scores, and sums of x and of x x'."""
    m = len(w)

    def run(batches):
        have = {}
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, m)
            z = x @ w
            key, back = np.unique(2 * np.floor(z / width).astype(np.int64) + b.column(0).to_numpy(), return_inverse=True)
            by = np.argsort(back, kind="stable")
            for k, at in zip(key.tolist(), np.split(by, np.cumsum(np.bincount(back))[:-1]), strict=True):
                one = np.concatenate([[len(at), z[at].sum()], x[at].sum(0), (x[at].T @ x[at]).ravel()])
                have[k] = have[k] + one if k in have else one
        yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int64()), pa.array([x.tobytes() for x in have.values()], pa.binary())], ["k", "p"])

    told = block_sums(rows.select("y", "x").mapInArrow(run, "k long, p binary"))
    keys = sorted(told)
    all_ = np.array([told[k] for k in keys]).reshape(len(keys), 2 + m + m * m)
    y = np.array(keys, np.int64) & 1
    return y, all_[:, 0], all_[:, 1] / np.maximum(all_[:, 0], 1), all_[:, 2 : 2 + m], all_[:, 2 + m :].reshape(-1, m, m)


def fit(rows: DataFrame, l2: float = 1e-3, rounds: int = 25, width: float = 1 / 16) -> dict:
    """Weights that maximise the likelihood of 'the better of each pair ranks higher' over all pairs of a good and a bad row (y, x),
    by Newton steps, and the score at the quantile that equals the share of label 0.

    The pairs are not listed: what a row adds to the slopes depends on its score and the scores of the other label, which are summed in
    cells of ``width``, each at its mean score."""
    w = np.zeros(len(NAMES))
    for _ in range(rounds):
        y, n, z, sx, sxx = pair_sums(rows, w, width)
        good, bad = y == 1, y == 0
        if not good.any() or not bad.any():
            break
        pairs = n[good].sum() * n[bad].sum()
        p = 1 / (1 + np.exp(-np.clip(z[good][:, None] - z[bad][None], -30, 30)))  # of a good row's cell over a bad row's
        miss, bend = 1 - p, p * (1 - p)
        slope = (miss @ n[bad]) @ sx[good] - (n[good] @ miss) @ sx[bad]
        cross = sx[good].T @ bend @ sx[bad]
        curve = np.tensordot(bend @ n[bad], sxx[good], 1) + np.tensordot(n[good] @ bend, sxx[bad], 1) - cross - cross.T
        step = np.linalg.solve(curve / pairs + l2 * np.eye(len(w)), slope / pairs - l2 * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return {"w": w, "cut": quantile(rows, w)}


def quantile(rows: DataFrame, w: np.ndarray) -> float:
    """The quantile of the scores x w that equals the share of label 0, between the two rows beside it."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(b.column(0).flatten().to_numpy().reshape(-1, len(w)) @ w)], ["z"])

    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("y") == 0, 1)).alias("bad")).first()
    if not size["n"]:
        return 0.0
    at = size["bad"] / size["n"] * (size["n"] - 1)
    ranked = numbered(rows.select("x").mapInArrow(run, "z double"), ["z"], "ranked")
    z = sorted(r["z"] for r in ranked.where(F.col("_rank").isin(int(at), int(at) + 1)).collect())
    return float(z[0] + (z[-1] - z[0]) * (at - int(at)))


def score(x: np.ndarray, model: dict) -> np.ndarray:
    """0 to 1; the quantile cut falls on CUT."""
    z = x @ model["w"] - model["cut"] + np.log(CUT / (1 - CUT))
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, y, half, text) of all labelled documents outside the held-out fold.  Of an id's labels the worst counts; all its
    texts teach.  A filter of FILTER bits, which may let others through, keeps most unlabelled texts from being moved."""
    ids = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~in_fold("doc_id", 5, 0)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y")).where("y IN (0, 1)")
    ids = materialise(ids, "marks")
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER))
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    words = ids.select(F.floor(bit / 64).alias("word"), mark.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))  # FILTER / 64 rows at most
    have = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.floor(bit / 64).alias("word"), mark.alias("bit"))
    have = have.join(F.broadcast(words), "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("doc_id", "text").join(ids, "doc_id")
    out = materialise(have.select("doc_id", "y", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half"), "text"), "labelled")
    release(ids)
    return out


def learn_ratios(have: DataFrame) -> np.ndarray:
    """Log ratios (half, bucket) of mean trigram shares, good over bad, over all rows.  The driver receives a table per half and label."""
    block = 4096

    def run(batches):
        total, n = np.zeros(4 * GRAMS), np.zeros(4)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                kind = 2 * part.column(1).to_numpy() + part.column(0).to_numpy()
                each = [trigrams(t.encode()) for t in part.column(2).to_pylist()]
                sizes = np.array([len(x) for x in each])
                flat = np.concatenate(each).astype(np.int64) + np.repeat(kind.astype(np.int64) * GRAMS, sizes)
                total += np.bincount(flat, np.repeat(1 / np.maximum(sizes, 1), sizes), 4 * GRAMS)
                n += np.bincount(kind[sizes > 0], minlength=4)
        parts = [n.tobytes(), *(x.tobytes() for x in total.reshape(-1, block))]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)) - 1), pa.array(parts, pa.binary())], ["k", "p"])

    told = block_sums(have.select("y", "half", "text").mapInArrow(run, "k long, p binary"))
    n = told.get(-1, np.zeros(4)).reshape(2, 2)
    total = np.concatenate([told.get(k, np.zeros(block)) for k in range(4 * GRAMS // block)]).reshape(2, 2, GRAMS)
    mean = total / np.maximum(n, 1)[..., None]
    out = np.clip(np.log((mean[:, 1] + 1e-5) / (mean[:, 0] + 1e-5)), -4, 4)
    return np.where((n > 0).all(1)[:, None], out.round(6), 0.0)  # rounded, as the order of sums is not fixed


def training_rows(have: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(y, x): labels and features of all labelled rows, each with the ratios of the other half."""
    shared = have.sparkSession.sparkContext.broadcast(ratios)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [features(t, shared.value[1 - h]) for t, h in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float64()))], ["y", "x"])

    return materialise(have.select("y", "text", "half").mapInArrow(run, "y int, x array<double>"), "features")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; fitted on all labelled rows outside the held-out fold.

    Null and empty texts get the score of no words.  Without labels of both kinds every row scores CUT.
    Repeated rows score alike, whatever their ids; long texts are read whole; an empty table gives no rows; the table's other
    columns are never read.  The same tables give the same model.
    """
    have = labelled_rows(docs, labels)
    ratios = learn_ratios(have)
    rows = training_rows(have, ratios)
    release(have)
    model = fit(rows)
    release(rows)
    both = ratios.mean(0)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                x = np.array([features(t, both) for t in part.column("text").to_pylist()]).reshape(-1, len(NAMES))
                s = score(x, model)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
