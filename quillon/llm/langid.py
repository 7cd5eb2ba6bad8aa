"""Language ID by cross-parsing: the language whose suffix automaton needs the fewest normalised phrases wins.

Texts are lower-cased, every run of characters that aren't letters becomes one space, and the UTF-8 bytes are parsed, so
that a script of any size fits an automaton of at most 256 symbols.  A phrase is the longest match in a language's reference;
each costs the logarithm of the reference's length (Ziv and Merhav's cross-parsing), which evens out references of
different lengths.

Long texts are parsed in blocks side by side: first as if a phrase began with every block, then each block anew from the
state that the one before it ends in, until both parses begin a phrase at the same place, from where on they
agree.  So the phrases are those of one parse of the whole text.
"""

from __future__ import annotations

import uuid
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, in_fold, own_columns

#: Bytes of a block, and bytes that one vectorised step over blocks holds at most (a longer text is a batch of its own).
BLOCK, BATCH = 1024, 4_000_000
#: Letters that a language's labelled text has at least; a language with less isn't learned.
LEAST = 20


def automaton(ids: list[int], width: int) -> np.ndarray:
    """Suffix automaton of a symbol sequence as a dense table state x symbol -> state; 0 is the root and 'no edge'."""
    edges, link, length, last = [{}], [-1], [0], 0
    for c in ids:
        cur = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in edges[p]:
            edges[p][c] = cur
            p = link[p]
        if p != -1:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.zeros((len(edges), width), np.uint16 if len(edges) < 65536 else np.int32)
    for s, out in enumerate(edges):
        for c, t in out.items():
            table[s, c] = t
    return table


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))


def normal(text: str | None, letter: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of the lower-cased text with one space for every run of other characters than letters."""
    text = text or ""
    if text.isascii():
        a = np.frombuffer(text.encode().translate(_ASCII), np.uint8)
        return a[np.concatenate([[True], (a[1:] != 32) | (a[:-1] != 32)])] if len(a) else a
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    a = np.where(letter[a], a, 32)
    a = a[np.concatenate([[True], (a[1:] != 32) | (a[:-1] != 32)])]
    return np.frombuffer(a.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)


def parse(lanes: np.ndarray, sizes: np.ndarray, follows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Phrases that begin in each lane (column of symbols; lanes are in order of falling size).  ``follows``: the lane of
    which a lane is the continuation, or -1."""
    flat, width = table.reshape(-1), table.shape[1]
    n = len(sizes)
    active = np.searchsorted(-sizes, -np.arange(len(lanes)), side="left")  # lanes longer than each row's place
    state, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
    begins = np.zeros(lanes.shape, bool)
    for c, m in enumerate(active.tolist()):
        if not m:
            break
        ch = lanes[c, :m]
        s = flat[state[:m] * width + ch].astype(np.int64)
        new = (s == 0) | (state[:m] == 0)  # no way on, or after a symbol that the reference lacks
        begins[c, :m] = new
        count[:m] += new
        miss = np.flatnonzero(s == 0)
        s[miss] = flat[ch[miss]]
        state[:m] = s
    end = state.copy()
    todo = np.flatnonzero(follows >= 0)
    told = np.full(n, -1, np.int64)  # the state that a lane was last entered with
    extra = np.zeros(n, np.int64)
    while len(todo):
        at, now = todo, end[follows[todo]].copy()
        told[at] = now
        extra[at] = 0
        end[at] = state[at]
        for c in range(len(lanes)):
            live = sizes[at] > c
            end[at[~live]] = now[~live]  # ended without meeting the first parse
            at, now = at[live], now[live]
            if not len(at):
                break
            ch = lanes[c, at]
            s = flat[now * width + ch].astype(np.int64)
            own = (s == 0) | (now == 0)
            extra[at] += own.astype(np.int64) - begins[c, at]
            s = np.where(s == 0, flat[ch], s)
            go = ~(own & begins[c, at])
            at, now = at[go], s[go]
        end[at] = now
        todo = np.flatnonzero((follows >= 0) & (told != end[follows]))
    return count + extra


class Model:
    """Automata of the languages' reference texts, over the bytes that occur in any of them (symbol 0: all others)."""

    def __init__(self, references: dict[str, str], size: int = 16_000, least: int = LEAST):
        letter = letters()
        texts = {k: normal(v.strip(), letter)[:size] for k, v in sorted(references.items())}
        texts = {k: t for k, t in texts.items() if (t != 32).sum() >= least}
        present = np.unique(np.concatenate([np.zeros(0, np.uint8), *texts.values()]))
        self.symbol = np.zeros(256, np.uint8 if len(present) < 256 else np.uint16)
        self.symbol[present] = 1 + np.arange(len(present))
        self.langs = list(texts)
        self.tables = [automaton(self.symbol[t].tolist(), len(present) + 1) for t in texts.values()]
        self.bits = [float(np.log2(max(2, len(t)))) for t in texts.values()]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases per normalised text and language, each weighed with its language's cost."""
        out = np.zeros((len(texts), len(self.langs)))
        blocks = [-(-len(t) // BLOCK) for t in texts]
        owner = np.repeat(np.arange(len(texts)), blocks)
        if not len(owner):
            return out
        starts = (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
        sizes = np.minimum(BLOCK, np.array([len(t) for t in texts])[owner] - starts)
        by = np.argsort(-sizes, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        lanes = np.zeros((len(by), int(sizes.max())), self.symbol.dtype)
        for k, (i, a, n) in enumerate(zip(owner[by].tolist(), starts[by].tolist(), sizes[by].tolist(), strict=True)):
            lanes[k, :n] = self.symbol[texts[i][a : a + n]]
        lanes = np.ascontiguousarray(lanes.T)
        follows = np.where(starts[by] > 0, place[np.maximum(by - 1, 0)], -1)
        for k, table in enumerate(self.tables):
            out[:, k] = np.bincount(owner[by], parse(lanes, sizes[by], follows, table), len(texts)) * self.bits[k]
        return out

    def predict(self, texts: list[str | None], letter: np.ndarray) -> tuple[list[str], list[float]]:
        """Language and score per text; ``und`` and 0 for null and for texts without a letter.  Ties: by name."""
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        ready = [normal(t, letter) for t in texts]
        known = [i for i, t in enumerate(ready) if (t != 32).any()] if self.langs else []
        size, part = 0, []
        for i in known:
            part.append((size // BATCH, i))
            size += len(ready[i])
        for _, group in groupby(part, key=lambda x: x[0]):
            at = [i for _, i in group]
            cost = self.phrases([ready[i] for i in at])
            best = cost.argmin(1)
            share = 1 / np.exp(-np.clip(0.1 * (cost - cost.min(1, keepdims=True)), 0, 700)).sum(1)
            for i, b, s in zip(at, best, share, strict=True):
                langs[i], scores[i] = self.langs[b], float(s)
        return langs, scores


def fit(docs: DataFrame, train: Column, size: int = 16_000, rows: int = 64) -> Model:
    """Learn from a bounded sample of labelled rows: at most ``rows`` per language (smallest id hash first), of which evenly
    long parts, ``size`` bytes together, make the language's reference.  Nothing else reads a part of a text."""
    ids = docs.where(train & F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    inner, outer = Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h", "doc_id"), Window.partitionBy("lang").orderBy("h", "doc_id")
    few = ids.withColumn("rn", F.row_number().over(inner)).where(F.col("rn") <= rows)  # a language's rows meet after this cut only
    few = few.withColumn("rn", F.row_number().over(outer)).where(F.col("rn") <= rows).select("lang", "doc_id", "h").distinct()
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(few), ["lang", "doc_id"])  # rows x languages ids
    picked: dict[str, list] = {}
    for r in texts.select("lang", "h", F.substring("text", 1, size).alias("text")).orderBy("lang", "h", "text").collect():
        picked.setdefault(r["lang"], []).append(r["text"] or "")
    joined = {}
    for lang, parts in picked.items():
        each = max(200, size // max(1, len(parts)))
        head = "\n".join(p[:each] for p in parts)
        joined[lang] = (head + "\n" + "\n".join(p[each:] for p in parts))[: 2 * size]
    return Model(joined, size)


def predictor(spark, model: Model):
    """A pandas UDF text -> struct(lang, score)."""
    shared, key = spark.sparkContext.broadcast(vars(model)), uuid.uuid4().hex

    @F.pandas_udf("lang string, score double")
    def predict(parts: pd.Series) -> pd.DataFrame:
        own = _once(shared, key)
        langs, scores = own[0].predict(parts.tolist(), own[1])
        return pd.DataFrame({"lang": langs, "score": scores})

    return predict


_cache: dict = {}


def _once(shared, key: str) -> tuple[Model, np.ndarray]:
    """The model, rebuilt from the broadcast plain arrays, and the table of letters: once per Python worker and broadcast.
    Workers outlive a query, so the cache holds the model of one ``key`` and forgets it at the next."""
    if key not in _cache:
        _cache.clear()
        model = Model.__new__(Model)
        vars(model).update(shared.value)
        _cache[key] = (model, letters())
    return _cache[key]


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.  Only rows outside the held-out fold teach; a table
    without labelled rows yields ``und`` throughout.  Null, empty and letterless texts are ``und`` with score 0; ties go to
    the first language by name; long texts are parsed whole; extra columns are never read; repeated rows agree."""
    held = in_fold("doc_id", 4, 2)
    model = fit(docs, ~held)
    shared, key = docs.sparkSession.sparkContext.broadcast(vars(model)), uuid.uuid4().hex

    def run(batches):
        for b in batches:
            own, letter = _once(shared, key)
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                langs, scores = own.predict(part.column("text").to_pylist(), letter)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows whose text is in a learned language (null, letterless and undecided texts go), columns unchanged and of any
    names.  Repeated rows share their fate; an empty table, or one that teaches no language, gives no rows."""
    model = fit(docs, F.lit(True))
    said = fresh("__said", docs)
    out = docs.withColumn(said, predictor(docs.sparkSession, model)(F.col("text")))
    return out.where((F.col(f"{said}.lang") != "und") & (F.col(f"{said}.score") >= least)).select(*own_columns(docs))
