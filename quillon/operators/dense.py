"""Dense vectors: encoder protocol, exact top-k search in blocks, pair scores, latent semantics."""

from __future__ import annotations

import time
import warnings
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import textnorm as T


class Encoder(Protocol):
    """What a dense model has to offer: a text column to a vector column."""

    def encode(self, text: Column) -> Column: ...


class HashedNgrams:
    """A deterministic stand-in for a learned encoder: signed character trigrams in ``dims`` buckets, length 1."""

    def __init__(self, dims: int = 64, batch: int = 512):
        self.dims, self.batch = dims, batch

    def encode(self, text: Column) -> Column:
        dims, batch = self.dims, self.batch

        @F.pandas_udf("array<float>")
        def run(parts: pd.Series) -> pd.Series:
            import zlib

            out = []
            for k in range(0, len(parts), batch):
                block = np.zeros((len(parts[k : k + batch]), dims), np.float32)
                for i, t in enumerate(parts[k : k + batch]):
                    t = f" {t or ''} "
                    for j in range(len(t) - 2):
                        h = zlib.crc32(t[j : j + 3].encode())
                        block[i, h % dims] += 1 if h >> 31 else -1
                norm = np.linalg.norm(block, axis=1, keepdims=True)
                out.extend(block / np.where(norm == 0, 1, norm))
            return pd.Series(out)

        return run(text)


def pair_scores(pairs: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Cosines of the given (query_id, doc_id) pairs only; queries and docs carry ``vector``."""
    rows = pairs.join(queries.select("query_id", F.col("vector").alias("qv")), "query_id").join(docs.select("doc_id", F.col("vector").alias("dv")), "doc_id")
    return rows.select("query_id", "doc_id", F.round(T.cosine(F.col("qv"), F.col("dv")), 6).alias("score"))


def topk(queries: DataFrame, docs: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """Exact k nearest documents by cosine for each query; ties by doc_id.

    Queries go out in blocks of at most ``block`` vectors (a proven bound); each task multiplies its documents with a
    block and keeps k rows per query, so at most partitions * k * queries rows meet the final window."""
    spark = docs.sparkSession
    rows = queries.select("query_id", "vector").where("vector IS NOT NULL").toLocalIterator()
    out, ids, vectors = None, [], []

    def search(ids, vectors):
        m = np.array(vectors, np.float64)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((list(ids), m / np.where(n == 0, 1, n)))

        def run(batches):
            ids, q = shared.value
            best = None
            for b in batches:
                if not b.num_rows:
                    continue
                keys = b.column(0).to_numpy(zero_copy_only=False)
                d = np.array(b.column(1).to_pylist(), np.float64)
                n = np.linalg.norm(d, axis=1, keepdims=True)
                s = np.round(q @ (d / np.where(n == 0, 1, n)).T, 6)
                pool = (np.broadcast_to(keys, s.shape), s) if best is None else (np.concatenate([best[0], np.broadcast_to(keys, s.shape)], 1), np.concatenate([best[1], s], 1))
                by = np.lexsort((pool[0], -pool[1]))[:, :k]
                best = np.take_along_axis(pool[0], by, 1), np.take_along_axis(pool[1], by, 1)
            if best is not None:
                m = best[0].shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids), m)), pa.array(best[0].ravel()), pa.array(best[1].ravel())], ["query_id", "doc_id", "score"])

        return docs.select(F.col("doc_id").cast("long"), "vector").where("vector IS NOT NULL").mapInArrow(run, "query_id long, doc_id long, score double")

    for r in rows:
        ids.append(r["query_id"])
        vectors.append(r["vector"])
        if len(ids) == block:
            part = search(ids, vectors)
            out = part if out is None else out.unionByName(part)
            ids, vectors = [], []
    if ids:
        part = search(ids, vectors)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def preview(vector: Column, n: int = 10) -> Column:
    """The first values as comma-separated text."""
    return F.array_join(F.transform(F.slice(vector, 1, n), lambda x: F.format_number(x.cast("double"), 4)), ",")


def similarity_table(pairs: DataFrame, encoder: Encoder, left: str = "original", right: str = "variant") -> DataFrame:
    """Cosine of the vectors of two text columns, beside the texts; null texts are encoded as the encoder does them."""
    rows = pairs.select(left, right, encoder.encode(F.col(left)).alias("__a"), encoder.encode(F.col(right)).alias("__b"))
    return rows.select(left, right, F.round(T.cosine(F.col("__a"), F.col("__b")), 6).alias("similarity"))


def batch_sweep(texts: DataFrame, make, column: str = "text", sizes: tuple[int, ...] = (32, 64, 128, 256)) -> list[dict]:
    """Seconds and rows a second of encoding all texts by ``make(batch size)``, one run per size after one to warm up."""
    n, out = texts.count(), []
    run = lambda size: texts.select(make(size).encode(F.col(column))).write.format("noop").mode("overwrite").save()
    run(sizes[0])
    for size in sizes:
        began = time.perf_counter()
        run(size)
        took = time.perf_counter() - began
        out.append({"batch": size, "rows": n, "seconds": took, "rows_per_second": n / took})
    return out


#: Terms up to which all products of terms are summed at once, so that the decomposition is exact after one pass.
EXACT = 4096
#: Vectors beside the wanted ones, and passes at most, of the iteration for larger vocabularies.
SPARE, PASSES = 32, 40


def sparse_rows(weights: DataFrame, key: str) -> DataFrame:
    """(key, cols, ws): one row per name, its terms in order."""
    rows = weights.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("col", "w"))).alias("xs"))  # one name's terms per row
    return rows.select(key, F.col("xs.col").cast("array<int>").alias("cols"), F.col("xs.w").alias("ws"))


def dense_parts(batches, size: int = 256):
    """Of every ``size`` rows of (key, cols, ws): the keys, the columns that they use, and their matrix over these."""
    for b in batches:
        for at in range(0, b.num_rows, size):
            part = b.slice(at, size)
            cols, ws = part.column(1), part.column(2)
            used, back = np.unique(cols.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            a = np.zeros((part.num_rows, len(used)))
            a[np.repeat(np.arange(part.num_rows), np.diff(cols.offsets.to_numpy())), back] = ws.flatten().to_numpy(zero_copy_only=False)
            yield part.column(0), used, a


def gram_product(rows: DataFrame, size: int, q: np.ndarray | None) -> np.ndarray:
    """A'A q (or A'A) of the rows, scaled to length 1.  Every task sums its own rows; blocks of the sums are added by block."""
    shared = rows.sparkSession.sparkContext.broadcast(q)
    width, block = size if q is None else q.shape[1], 64

    def run(batches):
        q, total = shared.value, np.zeros((size, width))
        for _, used, a in dense_parts(batches):
            norm = np.sqrt((a * a).sum(1, keepdims=True))
            a /= np.where(norm == 0, 1, norm)
            if q is None:
                total[np.ix_(used, used)] += a.T @ a
            else:
                total[used] += a.T @ (a @ q[used])
        for k in range(0, size, block):
            if total[k : k + block].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[k : k + block].tobytes()], pa.binary())], ["k", "p"])

    def add(batches):
        have = {}
        for b in batches:
            for k, p in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(p.as_buffer())
                have[k] = have[k] + x if k in have else x.copy()
        for k, x in have.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["k", "p"])

    out = np.zeros((size, width))
    for r in rows.mapInArrow(run, "k int, p binary").repartition("k").mapInArrow(add, "k int, p binary").toLocalIterator():
        out[r["k"] : r["k"] + block] = np.frombuffer(bytes(r["p"])).reshape(-1, width)
    shared.destroy()
    return out


def right_singular(rows: DataFrame, size: int, k: int) -> np.ndarray:
    """The leading k right singular vectors (size, k) of the rows, fewer if their rank is lower: a direction that no row has would
    be arbitrary.  Up to EXACT columns from all products of columns; beyond, by subspace iteration until the
    singular values stand still."""
    if size <= EXACT or k + SPARE >= size:
        values, v = np.linalg.eigh(gram_product(rows, size, None))
    else:
        q = np.linalg.qr(np.random.default_rng(42).normal(size=(size, k + SPARE)))[0]
        last = np.zeros(k)
        for _ in range(PASSES):
            z = gram_product(rows, size, q)
            t = q.T @ z
            values, u = np.linalg.eigh((t + t.T) / 2)
            v = q @ u
            if np.abs(values[-k:] - last).max() <= 1e-7 * values[-1]:
                break
            last, q = values[-k:], np.linalg.qr(z)[0]
        else:
            warnings.warn(f"the singular values still moved after {PASSES} passes", stacklevel=2)
    live = values[-k:] > max(values[-1], 1e-300) * size * np.finfo(float).eps
    return np.ascontiguousarray(v[:, -k:][:, live][:, ::-1])


def latent(index, dims: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Latent semantics: vectors (doc_id, vector, length 1) and the term projection (term, col, idf, vector).

    The vocabulary keeps the most frequent terms; names stay distributed, and the driver holds the projection."""
    spark, c = index.docs.sparkSession, index.config
    vocabulary = index.grams.groupBy("term").agg(F.sum("tf").alias("n")).orderBy(F.desc("n"), "term").limit(c.max_features)
    vocabulary = vocabulary.join(index.gram_idf, "term").withColumn("col", F.row_number().over(Window.orderBy("term")) - 1).cache()  # bounded by max_features
    size = vocabulary.count()
    w = index.grams.join(vocabulary, "term").select("doc_id", "col", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    rows = sparse_rows(w, "doc_id").cache()
    n = rows.count()
    v = right_singular(rows, size, max(1, min(dims or c.lsa_dims, n, size))) if size else np.zeros((0, 1))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * v.shape[1], pa.int32()), pa.array(v.ravel()))
    projection = spark.createDataFrame(pa.table({"col": pa.array(np.arange(size), pa.int32()), "vector": lists}))
    return projected(rows, v, "doc_id"), vocabulary.select("term", "col", "idf").join(projection, "col")


def projected(rows: DataFrame, vectors: np.ndarray, key: str) -> DataFrame:
    """(key, vector) of (key, cols, ws): weighted sums of the columns' vectors, scaled to length 1."""
    shared = rows.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        for keys, used, a in dense_parts(batches):
            x = a @ shared.value[used]
            norm = np.sqrt((x * x).sum(1, keepdims=True))
            x /= np.where(norm == 0, 1, norm)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([keys, lists], [key, "vector"])

    return rows.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, vector array<double>")


def project(weights: DataFrame, projection: DataFrame, key: str) -> DataFrame:
    """``projected`` for (key, col, w) and a projection (col, vector), which passes through the driver."""
    told = projection.select("col", "vector").toArrow()
    size = told.num_rows
    vectors = np.zeros((size, 1))
    if size:
        flat = told.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(size, -1)
        vectors = np.empty_like(flat)
        vectors[told.column("col").to_numpy()] = flat
    return projected(sparse_rows(weights, key), vectors, key)
