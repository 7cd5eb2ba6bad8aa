"""Hilbert-curve sharding (native): quantise metadata, sort by curve index, cut equal runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, numbered, release


def _proxy(df: DataFrame, name: str, skip: int) -> Column:
    """An order-preserving number: numeric columns as double, others by six bytes after the common prefix."""
    if isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType)):
        return F.col(f"`{name}`").cast("double")
    if isinstance(df.schema[name].dataType, (T.TimestampType, T.DateType)):
        return F.unix_micros(F.col(f"`{name}`").cast("timestamp")).cast("double")
    text = F.encode(F.col(f"`{name}`").cast("string"), "UTF-8")
    return F.conv(F.rpad(F.hex(F.substring(text, skip + 1, 6)), 12, "0"), 16, 10).cast("double")


def _common_prefix(low: str | None, high: str | None) -> int:
    """Bytes that all strings between the smallest and the largest one share."""
    a, b = (low or "").encode(), (high or "").encode()
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _edges_below(edges: list[float], value: Column) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda edge: edge < value)) if edges else F.lit(0)


def quantise(df: DataFrame, dims: list[str], bits: int) -> dict[str, Column]:
    """Grid coordinates 0 .. 2**bits-1 per dimension, cut at approximate quantiles of the whole table.

    The driver receives at most 2**bits-1 cut points per dimension.  Null gets coordinate 0.
    """
    strings = [d for d in dims if isinstance(df.schema[d].dataType, T.StringType)]
    skip = {}
    if strings:
        row = df.agg(*[f(F.col(f"`{d}`")).alias(f"{k}{i}") for i, d in enumerate(strings) for k, f in (("lo", F.min), ("hi", F.max))]).first()
        skip = {d: _common_prefix(row[f"lo{i}"], row[f"hi{i}"]) for i, d in enumerate(strings)}
    proxies = {d: _proxy(df, d, skip.get(d, 0)) for d in dims}
    steps = [(k + 1) / 2**bits for k in range(2**bits - 1)]
    cuts = df.agg(*[F.percentile_approx(proxies[d], steps, 10_000).alias(f"c{i}") for i, d in enumerate(dims)]).first()
    out = {}
    for i, d in enumerate(dims):
        edges = sorted(set(cuts[f"c{i}"] or []))
        at = _edges_below(edges, proxies[d])
        out[d] = F.when(F.col(f"`{d}`").isNull(), 0).otherwise(at).cast("long")
    return out


def hilbert_index(coordinates: Column, n: int, bits: int) -> Column:
    """Distance along the Hilbert curve of an array of ``n`` coordinates of ``bits`` bits (Skilling's transpose)."""
    one = F.lit(1).cast("long")

    def bit(level):  # 2**level
        return F.call_function("shiftleft", one, level)

    def unwind(x, level):
        mask = bit(level) - 1

        def axis(x, i):
            hit = x[i].bitwiseAND(bit(level)) != 0
            swap = F.when(hit, F.lit(0)).otherwise(x[0].bitwiseXOR(x[i]).bitwiseAND(mask))
            return F.transform(x, lambda v, j: F.when(hit, F.when(j == 0, v.bitwiseXOR(mask)).otherwise(v)).otherwise(F.when((i > 0) & ((j == 0) | (j == i)), v.bitwiseXOR(swap)).otherwise(v)))

        return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), x, axis)

    levels = F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1)) if bits > 1 else F.array().cast("array<int>")
    x = F.aggregate(levels, coordinates, unwind)
    gray = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.aggregate(F.slice(x, 1, i + 1), F.lit(0).cast("long"), lambda a, v: a.bitwiseXOR(v)))

    def flip(x):
        t = F.aggregate(levels, F.lit(0).cast("long"), lambda a, q: F.when(F.element_at(x, -1).bitwiseAND(bit(q)) != 0, a.bitwiseXOR(bit(q) - 1)).otherwise(a))
        return F.transform(F.array(t), lambda t: F.transform(x, lambda v: v.bitwiseXOR(t)))[0]

    def weave(x):
        places = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
        return F.aggregate(places, F.lit(0).cast("long"), lambda h, q: F.aggregate(x, h, lambda h, v: h * 2 + F.when(v.bitwiseAND(bit(q)) != 0, 1).otherwise(0)))

    return F.transform(F.array(gray), lambda g: F.transform(F.array(flip(g)), weave)[0])[0]


def hilbert_shards(df: DataFrame, dims: list[str], shards: int, bits: int = 5, carry: dict[str, Column] | None = None, ties: list[str] | None = None) -> DataFrame:
    """Cut the table into ``shards`` runs of the Hilbert order whose row counts differ by at most one.

    ``dims``: metadata columns to quantise (null: first cell); ``carry``: columns to return, by name;
    ``ties``: carried columns that order rows of one cell.  Adds ``curve`` (long), ``shard`` (int) and
    ``slot`` (long, gapless from 0 within a shard).  An empty table gives no rows; rows equal in the curve
    index and every tie column may swap slots among themselves.  The rank is global: no cell, however
    full, lies in one task, as range partitions also split at the tie columns.
    """
    at = quantise(df, dims, bits)
    curve = hilbert_index(F.array(*at.values()), len(dims), bits)
    out = list((carry or {}).items())
    base = df.select(curve.alias("curve"), *[c.alias(k) for k, c in out])
    base = materialise(base, "curve")  # a range exchange samples its input, which would compute every curve index twice
    ranked = numbered(base, ["curve", *(ties or [])], "hilbert")
    release(base)
    shard = F.expr(f"_rank * {shards} div _total")
    start = F.expr(f"(shard * _total + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("_rank") - start).withColumn("shard", F.col("shard").cast("int")).drop("_rank", "_total")


def zone_map(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """Smallest and largest value of each column per shard: what a reader prunes files by.  Nulls are passed over (a shard of
    nulls alone has null bounds); an empty table has no shards."""
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), *[f(F.col(c)).alias(f"{k}_{c}") for c in columns for k, f in (("min", F.min), ("max", F.max))])
