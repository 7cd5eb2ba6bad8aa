"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into m segments.  Every distinct fingerprint is entered, per segment, under each value of the
radius-1 Hamming ball around the segment; two segments within distance 2 always share such a value.  So two
fingerprints that differ in at most 3 m - 1 bits meet under some value, where all 64 bits are verified.  What
comes out is a spanning forest of the verified links per table entry, so no link is lost and no group is spelled
out as pairs.  Two segments serve a radius of 4 or 5; four segments a radius of up to 11, with fuller entries.

The pipeline's stage finds its first candidates in the same tables and decides on exact similarities of shingle sets.  Similar
sets can differ in more bits than the tables reach, so minima of the sets in bands find what is still apart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, own_columns, release
from .graph import components

RADIUS = 4
#: Differing bits up to which two segments find every pair, which the pipeline's stage uses whole.
REACH = 5
#: Minima of the shingle set in a band, and bands: a pair at a Jaccard similarity of 0.8 shares no band with chance (1 - 0.8^4)^24 = 3e-6.
ROWS, BANDS = 4, 24
#: Counters of the sketch that tells rare shingles from common ones; it orders, and so only speed depends on it.
COUNTERS = 1 << 18


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles, repeats included, A-Z lower-cased; of all words, if they are fewer."""
    words = (text or "").encode().lower().split()  # bytes.lower() and bytes.split() know ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    digest = xxhash.xxh64_intdigest
    starts = [0, *[e + 1 for e in ends[:-shingle]]]
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :], strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero for none."""
    bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # long texts in bounded pieces
        h = hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(h, axis=1).sum(0, dtype=np.int64) if len(h) < 256 else _column_sums(h)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int) -> int:
    """64-bit SimHash as an unsigned integer."""
    return majority(shingle_hashes(text, shingle))


def _column_sums(h: np.ndarray) -> np.ndarray:
    """Sums of the 64 bit columns by counting byte values, which beats unpacking for many rows."""
    out = np.empty(64, np.int64)
    table = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
    for k in range(8):
        out[8 * k : 8 * k + 8] = np.bincount(h[:, k], minlength=256) @ table
    return out


def fingerprints(shingle: int):
    """A pandas UDF text -> fingerprint as a signed long (the same 64 bits)."""
    @F.pandas_udf("long")
    def run(parts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in parts], np.uint64).view(np.int64))

    return run


def band_keys(shingles: np.ndarray) -> list[int]:
    """Keys of the bands of a set of hashes (signed): sets that share a key share ROWS minima under random maps."""
    if not len(shingles):
        return []
    r = np.random.default_rng(8)
    factor = r.integers(0, 1 << 63, (ROWS * BANDS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
    shift = r.integers(0, 1 << 63, (ROWS * BANDS, 1), np.uint64)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max)
    for k in range(0, len(shingles), 2048):  # long texts in bounded pieces
        h = shingles[None, k : k + 2048] * factor + shift
        least = np.minimum(least, (h ^ (h >> np.uint64(32))).min(1))
    keys = [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def shingle_sets(shingle: int):
    """A pandas UDF text -> struct(node, fp, bands): the hash of its set of shingles, the set's fingerprint, and its band keys."""

    @F.pandas_udf("node long, fp long, bands array<long>")
    def run(parts: pd.Series) -> pd.DataFrame:
        sets = [np.unique(shingle_hashes(t, shingle)) for t in parts]
        nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
        return pd.DataFrame({"node": nodes, "fp": np.array([majority(s) for s in sets], np.uint64).view(np.int64), "bands": [band_keys(s) for s in sets]})

    return run


def similar(least: float):
    """A pandas UDF (set, set, id of the right set): whether two sets of shingles, as sorted distinct 64-bit hashes, have a
    Jaccard similarity of ``least`` or more, counted exactly; two empty sets are equal.  Rows in a run with the same right set,
    as a sort leaves them, are counted together, in bounded pieces."""

    def count(many: list[np.ndarray], one: np.ndarray) -> np.ndarray:
        sizes = np.array([len(x) for x in many])
        if not len(one) or not sizes.sum():
            return np.zeros(len(many), np.int64)
        flat = np.concatenate(many)
        hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
        return np.bincount(np.repeat(np.arange(len(many)), sizes), hit, len(many)).astype(np.int64)

    @F.pandas_udf("boolean")
    def run(left: pd.Series, right: pd.Series, key: pd.Series) -> pd.Series:
        sets = [np.frombuffer(x, np.uint64) for x in left]
        sizes = np.array([len(x) for x in sets], np.int64)
        out = np.zeros(len(sets), bool)
        k = key.to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        for a, z in zip(cuts, [*cuts[1:], len(k)], strict=True):
            one = np.frombuffer(right.iloc[a], np.uint64)
            for c in range(a, z, 256):
                d = min(z, c + 256)
                both = count(sets[c:d], one)
                out[c:d] = both >= least * (sizes[c:d] + len(one) - both)
        return pd.Series(out)

    return run


def packed_sets(shingle: int):
    """A pandas UDF text -> its sorted distinct shingle hashes as bytes."""

    @F.pandas_udf("binary")
    def run(parts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, shingle)).tobytes() for t in parts])

    return run


def ball(segment: Column, bits: int) -> Column:
    """The values within one bit of a segment (as a long)."""
    return F.transform(F.sequence(F.lit(-1), F.lit(bits - 1)), lambda k: F.when(k < 0, segment).otherwise(segment.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))))


def entries(distinct: DataFrame, segments: int) -> DataFrame:
    """Table rows (key, fp, fp2): segment number and ball value in the key."""
    bits = 64 // segments
    cut = [F.shiftrightunsigned("fp", bits * k).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(segments)]
    balls = [F.transform(ball(c, bits), _numbered(k, bits)) for k, c in enumerate(cut)]
    return distinct.select("fp", "fp2", F.explode(F.concat(*balls)).alias("key"))


def _numbered(k: int, bits: int):
    return lambda v: v + F.lit(k << bits)


def linked(fp: np.ndarray, fp2: np.ndarray, i, others, radius: int, wide: int) -> np.ndarray:
    """Whether row(s) ``i`` link to ``others``: at most ``radius`` differing bits, and ``wide`` over both fingerprints."""
    d = np.bitwise_count(fp[i] ^ fp[others])
    return (d <= radius) & (d.astype(np.int64) + np.bitwise_count(fp2[i] ^ fp2[others]) <= wide)


def spanning(fp: np.ndarray, fp2: np.ndarray, radius: int, wide: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the distinct fingerprints of one entry: a row at a time, so memory grows with
    the entry and not with its pairs, and a row whose partners are all in its class already adds nothing."""
    n = len(fp)
    label, out = np.arange(n), []
    for i in range(n - 1):
        near = i + 1 + np.flatnonzero(linked(fp, fp2, i, slice(i + 1, n), radius, wide))
        near = near[label[near] != label[i]]
        if len(near):
            _, first = np.unique(label[near], return_index=True)
            for j in near[first]:
                out.append((i, int(j)))
                label[label == label[j]] = label[i]
    return out


def links(distinct: DataFrame, radius: int = RADIUS, segments: int = 2, wide: int = 128) -> DataFrame:
    """Edges (u, v) between distinct fingerprints whose transitive closure is that of all links."""
    if radius > 3 * segments - 1 or 64 % segments:
        raise ValueError("so many segments don't find all links of this radius")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = distinct if "fp2" in distinct.columns else distinct.withColumn("fp2", F.lit(0).cast("long"))
    laid = entries(distinct, segments).repartition(n, "key").sortWithinPartitions("key", "fp")

    def run(batches):
        none = np.zeros(0, np.uint64)
        keep_key, keep, keep2 = None, none, none  # the entry that the last batch left open

        def close(key, fp, fp2):
            cut = np.flatnonzero(np.diff(key)) + 1
            first = np.concatenate([[0], cut])
            size = np.diff(np.concatenate([first, [len(key)]]))
            pair = first[size == 2]  # most entries: at once
            near = pair[linked(fp, fp2, pair, pair + 1, radius, wide)]
            u, v = [fp[near]], [fp[near + 1]]
            for a, m in zip(first[size > 2], size[size > 2], strict=True):
                e = np.array(spanning(fp[a : a + m], fp2[a : a + m], radius, wide), np.int64).reshape(-1, 2)
                u.append(fp[a + e[:, 0]])
                v.append(fp[a + e[:, 1]])
            e = np.unique(np.stack([np.concatenate(u), np.concatenate(v)], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy().view(np.int64)), pa.array(e[:, 1].copy().view(np.int64))], ["u", "v"])

        for b in batches:
            key = b.column("key").to_numpy()
            fp, fp2 = b.column("fp").to_numpy().view(np.uint64), b.column("fp2").to_numpy().view(np.uint64)
            if not len(key):
                continue
            if keep_key is not None:
                key, fp, fp2 = np.concatenate([np.full(len(keep), keep_key), key]), np.concatenate([keep, fp]), np.concatenate([keep2, fp2])
            last = np.searchsorted(key, key[-1])
            keep_key, keep, keep2 = key[-1], fp[last:], fp2[last:]
            if last:
                yield close(key[:last], fp[:last], fp2[:last])
        if keep_key is not None:
            yield close(np.full(len(keep), keep_key), keep, keep2)

    return laid.select("key", "fp", "fp2").mapInArrow(run, "u long, v long").distinct()


def classes(marked: DataFrame, radius: int = RADIUS, segments: int = 2, wide: int = 128) -> DataFrame:
    """``fp``, ``component_id`` (smallest doc_id reachable over links) for every distinct fingerprint of (doc_id, fp[, fp2])."""
    second = F.min("fp2") if "fp2" in marked.columns else F.lit(0).cast("long")
    own = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), second.alias("fp2")), "fp")  # exact copies combine before the shuffle
    found = components(links(own.select("fp", "fp2"), radius, segments, wide))
    near = own.join(found, own.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    near = materialise(near, "roots")
    best = near.groupBy("root").agg(F.min("least").alias("component_id"))
    return near.join(best, "root").select("fp", "component_id")


def op8(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint (hex), component_id per row.  Null and wordless texts have fingerprint zero, which links
    like any other.  Rows with equal fingerprints share a component; a null doc_id never names one unless it is alone."""
    marked = materialise(docs.select("doc_id", fingerprints(shingle)(F.col("text")).alias("fp")), "marked")
    found = classes(marked)
    return marked.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def fingerprint_pairs(marked: DataFrame) -> DataFrame:
    """Pairs (u, v), u < v, of the nodes of (node, fp): candidates from the multi-index tables.  What they join is what all pairs with
    REACH or fewer differing bits join; of the nodes of one fingerprint the smallest stands for it."""
    own = materialise(marked.groupBy("fp").agg(F.min("node").alias("first")), "fp")
    left, right = own.select(F.col("fp").alias("u"), F.col("first").alias("a")), own.select(F.col("fp").alias("v"), F.col("first").alias("b"))
    near = links(own.select("fp"), REACH).join(left, "u").join(right, "v").select("a", "b")
    same = marked.join(own, "fp").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    out = materialise(near.unionByName(same).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "near")
    release(own)
    return out


def sets_of(nodes: DataFrame, laid: DataFrame, shingle: int) -> DataFrame:
    """``nodes`` with their shingle sets, made anew from a text of each."""
    found = laid.select("node", "text").join(nodes, "node").dropDuplicates(["node"])
    return materialise(found.select(*nodes.columns, packed_sets(shingle)("text").alias("set")), "sets")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) of nodes whose sets are similar by ``least`` at least."""
    left, right = sets.select(F.col("node").alias("u"), F.col("set").alias("a")), sets.select(F.col("node").alias("v"), F.col("set").alias("b"))
    return materialise(pairs.join(left, "u").join(right, "v").where(similar(least)("a", "b", "v")).select("u", "v"), "links")


def common_shingles(sets: DataFrame) -> np.ndarray:
    """How often shingles occur in the sets, by a sketch of COUNTERS counters (what the driver receives at most)."""

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount(np.frombuffer(x.as_py(), np.uint64) & np.uint64(COUNTERS - 1), minlength=COUNTERS)
        live = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array(total[live])], ["at", "n"])

    got = sets.select("set").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(COUNTERS, np.int64)
    out[got["at"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def prefix_pairs(sets: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) of nodes in different components that may be similar: every similar pair is among them.

    With shingles in one order for all sets, two similar sets share one of their first n - ceil(least n) + 1 shingles, and at
    the first that they share enough must be left in both (prefix and position filter).  Rare shingles come first, so sets that
    differ from all others in many shingles of their own meet nobody, however large a group of near copies they are in."""
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = sets.sparkSession.sparkContext.broadcast(common_shingles(sets))

    def index(batches):
        often = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                cols = [[], [], [], [], []]
                for node, comp, x in zip(*[part.column(c).to_pylist() for c in ("node", "comp", "set")], strict=True):
                    s = np.frombuffer(x, np.uint64)
                    k = len(s) - int(np.ceil(least * len(s) - 1e-9)) + 1 if len(s) else 0
                    first = s[np.lexsort((s, often[s & np.uint64(COUNTERS - 1)]))[:k]]
                    for c, v in zip(cols, (first.view(np.int64), np.full(len(first), node), np.full(len(first), comp), np.full(len(first), len(s)), np.arange(len(first))), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t)) for c, t in zip(cols, ("i8", "i8", "i8", "i4", "i4"), strict=True)], ["token", "node", "comp", "size", "pos"])

    def meet(batches):
        names = ("token", "node", "comp", "size", "pos")
        held = None  # the token that the last batch left open

        def pairs(g):
            token, node, comp, size, pos = g
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            split = np.minimum.reduceat(comp, first) != np.maximum.reduceat(comp, first)
            ends = np.append(first[1:], len(token))
            for a, z in zip(first[split].tolist(), ends[split].tolist(), strict=True):
                for i in range(a, z, 512):  # a block of rows against those after them
                    one, two = slice(i, min(z, i + 512)), slice(i, z)
                    sx, sy = size[one, None], size[None, two]
                    rest = 1 + np.minimum(sx - pos[one, None], sy - pos[None, two]) - 1
                    ok = (comp[one, None] != comp[None, two]) & (np.arange(i, min(z, i + 512))[:, None] < np.arange(i, z)[None])
                    ok &= (np.minimum(sx, sy) >= least * np.maximum(sx, sy) - 1e-9) & (rest >= least / (1 + least) * (sx + sy) - 1e-9)
                    u, v = np.nonzero(ok)
                    x, y = node[i + u], node[i + v]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["u", "v"])

        for b in batches:
            g = [b.column(c).to_numpy() for c in names]
            if not len(g[0]):
                continue
            if held is not None:
                g = [np.concatenate(x) for x in zip(held, g, strict=True)]
            last = int(np.argmax(g[0] == g[0][-1]))  # rows are sorted by token
            held = [x[last:] for x in g]
            if last:
                yield from pairs([x[:last] for x in g])
        if held is not None:
            yield from pairs(held)

    laid = sets.select("node", "comp", "set").mapInArrow(index, "token long, node long, comp long, size int, pos int")
    return laid.repartition(n, "token").sortWithinPartitions("token").mapInArrow(meet, "u long, v long").distinct()


def set_classes(laid: DataFrame, shingle: int, least: float) -> DataFrame:
    """``node``, ``root`` for the nodes of (node, fp, bands, text) that are linked to another.  Candidates come from the multi-index
    tables of fingerprints, and share a band key where similar sets differ in more bits than those reach.

    Besides its pairs of fingerprints every node is first compared with one other, the node that leads most of its keys, which joins groups of near copies
    in as many comparisons as rows; a key is led by the node that meets most others, as the text does that the others
    were copied from.  What then still lies in different components under some key goes through
    ``prefix_pairs``, which misses no similar pair of theirs."""
    near = fingerprint_pairs(laid.select("node", "fp").distinct())
    entries = materialise(laid.select("node", "bands").dropDuplicates(["node"]).select("node", F.explode("bands").alias("key")), "entries")
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialise(entries.join(sizes, "key"), "met")
    release(entries)
    degree = met.groupBy("node").agg(F.sum("n").alias("degree"))
    bare, met = met, materialise(met.join(degree, "node").select("key", "node", "degree"), "degrees")
    release(bare)
    leads = met.groupBy("key").agg(F.max_by("node", F.struct("degree", "node")).alias("lead"))
    votes = met.join(leads, "key").where("node != lead").groupBy("node", "lead").agg(F.count(F.lit(1)).alias("n"))
    votes = votes.groupBy("node").agg(F.max_by("lead", F.struct("n", "lead")).alias("lead"))
    tried = materialise(near.unionByName(votes.select(F.least("lead", "node").alias("u"), F.greatest("lead", "node").alias("v"))).distinct(), "tried")
    release(near)
    sets = sets_of(tried.select(F.col("u").alias("node")).union(tried.select("v")).distinct(), laid, shingle)
    links = verified(tried, sets, least)
    release(sets)
    found = materialise(components(links), "found")
    told = materialise(met.join(found, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp")), "told")
    release(met)
    split = told.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi")
    sets = sets_of(told.join(split.select("key"), "key", "left_semi").select("node", "comp").distinct(), laid, shingle)
    more = materialise(prefix_pairs(sets, least).join(tried, ["u", "v"], "left_anti"), "pairs")
    out = components(links.unionByName(verified(more, sets, least)))
    for used in (tried, found, told, sets, more):
        release(used)
    return out


def keep_one(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each component: that of the smallest doc_id (rows equal in doc_id and shingles: any one), with the
    columns of ``docs``.  A link is an exact Jaccard similarity of ``least`` or more of the sets of five-word shingles
    (a text of fewer words is one shingle; null, empty and wordless texts have none and are copies of each other).
    A null id stays only if no other id is in the class.  An empty table gives no rows; column names of any kind may
    occur, as private ones avoid them."""
    f, node, root = (fresh(x, docs) for x in ("__sets", "__node", "__id"))
    wide = materialise(docs.withColumn(f, shingle_sets(shingle)(F.col("text"))), "wide")
    at = F.col(f"{f}.node")
    laid = wide.select(at.alias("node"), F.col(f"{f}.fp").alias("fp"), F.col(f"{f}.bands").alias("bands"), "text")
    found = set_classes(laid, shingle, least)
    marked = wide.select("doc_id", at.alias("node"))
    own = marked.groupBy("node").agg(F.min("doc_id").alias("least"))  # exact copies combine before the shuffle
    near = materialise(own.join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "roots")
    best = near.groupBy("root").agg(F.min("least").alias("component_id"))
    # one node per class: an id repeated under several near texts leaves the smallest; ids that are all null
    # name no class, so there each node stays
    stay = marked.distinct().join(near.join(best, "root").select("node", "component_id"), "node").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    key = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("node"), F.col("node").cast("string")))
    stay = stay.groupBy(key.alias("key")).agg(F.min("node").alias(node), F.min("component_id").alias(root)).drop("key")
    kept = wide.join(stay, (at == F.col(node)) & F.col("doc_id").eqNullSafe(F.col(root)), "left_semi")
    return kept.withColumn(node, at).dropDuplicates(["doc_id", node]).select(*own_columns(docs))
