"""Token-ID output: canonical length-limited Huffman blocks with bit-offset checkpoints, decoded by table.

A folder of Parquet files holds one row with the code lengths (``part`` is -1; 1 to 16 bits per id, from the global
counts, compressed) and a row per block.  A block holds whole documents in order: magic, counts, the global position of its
first id, then doc_ids, a bit per document that has none, lengths, checkpoints (bit offset of every ``STRIDE``-th id)
and the code bits.  So the folder is all that decoding needs, and each block is decoded on its own.  Spark's
commit protocol makes a lost executor's half-written part vanish.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, release
from .wordids import coder

MAGIC, STRIDE, LIMIT = b"QTB2", 64, 16
#: Ids after which a block is closed (a longer document makes a longer block).
BLOCK_IDS = 1 << 16
#: Bytes of text that are encoded at once (a longer text: alone).
BATCH = 16 << 20


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits for the ids that occur (package-merge); others 0."""
    live = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(live) <= 1:
        out[live] = 1
        return out
    if len(live) > 1 << limit:
        raise ValueError("more ids than codes")
    live = live[np.argsort(counts[live], kind="stable")]
    weight = counts[live].astype(np.int64)
    n = len(live)
    # level by level: merge the coins with the packages of the level below; remember which were coins
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([weight, packages])
        by = np.argsort(both, kind="stable")
        levels.append(by < n)
        both = both[by]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * n - 2
    for coins in reversed(levels):
        k = int(coins[:take].sum())
        out[live[:k]] += 1
        take = 2 * (take - k)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then by id."""
    codes, code, before = np.zeros(len(lengths), np.uint32), 0, 0
    by = np.lexsort((np.arange(len(lengths)), lengths))
    by = by[lengths[by] > 0]
    for n in range(1, LIMIT + 1):
        of = by[lengths[by] == n]
        code <<= n - before
        codes[of] = code + np.arange(len(of), dtype=np.uint32)
        code, before = code + len(of), n
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Code bits of the ids, high bit first, and the bit offset of every STRIDE-th id."""
    n = lengths[ids].astype(np.int64)
    end = np.cumsum(n)
    start = end - n
    total = int(end[-1]) if len(end) else 0
    words = np.zeros(total // 32 + 2, np.uint64)
    if len(ids):
        w = start >> 5
        placed = codes[ids].astype(np.uint64) << (64 - (start & 31) - n).astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        merged = np.add.reduceat(placed, first)  # bits of one word never overlap, so sums are unions
        at = w[first]
        words[at] += merged >> np.uint64(32)
        words[at + 1] += merged & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").tobytes(), start[::STRIDE].astype("<u8")


def unpack(bits: bytes, n: int, checkpoints: np.ndarray, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Decode from all checkpoints side by side, one table look-up per id."""
    raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
    window = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    at = checkpoints.astype(np.int64)
    out = np.zeros((STRIDE, len(at)), symbols.dtype)
    for k in range(min(STRIDE, n)):
        live = len(at) if k < n - (len(at) - 1) * STRIDE else len(at) - 1
        pos = at[:live]
        peek = (window[pos >> 3] >> (8 - (pos & 7)).astype(np.uint32)) & 0xFFFF
        out[k, :live] = symbols[peek]
        at[:live] += sizes[peek]
    return out.T.reshape(-1)[:n]


def decode_tables(lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every 16-bit look-ahead: the id and its code's size."""
    symbols, sizes = np.zeros(1 << LIMIT, np.uint16), np.zeros(1 << LIMIT, np.uint8)
    by = np.flatnonzero(lengths)
    by = by[np.lexsort((by, lengths[by]))]
    reps = 1 << (LIMIT - lengths[by].astype(np.int64))
    full = int(reps.sum())
    symbols[:full] = np.repeat(by, reps).astype(np.uint16)
    sizes[:full] = np.repeat(lengths[by], reps)
    return symbols, sizes


def write_block(base: int, doc_ids: np.ndarray, none: np.ndarray, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    bits, marks = pack(ids, lengths, codes)
    head = MAGIC + struct.pack("<QIII", base, len(doc_ids), len(ids), len(bits))
    return head + doc_ids.astype("<i8").tobytes() + np.packbits(none).tobytes() + sizes.astype("<u4").tobytes() + marks.tobytes() + bits


def read_block(data: bytes, symbols: np.ndarray, table: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First position, doc_ids, which documents have none, lengths and ids of a block."""
    if data[:4] != MAGIC:
        raise ValueError("not a token block")
    base, docs, n, size = struct.unpack_from("<QIII", data, 4)
    at = 24
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    at += 8 * docs
    none = np.unpackbits(np.frombuffer(data, np.uint8, -(-docs // 8), at), count=docs).astype(bool)
    at += -(-docs // 8)
    sizes = np.frombuffer(data, "<u4", docs, at)
    at += 4 * docs
    marks = np.frombuffer(data, "<u8", -(-n // STRIDE), at)
    return base, doc_ids, none, sizes, unpack(data[at + 8 * len(marks) :][:size], n, marks, symbols, table)


def places(cuts: np.ndarray, keys: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """Partition of each (key, salt): ranges of keys; a key that fills several ranges is dealt to them by its salt's order."""
    low = np.searchsorted(cuts, keys)
    wide = np.searchsorted(cuts, keys, side="right") - low
    return (low + ((salts >> np.uint64(32)).astype(np.int64) * wide >> 32)).astype(np.int32)


def encode_table(docs: DataFrame, path: str, end: int = 1) -> str:
    """Write the ids of all documents, in ascending order of doc_id, as coded blocks; return the folder.

    Rows without a doc_id come first; rows of one doc_id follow by a hash of their ids.  Texts are encoded first, so that only
    ids are moved and sorted.  Ranges are cut at quantiles of doc_id, which cost a scan of that column; a range
    exchange would sample the encoded rows and so encode every text twice.  An id that fills several ranges is split by the hash.
    The driver receives the cuts and one count per id of the vocabulary.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    steps = [(k + 1) / n for k in range(n - 1)]
    cuts = docs.agg(F.percentile_approx(F.coalesce("doc_id", F.lit(-(2**63))), steps, max(10_000, 20 * n)).alias("c")).first()["c"] if n > 1 else None
    cuts = np.array(sorted(cuts or []), np.int64)  # one per partition at most

    def ids_of(batches):
        words, tail = coder(path), np.array([end], "<u2").tobytes()
        for b in batches:
            step = max(1, min(4096, BATCH * b.num_rows // max(1, b.nbytes)))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                keys = part.column(0).fill_null(-(2**63)).to_numpy()
                ids = [x + tail for x in words.encode(part.column(1))]
                salts = np.array([xxhash.xxh64_intdigest(x) for x in ids], np.uint64)
                none = part.column(0).is_null()
                salts[(keys == -(2**63)) & ~none.to_numpy(zero_copy_only=False)] = np.iinfo(np.uint64).max  # a real id of that value: after the nulls
                yield pa.RecordBatch.from_arrays([pa.array(places(cuts, keys, salts)), pa.array(keys), none, pa.array((salts >> np.uint64(1)).astype(np.int64)), pa.array(ids, pa.binary())], ["part", "key", "none", "salt", "ids"])

    coded = docs.select("doc_id", "text").mapInArrow(ids_of, "part int, key long, none boolean, salt long, ids binary")
    coded = coded.repartitionById(n, "part").sortWithinPartitions("key", F.desc("none"), "salt", "ids").select("key", "none", "ids")

    def blocks_of(batches):
        """Gather documents into blocks; ``first`` counts the partition's ids before the block."""
        before, held, size = 0, [], 0

        def flush():
            ids = b"".join(x for *_, x in held)
            keys = np.array([k for k, *_ in held], "<i8").tobytes()
            none = np.array([v for _, v, _ in held], np.uint8).tobytes()
            sizes = np.array([len(x) // 2 for *_, x in held], "<u4").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([before]), pa.array([len(ids) // 2]), pa.array([keys], pa.binary()), pa.array([none], pa.binary()), pa.array([sizes], pa.binary()), pa.array([ids], pa.binary())], ["first", "n", "doc_ids", "none", "sizes", "ids"])

        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in range(3)], strict=True):
                held.append(row)
                size += len(row[2]) // 2
                if size >= BLOCK_IDS:
                    yield flush()
                    before, held, size = before + size, [], 0
        if held:
            yield flush()

    raw = coded.mapInArrow(blocks_of, "first long, n long, doc_ids binary, none binary, sizes binary, ids binary").withColumn("part", F.spark_partition_id())
    raw = materialise(raw, "ids")

    def count(batches):
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount(np.frombuffer(x.as_py(), "<u2"), minlength=1 << 16)
        live = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array(total[live], pa.int64())], ["id", "n"])

    counts = np.zeros(1 << 16, np.int64)
    for r in raw.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most 65,536 rows
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    parts = raw.groupBy("part").agg(F.sum("n").alias("n"))  # one row per partition
    offsets = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def write(batches):
        codes = canonical(lengths)
        for b in batches:
            out = []
            for base, first, keys, none, sizes, ids in zip(*[b.column(c).to_pylist() for c in ("base", "first", "doc_ids", "none", "sizes", "ids")], strict=True):
                out.append(write_block(base + first, np.frombuffer(keys, "<i8"), np.frombuffer(none, np.uint8), np.frombuffer(sizes, "<u4"), np.frombuffer(ids, "<u2"), lengths, codes))
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("first"), pa.array(out, pa.binary())], ["part", "first", "block"])

    files = raw.join(F.broadcast(offsets), "part").select("part", "base", "first", "doc_ids", "none", "sizes", "ids").mapInArrow(write, "part int, first long, block binary")
    head = spark.createDataFrame([(-1, 0, bytearray(zlib.compress(lengths.tobytes())))], files.schema)
    files = materialise(head.unionByName(files), "tokens")
    release(raw)
    return files._quillon_path


def decode_table(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files of a folder alone."""
    files = spark.read.schema("part int, first long, block binary").parquet(folder)
    lengths = np.frombuffer(zlib.decompress(files.where("part = -1").first()["block"]), np.uint8)

    def read(batches):
        symbols, table = decode_tables(lengths, canonical(lengths))
        for b in batches:
            for x in b.column(0):
                base, keys, none, sizes, ids = read_block(x.as_py(), symbols, table)
                wide = ids.astype("<u4").tobytes()
                stop = np.cumsum(sizes.astype(np.int64))
                start = stop - sizes
                crc = [zlib.crc32(wide[4 * a : 4 * z]) for a, z in zip(start.tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, mask=none), pa.array(base + start), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.where("part >= 0").select("block").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10(docs: DataFrame, path: str) -> DataFrame:
    """Encode, write, read back from the folder.  Null and empty texts have the end id alone; null ids come first; rows
    equal in doc_id follow by a hash of their ids, so equal rows are next to each other; an empty table gives no rows;
    very long texts make long blocks; other columns are never read."""
    return decode_table(docs.sparkSession, encode_table(docs, path))
