"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, byte fallback, white-space marker."""

from __future__ import annotations

import heapq
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
#: Piece types of a SentencePiece model file (fixed values).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: An unknown character scores this much less than the worst piece (fixed value).
PENALTY = 10.0
CACHE, LONGEST = 400_000, 64


def load(path: str) -> dict:
    """Pieces, types and log scores of a model file.  A BPE file ranks its pieces; as log scores they get Zipf's
    law of the rank, in steps of 1/64, so that sums are exact."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    pieces, types = [p.piece for p in m.pieces], [p.type for p in m.pieces]
    scores, rank = [], 0
    for p in m.pieces:
        rank += p.type == NORMAL
        scores.append(p.score if m.trainer_spec.model_type == 1 or p.type != NORMAL else -round(64 * math.log2(1 + rank)) / 64)
    return {"pieces": pieces, "types": types, "scores": scores, "dummy": m.normalizer_spec.add_dummy_prefix}


def double_array(keys: dict[bytes, int]) -> tuple[list[int], list[int], list[int]]:
    """base, check and value of a trie over bytes: the child of node s by byte c is base[s] + c + 1 if its check is s."""
    root: dict = {}
    for key, v in keys.items():
        node = root
        for c in key:
            node = node.setdefault(c, {})
        node[-1] = v
    size = 1 << 16
    base, check, value = [0] * size, [-1] * size, [-1] * size
    used = np.zeros(size, bool)
    used[0] = True
    hint: dict[int, int] = {}  # where the search for so many children goes on; the holes left go to smaller families
    heap, count = [(0, 0, 0, root)], 0
    while heap:
        _, _, s, node = heapq.heappop(heap)  # the largest families first
        value[s] = node.pop(-1, -1)
        kids = np.array(sorted(node))
        if not len(kids):
            continue
        b, width = hint.get(len(kids), 0), 512
        while True:
            if b + width + 258 > size:
                base += [0] * size
                check += [-1] * size
                value += [-1] * size
                used = np.concatenate([used, np.zeros(size, bool)])
                size *= 2
            fits = np.flatnonzero(~used[b + np.arange(width)[:, None] + kids[None] + 1].any(1))
            if len(fits):
                b += int(fits[0])
                break
            b += width
        hint[len(kids)] = b
        base[s] = b
        used[b + kids + 1] = True
        for c in kids.tolist():
            t = b + c + 1
            check[t] = s
            count += 1
            heapq.heappush(heap, (-len(node[c]), count, t, node[c]))
    pad = 258
    return base + [0] * pad, check + [-1] * pad, value + [-1] * pad


class Codec:
    """Encoder and decoder over one vocabulary (the dictionary that load() returns)."""

    def __init__(self, vocab: dict, trie: tuple | None = None):
        self.pieces, self.dummy = vocab["pieces"], vocab["dummy"]
        self.scores = vocab["scores"]
        normal = {p.encode(): i for i, (p, t) in enumerate(zip(self.pieces, vocab["types"], strict=True)) if t == NORMAL}
        self.trie = trie or double_array(normal)
        self.unknown = min(self.scores[i] for i in normal.values()) - PENALTY
        self.bytes = [0] * 256
        self.surface = [b""] * len(self.pieces)
        for i, (p, t) in enumerate(zip(self.pieces, vocab["types"], strict=True)):
            if t == BYTE:
                self.bytes[int(p[3:5], 16)] = i
                self.surface[i] = bytes([int(p[3:5], 16)])
            elif t == NORMAL:
                self.surface[i] = p.replace(MARK, " ").encode()
            elif t == UNKNOWN:
                self.surface[i] = b" \xe2\x81\x87 "
        # No piece has a marker after another character or a line feed, so no piece crosses these cuts.
        safe = all(MARK not in p.lstrip(MARK) and "\n" not in p for p, t in zip(self.pieces, vocab["types"], strict=True) if t == NORMAL)
        self.cuts = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+") if safe else re.compile("(?s).+")
        self.known: dict[str, bytes] = {}

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best-scoring segmentation; ties go to the longer last piece."""
        b = text.encode()
        n = len(b)
        base, check, value = self.trie
        scores, unknown = self.scores, self.unknown
        best, back, via = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            c = b[i]
            end = i + (1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4)
            s, node, j, single = best[i], 0, i, False
            while j < n:
                t = base[node] + b[j] + 1
                if check[t] != node:
                    break
                node = t
                j += 1
                p = value[node]
                if p >= 0:
                    v = s + scores[p]
                    if v > best[j]:
                        best[j], back[j], via[j] = v, i, p
                    single = single or j == end
            if not single and s + unknown > best[end]:
                best[end], back[end], via[end] = s + unknown, i, -1
            i = end
        out = []
        while n:
            i = back[n]
            if via[n] >= 0:
                out.append(via[n])
            else:
                out.extend(self.bytes[c] for c in reversed(b[i:n]))
            n = i
        out.reverse()
        return out

    def viterbi_many(self, parts: list[bytes]) -> list[bytes]:
        """viterbi() for parts of one byte length, side by side: ids as little-endian 32-bit integers."""
        if not hasattr(self, "arrays"):
            self.arrays = [np.array(x, np.int32) for x in self.trie] + [np.array(self.scores), np.array(self.bytes, np.int32)]
        base, check, value, scores, fallback = self.arrays
        n, size = len(parts), len(parts[0])
        b = np.frombuffer(b"".join(parts), np.uint8).reshape(n, size).astype(np.int32)
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0.0
        back, via = np.zeros((n, size + 1), np.int32), np.full((n, size + 1), -1, np.int32)
        width = np.select([b < 0x80, b < 0xE0, b < 0xF0], [1, 2, 3], 4)
        for i in range(size):
            start = np.flatnonzero(best[:, i] > -np.inf)
            if not len(start):
                continue
            lane, node, single = start, np.zeros(len(start), np.int32), np.zeros(n, bool)
            for j in range(i, size):
                t = base[node] + b[lane, j] + 1
                ok = check[t] == node
                lane, node = lane[ok], t[ok]
                if not len(lane):
                    break
                p = value[node]
                hit = p >= 0
                at, p = lane[hit], p[hit]
                v = best[at, i] + scores[p]
                more = v > best[at, j + 1]
                up = at[more]
                best[up, j + 1], back[up, j + 1], via[up, j + 1] = v[more], i, p[more]
                single[at[width[at, i] == j + 1 - i]] = True
            lone = start[~single[start]]
            end = i + width[lone, i]
            v = best[lone, i] + self.unknown
            more = v > best[lone, end]
            lone, end = lone[more], end[more]
            best[lone, end], back[lone, end], via[lone, end] = v[more], i, -1
        lanes, orders, found = [], [], []
        lane, pos, step = np.arange(n), np.full(n, size), 0
        while len(lane):
            p, i = via[lane, pos], back[lane, pos]
            known = p >= 0
            lanes.append(lane[known])
            found.append(p[known])
            orders.append(np.full(known.sum(), step))
            for k in range(4):  # bytes of unknown characters, last first
                of = ~known & (pos - 1 - k >= i)
                lanes.append(lane[of])
                found.append(fallback[b[lane[of], pos[of] - 1 - k]])
                orders.append(np.full(of.sum(), step + k))
            step += 4
            go = i > 0
            lane, pos = lane[go], i[go]
        lane, order, ids = np.concatenate(lanes), np.concatenate(orders), np.concatenate(found).astype(np.int32)
        by = np.lexsort((-order, lane))
        raw = ids[by].tobytes()
        ends = np.cumsum(np.bincount(lane, minlength=n)) * 4
        return [raw[x:y] for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def learn(self, parts: set[str]) -> None:
        """Cache the ids of parts that are not cached yet."""
        like: dict[int, list[str]] = {}
        for p in parts:
            like.setdefault(len(p.encode()), []).append(p)
        for size, group in like.items():
            if size <= LONGEST and len(group) > 8:
                for k in range(0, len(group), 4096):
                    self.known.update(zip(group[k : k + 4096], self.viterbi_many([p.encode() for p in group[k : k + 4096]]), strict=True))
            else:
                self.known.update((p, np.array(self.viterbi(p), np.int32).tobytes()) for p in group)

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts (null and empty: none).  The cache of parts starts anew when it is full."""
        if len(self.known) > CACHE:
            self.known.clear()
        head = MARK if self.dummy else ""
        cut = [self.cuts.findall((head + t).replace(" ", MARK)) if t else [] for t in texts]
        self.learn({p for parts in cut for p in parts if p not in self.known})
        known = self.known
        return [np.frombuffer(b"".join([known[p] for p in parts]), np.int32) for parts in cut]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids) -> str:
        """The text of ids: bytes join, markers become spaces, the dummy prefix goes.  A text's own U+2581 becomes a space."""
        surface = self.surface
        raw = b"".join([surface[i] for i in ids])
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


def encode_table(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, ids, n_ids, and the crc32 of the text decoded from them with whether it equals the original.

    Null and empty texts have no ids and decode to the empty text.  Only texts that hold U+2581 itself don't come
    back (the marker can't be told from a space).  Extra columns are not read; an empty table gives no rows.
    """
    vocab = load(path)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, Codec(vocab).trie))

    def run(batches):
        codec = Codec(*shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(1).to_pylist()
                ids = codec.encode_many(texts)
                back = [codec.decode(x.tolist()) for x in ids]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                array = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                crc = [zlib.crc32(t.encode()) for t in back]
                same = [t == (o or "") for t, o in zip(back, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), array, pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_ids", "decoded_crc32", "round_trip"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, ids array<int>, n_ids long, decoded_crc32 long, round_trip boolean")
