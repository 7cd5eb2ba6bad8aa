"""Pieces, media, near-duplicates, token files: exact round trips and brute force, odd rows."""

import hashlib
import os
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from quillon.llm import avi, graph, pieces, simhash, tokenfile
from quillon.llm.queries import tokenizer


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.load(tokenizer("piece_bpe_32k.model")))


def library(codec):
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(tokenizer("piece_bpe_32k.model"), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for p, s in zip(m.pieces, codec.scores, strict=True):
        p.score = s
    return SentencePieceProcessor(model_proto=m.SerializeToString())


def test_viterbi_equals_the_library(codec, odd):
    sp = library(codec)
    texts = [r.text or "" for r in odd.collect()] + ["  a  b ", "🙂🙂 a\tb\x00c", "\n", "a" * 300, "<s>▁</s>", "été naïve co.,ltd"]
    many = codec.encode_many(texts)
    for t, ids in zip(texts, many, strict=True):
        assert ids.tolist() == sp.encode(t) and codec.decode(ids.tolist()) == sp.decode(ids.tolist())
        assert np.frombuffer(b"".join(np.array(codec.viterbi(p), np.int32).tobytes() for p in codec.cuts.findall(("▁" + t).replace(" ", "▁"))) if t else b"", np.int32).tolist() == ids.tolist()


def test_pieces_table(spark, odd, none):
    rows = pieces.encode_table(odd, tokenizer("piece_bpe_32k.model")).collect()
    assert len(rows) == odd.count() and all(r.round_trip for r in rows if r.doc_id != 7) and all(r.n_ids == len(r.ids) for r in rows)
    assert {r.n_ids for r in rows if r.doc_id in (2, 3)} == {0}
    assert pieces.encode_table(none, tokenizer("piece_bpe_32k.model")).count() == 0


def test_avi_round_trip():
    for payload in (bytes(64), bytes(range(256)) * 40, "é日本🙂".encode() * 64, b"\xff" * 640):
        frames = avi.encode_frames(payload)
        back, seconds = avi.read_avi(avi.write_avi(frames))
        assert back == frames and avi.payload_of(back) == payload and seconds == 1 / avi.FPS
    with pytest.raises(ValueError):
        avi.read_avi(b"no file")


def test_avi_without_index_and_general_decoder():
    payload = bytes(range(250)) * 64
    data = avi.write_avi(avi.encode_frames(payload))
    cut = data[: data.rindex(b"idx1")]
    assert avi.payload_of(avi.read_avi(cut)[0]) == payload
    # A hand-made frame: flat blocks with DC differences and end-of-block codes, no restart markers.
    table = lambda kind, symbols: bytes([kind]) + bytes([0, len(symbols)] + [0] * 14) + bytes(symbols)
    bits = "01" + "101" + "00" + "00" + "00"  # category 3, +5, EOB; category 0, EOB
    raw = int(bits.ljust(16, "1"), 2).to_bytes(2, "big")
    quant = b"\0" + bytes([16]) + b"\1" * 63
    j = b"\xff\xd8" + avi._segment(0xDB, quant) + avi._segment(0xC0, b"\x08\0\x08\0\x10\x01\x01\x11\0") + avi._segment(0xC4, table(0, [0, 3])) + avi._segment(0xC4, table(0x10, [0])) + avi._segment(0xDA, b"\x01\x01\0\0\x3f\0") + raw + b"\xff\xd9"
    coef, _ = avi.coefficients(j)
    assert coef[:, 0].tolist() == [5, 5] and not coef[:, 1:].any()
    assert set(avi.decode_frame(j).ravel().tolist()) == {128 + 10}


def test_shots():
    hist = np.zeros((30, 16))
    hist[:10, 0] = hist[10:20, 8] = hist[20:, 15] = 1
    assert avi.shots(hist) == [0, 10, 20] and avi.shots(hist[:0]) == [] and avi.shots(hist[:1]) == [0]
    flat = np.tile(np.eye(16)[[0, 1]], (10, 1))  # flicker: large differences that are the usual ones
    assert avi.shots(flat)[:2] == [0, 1] and len(avi.shots(flat)) <= 3


def test_media_rows(spark, odd, none):
    out = {(r.doc_id, r.n_bytes): r for r in avi.op7(odd).collect()}
    for r in odd.collect():
        n, payload = avi.payload_for(r.text)
        x = out[r.doc_id, n]
        assert (x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    clips = avi.clip_rows(avi.media_of(odd)).collect()
    assert {c.doc_id for c in clips} == {r.doc_id for r in odd.collect()} and all(c.end_s > c.start_s for c in clips)
    assert avi.op7(none).count() == 0 and avi.clip_rows(avi.media_of(none)).count() == 0


def brute_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash_rows(spark, odd, none):
    rows = odd.collect()
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.op8(odd).collect()}
    fps = {r: brute_fingerprint(r.text, 4) for r in rows}
    assert {(r.doc_id, f"{f:016x}") for r, f in fps.items()} == set(got)
    distinct = sorted(set(fps.values()))
    root = components([(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 4], distinct)
    for r, f in fps.items():
        want = min((o.doc_id for o, g in fps.items() if root[g] == root[f] and o.doc_id is not None), default=None)
        assert got[r.doc_id, f"{f:016x}"] == want
    assert simhash.op8(none).count() == 0
    kept = simhash.keep_one(odd)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd.columns and 0 in ids and 1 not in ids and ids.count(6) == 1 and (2 in ids) + (3 in ids) + (4 in ids) == 1
    assert simhash.keep_one(none).count() == 0


def test_one_of_each_group_by_exact_similarity(spark):
    texts = []
    for k in range(40):  # 196 shingles; the second text has 157 (0.801) or 138 (0.704) of them
        words = [f"w{k}x{i}" for i in range(200)]
        texts += [" ".join(words), " ".join(words[: 161 if k % 2 else 142])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == {i for i in range(80) if i % 4 != 3}


def test_groups_joined_through_any_pair(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[s : s + 200]) for s in range(0, 60, 6)]  # neighbours at 0.94, the ends at 0.57
    docs = spark.createDataFrame(list(enumerate([*texts, "a b c", "A  b c", "", None])), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [0, 10, 12]


def kept_by_brute_force(rows, least=0.8):
    sets = {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        sets[i] = {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    owners, pairs = {}, Counter()
    for i, s in sets.items():
        for x in s or {None}:
            for j in owners.setdefault(x, []):
                pairs[j, i] += 1
            owners[x].append(i)
    links = [(i, j) for (i, j), n in pairs.items() if n >= least * (len(sets[i] | sets[j]) or 1) - 1e-9]
    return set(components(links, list(sets)).values())  # a root is the smallest id of its component


def test_near_copies_against_brute_force(spark):
    r = np.random.default_rng(5)
    rows = []
    for group in range(3):  # copies with 0 to 14 changed words each: similarities from 0.2 to 1
        base = [f"g{group}w{i}" for i in range(150)]
        for _ in range(120):
            words = list(base)
            for k in r.integers(0, 150, int(r.integers(0, 15))):
                words[k] = f"new{r.integers(0, 10**9)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, " ".join(f"own{r.integers(0, 10**6)}" for _ in range(40))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {x.doc_id for x in simhash.keep_one(docs).collect()} == kept_by_brute_force(rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_near_copies_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    assert {x.doc_id for x in simhash.keep_one(docs).collect()} == kept_by_brute_force(rows)


def test_near_copies_are_found_by_fingerprints(spark, monkeypatch):
    """Without the bands, the stage joins what fingerprints within reach and an exact similarity of 0.8 join."""
    r = np.random.default_rng(6)
    rows = []
    for group in range(25):
        base = [f"g{group}w{i}" for i in range(300)]
        for copy in range(4):
            words = list(base)
            for k in r.integers(0, 300, copy):
                words[k] = f"new{r.integers(0, 10**9)}"
            rows.append((len(rows), " ".join(words)))
    sets = [np.unique(simhash.shingle_hashes(t, 5)) for _, t in rows]
    fps = [simhash.majority(s) for s in sets]
    near = [(i, j) for j in range(len(rows)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= simhash.REACH]
    assert all(len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) for i, j in near)
    want = set(components(near, list(range(len(rows)))).values())
    assert 25 <= len(want) < 50
    monkeypatch.setattr(simhash, "band_keys", lambda s: [])
    assert {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()} == want


def test_names_of_private_columns_may_occur(spark, odd):
    clash = odd.withColumnsRenamed({"score": "__sets", "fp": "__node", "word": "node", "label": "__id", "shard": "bands"})
    out = simhash.keep_one(clash)
    assert out.columns == clash.columns and out.count() == simhash.keep_one(odd).count()


def test_unfinished_components_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)], "u long, v long")
    with pytest.raises(RuntimeError, match="rounds"):
        graph.components(chain, rounds=1)
    assert {(x.node, x.root) for x in graph.components(chain).collect()} == {(i, 0) for i in range(51)}


def test_links_lose_nothing(spark):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    near = []
    for b in base:
        for _ in range(6):
            x = int(b)
            for k in r.choice(64, int(r.integers(0, 6)), False):
                x ^= 1 << int(k)
            near.append(x)
    fps = sorted(set(near))
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    e = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    assert all(((x.u ^ x.v) & (2**64 - 1)).bit_count() <= 4 for x in e)
    want = components([(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4], signed)
    assert components([(x.u, x.v) for x in e], signed) == want
    found = {x.node: x.root for x in graph.components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))).collect()}
    assert all(found.get(n, n) == m for n, m in want.items())


def test_chain_of_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in graph.components(e).collect()}
    assert set(got) == {*range(201), 500, 501} and all(got[i] == 0 for i in range(201)) and got[501] == 500


def test_code_lengths_are_optimal_under_the_limit():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 3000, 40_000):
        c = np.zeros(65_536, np.int64)
        c[r.choice(65_536, n, False)] = (r.pareto(0.5, n) * 3 + 1).clip(1, 1e12).astype(int)
        size = tokenfile.code_lengths(c)
        assert size.max() <= 16 and ((size > 0) == (c > 0)).all()
        if n > 1:
            assert sum(0.5 ** size[size > 0].astype(float)) == 1
        ids = r.choice(np.flatnonzero(c), 1000) if n else np.zeros(0, np.int64)
        codes = tokenfile.canonical(size)
        bits, marks = tokenfile.pack(ids, size, codes)
        assert tokenfile.unpack(bits, len(ids), marks, *tokenfile.decode_tables(size, codes)).tolist() == ids.tolist()
    assert tokenfile.code_lengths(np.array([1, 1, 2, 4, 8]), 3).tolist() == [3, 3, 3, 3, 1]


def test_token_files(spark, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    got = sorted(tokenfile.op10(odd, tokenizer("word_bpe_49k.json")).collect(), key=lambda r: r.start)
    at = 0
    for r, x in zip(rows, got, strict=True):
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [1]
        assert (x.doc_id, x.start, x.n_tokens, x.ids_crc32) == (r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokenfile.op10(none, tokenizer("word_bpe_49k.json")).count() == 0


def test_words_encode_like_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from quillon.llm import wordids

    path = tokenizer("word_bpe_49k.json")
    t, own = Tokenizer.from_file(path), wordids.Words(path)
    texts = ["", " \t\x0b ", "Don't  stop\x1cnow\x85 a\u2028b", "ÀÉ ß ñandú 12,5% x\u0301", "日本語 🙂", "<|endoftext|> mid<|endoftext|>dle", "a " * 300, None, "x\u00a0y\u3000z"]
    r = np.random.default_rng(2)
    texts += ["".join(r.choice(list("abC é.,'\n\t1€"), 60)) for _ in range(50)]
    for _ in range(2):  # the second time from the cache
        got = own.encode(pa.array(texts, pa.string()))
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_a_folder_decodes_alone_and_hot_ids_are_dealt_out(spark):
    path = tokenizer("word_bpe_49k.json")
    rows = [(None, f"none {i}") for i in range(3)] + [(-(2**63), "least")] + [(5, f"hot {i} text") for i in range(200)] + [(i, f"text {i}") for i in range(10, 40)]
    folder = tokenfile.encode_table(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path)
    got = sorted(tokenfile.decode_table(spark.newSession(), folder).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in got] == [None] * 3 + [-(2**63)] + [5] * 200 + list(range(10, 40))
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:], strict=False)) and got[0].start == 0
    assert spark.read.parquet(folder).where("part >= 0").select("part").distinct().count() > 3
    cuts, keys = np.array([2, 5, 5, 5, 9]), np.array([2, 5, 5, 5, 9, 10])
    salts = np.array([0, 0, 2**63, 2**64 - 1, 7, 7], np.uint64)
    assert tokenfile.places(cuts, keys, salts).tolist() == [0, 1, 2, 3, 4, 5]
