"""Quality, language, language model: brute force, held-out accuracy, odd rows."""

import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import langid, lm, quality
from quillon.llm.queries import tokenizer

DATA = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"
have = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@have
def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    out = quality.classify(spark.read.parquet(f"{DATA}/documents.parquet"), labels).join(labels, "doc_id").toPandas()
    held = out[out.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.95
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.98  # a good document ranks over a bad one
    assert all(out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id])


def test_quality_odd(spark, odd, none, labels):
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert quality.classify(none, labels).count() == 0
    assert {round(r.score, 9) for r in quality.classify(odd, labels.limit(0)).collect()} == {0.3}
    rows = [(i % 30, f"text {i} " + ("### $$ " if i % 3 else "word and word ") * (i % 7)) for i in range(120)]  # ids with several texts
    marks = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    once, twice = ({(r.doc_id, round(r.score, 9)) for r in quality.classify(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), marks).collect()} for n in (2, 5))
    assert once == twice


def test_every_labelled_row_teaches_quality(spark):
    from pyspark.sql import functions as F

    ids = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, "good words here" if i % 3 else "### bad $$") for i in range(9000)], "doc_id long, text string").repartition(7)
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("quality"))
    have = quality.labelled_rows(docs, labels)
    assert sorted(r.doc_id for r in have.select("doc_id").collect()) == ids


def test_all_pairs_of_good_and_bad_count(spark):
    r = np.random.default_rng(3)
    m = len(quality.NAMES)
    x, y = r.normal(size=(60, m)), r.integers(0, 2, 60)
    x += 0.6 * y[:, None]
    model = quality.fit(spark.createDataFrame([(int(b), [float(v) for v in a]) for a, b in zip(x, y, strict=True)], "y int, x array<double>").repartition(3), width=1e-6)
    d = (x[y == 1][:, None] - x[y == 0][None]).reshape(-1, m)
    slope = d.T @ (1 / (1 + np.exp(d @ model["w"]))) / len(d) - 1e-3 * model["w"]
    assert np.abs(slope).max() < 1e-6  # the best weights for every pair, not for drawn ones
    assert abs(model["cut"] - np.quantile(x @ model["w"], (y == 0).mean())) < 1e-9
    coarse = quality.fit(spark.createDataFrame([(int(b), [float(v) for v in a]) for a, b in zip(x, y, strict=True)], "y int, x array<double>"))
    assert np.abs(coarse["w"] - model["w"]).max() < 0.01 * np.abs(model["w"]).max()


def longest_phrases(reference, text):
    n = i = 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in reference:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def parsed(model, texts):
    return model.phrases([langid.normal(t, langid.letters()) for t in texts])


def test_phrases_are_greedy_longest_matches():
    refs = {"x": "the cat sat on the mat " * 3, "y": "der hund lag auf dem bett " * 3, "none": "12 34"}
    model = langid.Model(refs, 60)
    assert model.langs == ["x", "y"]  # a language without letters isn't learned
    clean = {k: refs[k].strip()[:60].encode() for k in model.langs}
    texts = ["the mat sat", "auf dem hund", "the hund", "catcatcat", "t"]
    got = parsed(model, texts)
    for i, t in enumerate(texts):
        for k, lang in enumerate(model.langs):
            assert round(got[i, k] / model.bits[k]) == longest_phrases(clean[lang], t.encode()), (t, lang)


def test_phrases_of_long_texts_and_large_scripts():
    r = np.random.default_rng(3)
    script = [chr(0x4E00 + i) for i in range(400)]
    refs = {"han": "".join(r.choice(script, 3000)), "abc": " ".join("".join(r.choice(list("abcdefgh"), 6)) for _ in range(700))}
    model = langid.Model(refs, 9000)
    clean = {k: langid.normal(v.strip(), langid.letters())[:9000].tobytes() for k, v in refs.items()}
    copy = refs["abc"][17:4417]  # one phrase over several blocks
    mixed = "".join(r.choice(script, 1500)) + " " + copy + " " + "".join(r.choice(list("abcdefghé "), 2500)) + refs["han"][5:900]
    texts = [mixed, copy, refs["han"][100:1500], "x" + copy * 2, " ".join(["abc"] * 900)]
    got = parsed(model, texts)
    for i, t in enumerate(texts):
        t = langid.normal(t, langid.letters()).tobytes()
        for k, lang in enumerate(model.langs):
            assert round(got[i, k] / model.bits[k]) == longest_phrases(clean[lang], t), (i, lang)
    assert model.predict([refs["han"][40:90], "abc def gh " * 3], langid.letters())[0] == ["han", "abc"]


@have
def test_langid_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (out[out.held_out].lang_pred == out[out.held_out].lang).mean() > 0.98


def test_langid_odd(spark, odd, none):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (2, 3, 4, 8)) and by[5].lang_pred != "und"
    assert langid.identify(none).count() == 0
    kept = langid.keep_known(odd)
    assert kept.columns == odd.columns and {2, 3, 4, 8}.isdisjoint({r.doc_id for r in kept.collect()})
    assert langid.keep_known(none).count() == 0


def test_langid_models_of_one_session(spark):
    # the first call leaves its model in Python workers that the second one uses again
    for names in (("aa", "bb"), ("cc", "dd")):
        rows = [(i, ("lorem ipsum dolor sit amet " if i % 2 else "the cat sat on a mat ") * 5, names[i % 2]) for i in range(40)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
        assert {(r.doc_id, r.lang_pred) for r in langid.identify(docs).collect()} == {(i, names[i % 2]) for i in range(40)}
        kept = langid.keep_known(docs.where(f"lang = '{names[0]}'"))
        assert kept.count() == 20


def test_base_scores(spark, odd):
    rows = odd.collect()
    count = Counter()
    for r in rows:
        if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            count.update(lm.tokens(r.text) + [b""])
    n, v = sum(count.values()), len(count)
    got = {(r.doc_id, r.n_tokens): r for r in lm.op9(odd, tokenizer("byte_bpe_50k.tiktoken")).collect()}
    for r in rows:
        words = lm.tokens(r.text) + [b""]
        x = got[r.doc_id, len(words)]
        assert (x.train_tokens, x.n_known) == (n, sum(count[w] > 0 for w in words)) and x.score < 0
        assert abs(x.base_score - sum(np.log10((count[w] + 1) / (n + v + 1)) for w in words)) < 1e-6 * len(words)


def test_every_training_document_teaches(spark):
    path = tokenizer("byte_bpe_50k.tiktoken")
    rows = [(i, "one two three four five six seven eight " * 4) for i in range(400)] + [(400, "alpha beta " * 10_000)]
    train = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    coder = lm.Subwords(path)
    grams = lm.gram_counts(lm.word_counts(train), path)
    texts = [np.append(coder.ids([w.decode() for w in lm.tokens(t)]), coder.end) for _, t in rows]
    every = np.concatenate(texts)
    assert (np.bincount(grams.of[every], minlength=grams.n) == np.round((grams.any * (sum(map(len, texts)) + 0.5 * len(grams.of)) - 0.5))[: grams.n])[1:].all()
    model = lm.Attention(grams.n)
    grams.open()
    x, y, live = lm.blocks([grams.of[t] for t in texts], grams.n, grams.end)
    before = lm.Attention.score(model.tables(), grams, x, y, live).sum()
    lm.learn_kinds(train, grams, path, 1)
    grams.open()
    kinds = lm.Attention.score(model.tables(), grams, x, y, live).sum()
    assert kinds > before
    assert lm.learn_weights(train, model, grams, path, lm.CHUNK, 1) == sum(map(len, texts))  # neither documents nor tails are left out
    assert lm.Attention.score(model.tables(), grams, x, y, live).sum() > kinds


def test_every_window_teaches(spark, monkeypatch):
    path = tokenizer("byte_bpe_50k.tiktoken")
    train = spark.createDataFrame([(i, " ".join(f"w{(i + 1) * k % 89}" for k in range(40 * i))) for i in range(30)], "doc_id long, text string").repartition(3)
    counts, coder, told = lm.word_counts(train), lm.Subwords(path), []
    plain = lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda *a: told.append(plain(*a)))
    _, grams = lm.fit(train, counts, path)
    want = sum(len(coder.ids([w.decode() for w in lm.tokens(r.text)])) + 1 for r in train.collect())
    assert told == [want]  # not one run in some
    flat, stop = next(lm.chosen(iter([pa.RecordBatch.from_pylist([{"text": "one two " * 100}, {"text": None}, {"text": "three"}])]), path, np.arange(coder.end + 1), lm.WHOLE, 1))
    assert [x.tolist() for x in np.split(flat, stop[:-1])] == [[*coder.ids(x.split()).tolist(), coder.end] for x in ("one two " * 100, "", "three")]


def test_end_token_beyond_the_broadcast(spark, odd, monkeypatch):
    path = tokenizer("byte_bpe_50k.tiktoken")
    want = {(r.doc_id, r.n_tokens): (r.n_known, r.base_score) for r in lm.op9(odd, path).collect()}
    # nothing is broadcast: every word, the end token too, is beyond the bound
    monkeypatch.setattr(lm, "most_frequent", lambda counts: {})
    for r in lm.op9(odd, path).collect():
        n_known, base = want[r.doc_id, r.n_tokens]
        assert r.n_known == n_known and abs(r.base_score - base) < 1e-6


def test_rare_words_are_joined(spark, odd):
    counts = spark.createDataFrame([(bytes([65 + i]), 2**i) for i in range(20)], "word binary, c long")
    some = lm.most_frequent(counts, 5)
    assert len(some) == 5 and set(some.values()) == {2**i for i in range(15, 20)}
    assert lm.most_frequent(counts.limit(0)) == {}


def test_lm_empty(spark, none):
    assert lm.op9(none, tokenizer("byte_bpe_50k.tiktoken")).count() == 0


def grams_of(n, seed=0, kept=4096):
    """Counts of random words over n ids, of which the last is the end."""
    r = np.random.default_rng(seed)
    ids, firsts, lasts, pairs = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), Counter()
    for _ in range(3 * n):
        w, c = r.integers(0, n - 1, int(r.integers(1, 5))), int(r.integers(1, 9))
        np.add.at(ids, w, c)
        firsts[w[0]] += c
        lasts[w[-1]] += c
        for x in zip(w, w[1:], strict=False):
            pairs[x] += c
    for x in (ids, firsts, lasts):
        x[n - 1] += 7
    grams = lm.Grams(ids, firsts, lasts, np.array([(*k, c) for k, c in pairs.items()]), n - 1, kept)
    m = len(grams.keys)
    grams.shape(r.integers(0, 30, (m, lm.MIX)).astype(float), r.integers(0, 9, (grams.n, lm.MIX)).astype(float), r.integers(0, 9, (grams.n, lm.MIX)).astype(float))
    grams.open()
    return grams


def test_gradient_and_probabilities():
    r = np.random.default_rng(0)
    grams = grams_of(29)
    n = grams.n
    y = np.arange(n)
    for x in range(n):  # every kind's distribution sums to 1
        assert np.allclose(grams.given(np.full(n, x), y).sum(0), 1, atol=1e-5)
    model = lm.Attention(n)
    x, y, rows = lm.blocks([r.integers(0, n, 50), r.integers(0, n, 7)], n, grams.end)
    g, _ = model.gradient(grams, x, y, rows)
    for name in model.p:
        i = tuple(int(r.integers(0, m)) for m in model.p[name].shape)
        old, e = model.p[name].copy(), 1e-2
        model.p[name][i] += e
        up = model.gradient(grams, x, y, rows)[1]
        model.p[name][i] = old[i] - e
        down = model.gradient(grams, x, y, rows)[1]
        model.p[name] = old
        assert abs((up - down) / 2 / e - float(np.asarray(g[name])[i])) < 3e-4, name
    total = 0
    for t in range(n):  # all continuations of one prefix sum to 1
        x, y, rows = lm.blocks([np.array([5, 7, t])], n, grams.end)
        total += 10 ** lm.Attention.score(model.tables(), grams, x, y, rows)[1, 2]
    assert abs(total - 1) < 1e-4


def test_rare_ids_share_a_class():
    grams = grams_of(29, kept=10)
    assert grams.n == 10 and abs(sum(10.0 ** grams.log10[grams.of == 0]) - 1) < 1e-9 and (grams.log10[grams.of > 0] == 0).all()


def test_windows_equal_one_pass():
    """Batched windows score each id as a plain loop over its own context does."""
    r = np.random.default_rng(1)
    grams = grams_of(20)
    n = grams.n
    model = lm.Attention(n)
    ids = r.integers(0, n, 45)
    t = model.tables()
    x, y, rows = lm.blocks([ids], n, grams.end)
    got = lm.Attention.score(t, grams, x, y, rows, step=1)[1:].ravel()[:45]
    seen = np.concatenate([[grams.end], ids[:-1]])
    for i in range(45):
        lo = max(0, i // lm.STEP * lm.STEP - lm.STEP)
        k = seen[lo : i + 1]
        bias = t["mask"][i % lm.STEP][lm.STEP + i % lm.STEP - (i - lo) : lm.STEP + i % lm.STEP + 1]
        s = np.exp(t["k"][k] @ t["q"][seen[i]] + bias)
        o = s @ t["v"][k] / s.sum()
        pi = np.exp(o @ t["o"] + t["g"][seen[i]])
        assert abs(got[i] - np.log10(pi / pi.sum() @ grams.given(seen[i : i + 1], ids[i : i + 1])[0])) < 1e-4


def test_training_helps():
    grams = grams_of(12)
    steps = lm.Steps(lm.Attention(grams.n), grams, batch=13)
    for _ in range(60):
        steps.add(np.tile([1, 2, 3, 4], 50))
    assert np.mean(steps.losses[-5:]) < steps.losses[0] - 0.02


def test_runs_cover_texts_by_their_length():
    for n in (0, 1, 96, 97, 50 * 96 + 3):
        got = lm.runs(n, 96, 8)
        assert 1 <= len(got) <= -(-n // 96 / 8) + 1 and sum(last for *_, last in got) <= 1
        assert [x for a, z, _ in lm.runs(n, 96, 1) for x in range(a, z)] == list(range(n))


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test tables")
def test_lm_beats_words_and_subwords_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").where("text is not null")
    path = tokenizer("byte_bpe_50k.tiktoken")
    held = [r for r in lm.op9(docs, path).collect() if r.held_out]
    train = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 7 != 2")
    grams = lm.gram_counts(lm.word_counts(train), path)
    coder, single = lm.Subwords(path), 0.0
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in held:
        ids = np.append(coder.ids([w.decode() for w in lm.tokens(texts[r.doc_id])]), coder.end)
        single += (np.log10(grams.any[grams.of[ids]]) + grams.log10[ids]).sum()
    score, base, n = (sum(x) for x in zip(*[(r.score, r.base_score, r.n_tokens) for r in held], strict=True))
    print(f"per token: model {score / n:.3f}, base {base / n:.3f}, subword unigram {single / n:.3f}")
    assert score > single + n and score > base + 0.02 * n
    better = np.mean([r.score > r.base_score for r in held])
    assert better > 0.55, better


def test_texts_are_encoded_once(spark, odd, monkeypatch):
    path = tokenizer("byte_bpe_50k.tiktoken")
    coder, read = lm.Subwords(path), []
    plain = lm.readable
    monkeypatch.setattr(lm, "readable", lambda train: read.append(plain(train).columns) or plain(train))
    lm.op9(odd, path).collect()
    assert read == 3 * [["ids"]]  # neither the kinds' start, nor kinds, nor weights split a text again
    texts = pa.array(["one two " * 100, None, "", " \n", "日本語 ▁ <|endoftext|> \x00 é́ X", "x" * 500])
    flat, stop = lm.unpacked(lm.packed(*lm.coded(texts, coder)[3:]).slice(1, 4))
    assert [x.tolist() for x in np.split(flat, stop[:-1])] == [[*coder.ids([w.decode() for w in lm.tokens(t)]).tolist(), coder.end] for t in texts.to_pylist()[1:5]]
    for every in (1, 3):  # the same runs from ids as from texts
        a, b = (next(lm.chosen(iter([pa.RecordBatch.from_arrays([x], ["x"])]), path, np.arange(coder.end + 1), 16, every)) for x in (texts, lm.packed(*lm.coded(texts, coder)[3:])))
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
    word = [w for w in texts.to_pylist()[0].split()]
    ends = np.cumsum([len(coder.ids(word[i : i + 96])) for i in range(0, 200, 96)])
    got = next(lm.chosen(iter([pa.RecordBatch.from_arrays([texts[:1]], ["x"])]), path, np.arange(coder.end + 1), 96, 1))[1]
    assert got.tolist() == [*ends[:-1].tolist(), ends[-1] + 1]


def test_steps_take_whole_batches_and_leave_no_window():
    grams, r = grams_of(12), np.random.default_rng(3)
    steps, seen = lm.Steps(lm.Attention(grams.n), grams, batch=8), []
    plain = steps.model.gradient
    steps.model.gradient = lambda g, x, y, rows: seen.append(sorted(y[rows][y[rows] >= 0].tolist())) or plain(g, x, y, rows)
    texts = [r.integers(0, 11, int(n)) for n in r.integers(0, 200, 40)]
    for s in texts:
        steps.add(s)
    steps.flush()
    windows = sum(-(-len(s) // lm.STEP) for s in texts)
    assert len(seen) == -(-windows // 8) and sorted(sum(seen, [])) == sorted(np.concatenate(texts).tolist())
    moments = np.concatenate([np.abs(m).ravel() for moments in (steps.m, steps.v) for m in moments.values()])
    assert moments[moments > 0].min() > 1e-37  # none so small that it slows every step
