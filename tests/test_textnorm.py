import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import textnorm as T
from quillon.functions import vocabulary as V
from quillon.operators import fuzzy


def run(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").select("i", f(F.col("s")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


# Worked out by hand from the rewrite rules.
CLEAN = [
    (None, ""), ("", ""), ("   ", ""),
    ("CÔNG TY TNHH ABC", "tnhh abc"), ("ABC JSC", "abc cp"), ("ABC CO.,LTD", "abc tnhh"), ("ABC Co. Ltd.", "abc tnhh"), ("CTCP Hoa Sen", "cp hoa sen"),
    ("Tập đoàn Hòa Phát", "td hoa phat"), ("Công ty Cổ phần Sản xuất Thương mại Dịch vụ X", "cp x"), ("TM&DV Nam Sơn", "nam son"), ("IMP-EXP Nam Son", "nam son"),
    ("A&P (VN)", "a&p vn"), ("C+ X-Y", "c+ x-y"), ("TNHH 1TV Đông Á", "tnhh mtv dong a"), ("a br cty x", "acn x"),
]


def test_clean_by_hand(spark):
    assert run(spark, [a for a, _ in CLEAN], T.clean_name) == [b for _, b in CLEAN]


def test_stopwords_kept(spark):
    assert run(spark, ["Công ty TNHH Thương mại ABC"], lambda c: T.clean_name(c, False)) == ["cong ty tnhh thuong mai abc"]


def test_key_keeps_signs(spark):
    assert run(spark, ["Công ty TNHH (A)"], T.pipeline_key) == ["cong ty tnhh (a)"]


def test_nfc(spark):
    names = ["Công ty Đầu tư Việt Nam", "Hòa Phát", "ế ề ệ ữ ợ Ậ ñ ç"]
    spelled = [unicodedata.normalize("NFD", n) for n in names] + ["ệ", "ệ"]
    assert run(spark, spelled, T.nfc) == [unicodedata.normalize("NFC", n) for n in spelled]


def test_accents(spark):
    assert len(V.ACCENTED) == len(V.PLAIN) == 134
    got = run(spark, [V.ACCENTED, None], T.strip_accents)
    assert got == [V.PLAIN, ""]


def test_types_and_repeats(spark):
    assert run(spark, ["tnhh mtv abc", "cn tnhh x", "abc", ""], T.entity_type) == ["tnhh", "cn", None, None]
    assert run(spark, ["san xuat san xuat", "a a", "ab ab", "x y z", ""], T.has_repeats) == [True, False, True, False, False]
    assert run(spark, ["a a", "ab c"], T.has_repeats_regex) == [True, False]


def test_ngrams(spark):
    assert run(spark, ["abc", "a", ""], T.char_ngrams) == [["ab", "bc", "abc"], [], []]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="abcđếTNHHcổphần &.,-()123 ", max_size=30), min_size=1, max_size=20))
def test_clean_is_plain_ascii(spark, names):
    for name in run(spark, names, T.clean_name):
        assert name.isascii() and name == " ".join(name.split())


def test_jaccard_and_confidence(spark):
    rows = spark.createDataFrame([("a b", "b c"), ("", ""), ("A", "a")], "x string, y string")
    assert [round(r[0], 4) for r in rows.select(T.token_jaccard(F.col("x"), F.col("y"))).collect()] == [0.3333, 0.0, 1.0]
    s = spark.createDataFrame([(0.7499,), (0.75,), (0.8999,), (0.90,)], "s double").select(T.confidence(F.col("s"))).collect()
    assert [r[0] for r in s] == ["low", "medium", "medium", "high"]


@pytest.mark.parametrize("a,b,want", [("x y", "y x", 100), ("abc", "xyz", 0), ("", "a", 0), ("foo bar", "foo", 100)])
def test_token_set(a, b, want):
    assert fuzzy.token_set_ratio(a, b) == want


@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_indel_is_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    want = 1.0 if not a and not b else 2 * row[-1] / (len(a) + len(b))
    assert abs(fuzzy.indel_ratio(a, b) - want) < 1e-12
