"""Name normalisation as Column expressions: no UDF, so filters and pruning pass through."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache, reduce
from itertools import permutations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import vocabulary as V

#: Unicode white space that trimming removes at either end.
BLANKS = r"(?U)^\s+|(?U)\s+$"


def let(value: Column, body) -> Column:
    """Bind a value in ``body``, so that an expression used several times stays one expression and runs once."""
    return F.transform(F.array(value), body)[0]


def unicode_regex(pattern: str) -> str:
    """Unicode-aware classes and word boundaries."""
    return "(?U)" + pattern


@lru_cache(1)
def _compositions() -> list[tuple[str, str]]:
    """Spellings with combining marks -> composed letter, longest first, for the Latin letters of two and three parts."""
    out = {}
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        whole = chr(cp)
        parts = unicodedata.normalize("NFD", whole)
        if len(parts) < 2 or unicodedata.normalize("NFC", parts) != whole:
            continue
        for order in permutations(parts[1:]):
            spelled = parts[0] + "".join(order)
            for k in range(1, len(spelled)):
                short = unicodedata.normalize("NFC", spelled[:k]) + spelled[k:]
                if unicodedata.normalize("NFC", short) == whole and short != whole:
                    out[short] = whole
    return sorted(out.items(), key=lambda x: (-len(x[0]), x[0]))


def nfc(text: Column) -> Column:
    """Compose Latin letters with their marks.  Texts without combining marks (nearly all) pass untouched."""
    pairs = F.from_json(F.lit(json.dumps([{"a": a, "b": b} for a, b in _compositions()])), "array<struct<a string, b string>>")  # folded into one literal
    composed = lambda t: F.aggregate(pairs, t, lambda s, p: F.replace(s, p["a"], p["b"]))
    return let(text, lambda t: F.when(t.rlike("[\\u0300-\\u036f]"), composed(t)).otherwise(t))


def trim_blanks(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, "")


def normalize_text(text: Column) -> Column:
    """NFC, lower case, outer blanks off; null gives the empty string."""
    return trim_blanks(F.lower(nfc(F.coalesce(text, F.lit("")))))


def rewrite(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Apply the rules in order.  A text that no pattern matches as it stands can't be changed by any, so one
    alternation decides whether the chain runs at all."""
    any_rule = unicode_regex("|".join(f"(?:{p})" for p, _ in rules))
    chain = lambda t: reduce(lambda t, r: F.regexp_replace(t, unicode_regex(r[0]), r[1]), rules, t)
    return let(text, lambda t: F.when(t.rlike(any_rule), chain(t)).otherwise(t))


def normalize_entity_types(text: Column) -> Column:
    """Legal forms to their canonical tokens; expects normalised text."""
    return rewrite(text, V.ENTITY_REWRITES)


def normalize_functional_terms(text: Column) -> Column:
    """Functional terms to their canonical tokens; expects the result of normalize_entity_types()."""
    return rewrite(text, V.FUNCTIONAL_REWRITES)


def strip_accents(text: Column) -> Column:
    """Vietnamese letters without their marks; null gives the empty string."""
    return F.translate(F.coalesce(text, F.lit("")), V.ACCENTED, V.PLAIN)


def filter_characters(text: Column) -> Column:
    return F.regexp_replace(text, unicode_regex(f"[^a-zA-Z0-9\\s{V.KEPT_LETTERS}&+\\-]"), " ")


def drop_words(text: Column, words: list[str]) -> Column:
    return rewrite(text, [(rf"\b{w}\b", "") for w in words])


def collapse(text: Column) -> Column:
    return trim_blanks(F.regexp_replace(text, r"(?U)\s+", " "))


def canonical_terms(text: Column) -> Column:
    return normalize_functional_terms(normalize_entity_types(normalize_text(text)))


def clean_name(text: Column, remove_stopwords: bool = True) -> Column:
    """The full cleaning chain; the result is always free of accents."""
    out = filter_characters(canonical_terms(text))
    if remove_stopwords:
        out = drop_words(strip_accents(drop_words(out, V.STOP_WORDS)), V.STOP_WORDS_PLAIN)
    else:
        out = strip_accents(out)
    return collapse(out)


def pipeline_key(text: Column) -> Column:
    """Grouping key of the batch pipeline: canonical terms without accents, but with signs and stop-words."""
    return trim_blanks(strip_accents(canonical_terms(text)))


def matcher_key(cleaned: Column) -> Column:
    """Grouping key of the matcher, from the cleaned name."""
    return strip_accents(cleaned)


def preprocess(text: Column) -> Column:
    """struct(cleaned, no_accent, norm_key)."""
    both = F.struct(clean_name(text).alias("c"), pipeline_key(text).alias("k"))
    return let(both, lambda b: F.struct(b["c"].alias("cleaned"), strip_accents(b["c"]).alias("no_accent"), b["k"].alias("norm_key")))


def dual_variants(cleaned: Column) -> Column:
    """The cleaned name and its accent-free form, once each; none for an empty name."""
    return F.when(cleaned == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(cleaned, strip_accents(cleaned))))


def tokens(text: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def char_ngrams(text: Column, low: int = 2, high: int = 5) -> Column:
    """All character n-grams of the text, spaces included."""
    n = F.length(text)
    return F.flatten(F.transform(F.filter(F.sequence(F.lit(low), F.lit(high)), lambda k: k <= n), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(text, i, k))))


def entity_type(cleaned: Column) -> Column:
    """The most specific legal-form token of a cleaned name; null if it has none."""
    kinds = F.array(*map(F.lit, V.ENTITY_TYPES))
    return let(tokens(cleaned), lambda words: F.get(F.filter(kinds, lambda t: F.array_contains(words, t)), F.lit(0)))


def has_repeats(name: Column) -> Column:
    """A token of more than one letter directly repeated, or a repeated pair of tokens."""

    def check(t):
        places = F.sequence(F.lit(0), F.size(t))
        single = F.exists(places, lambda i: F.coalesce((F.get(t, i) == F.get(t, i + 1)) & (F.length(F.get(t, i)) > 1), F.lit(False)))
        double = F.exists(places, lambda i: F.coalesce((F.get(t, i) == F.get(t, i + 2)) & (F.get(t, i + 1) == F.get(t, i + 3)), F.lit(False)))
        return single | double

    return let(tokens(name), check)


def has_repeats_regex(name: Column) -> Column:
    """The same by one pattern; one-letter words count here."""
    return name.rlike(r"(?U)\b(\w+)\s+\1\b")


def mentions_entity_type(name: Column) -> Column:
    return name.rlike(unicode_regex(r"\b(" + "|".join(V.ENTITY_TYPES) + r")\b"))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def is_no_accent(text: Column) -> Column:
    return strip_accents(text) == text


def is_all_upper(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def is_abbreviated(query: Column, target: Column) -> Column:
    """One short word for several, or capitals with at most half of the target's words."""
    q, t = tokens(query), tokens(target)
    initials = (F.size(q) == 1) & (F.length(F.get(q, F.lit(0))) <= 6) & (F.size(t) >= 2)
    capitals = (F.size(q) * 2 <= F.size(t)) & is_all_upper(query)
    return (F.size(q) > 0) & (F.size(t) > 0) & (F.coalesce(initials, F.lit(False)) | capitals)


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct lower-case tokens; 0 if neither has any."""
    both = F.struct(F.array_distinct(tokens(F.lower(a))).alias("x"), F.array_distinct(tokens(F.lower(b))).alias("y"))
    shared = lambda s: F.size(F.array_intersect(s["x"], s["y"]))
    return let(both, lambda s: F.coalesce(F.try_divide(shared(s), F.size(s["x"]) + F.size(s["y"]) - shared(s)), F.lit(0.0)))


@F.pandas_udf(DoubleType())
def char_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity (matching blocks have no built-in form)."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays; 0 if either has no length."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def confidence(score: Column) -> Column:
    return F.when(score >= 0.90, "high").when(score >= 0.75, "medium").otherwise("low")


def category(cleaned: Column) -> Column:
    """Kind of organisation by the name's first words."""
    return F.when(cleaned.like("cong ty%"), "company").when(cleaned.like("tap doan%"), "conglomerate").when(cleaned.like("ngan hang%"), "bank").otherwise("other")
