"""Variant generation: keyword alternatives, substitutions, affixes, corpus augmentation, language-model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import textnorm as T
from ..functions import vocabulary as V


def combinatorial(name: Column) -> Column:
    """Sorted distinct variants: every keyword of the lower-case name with each alternative, in all combinations, as is,
    without accents, in capitals, and both; the lower-case name itself is left out."""
    lower = F.lower(name)
    found = F.array(lower)

    def fan(key, others):
        options = F.array(*map(F.lit, [key, *others]))
        wide = lambda found: F.array_distinct(F.flatten(F.transform(found, lambda v: F.transform(options, lambda alt: F.replace(v, F.lit(key), alt)))))
        return lambda found: F.when(F.contains(lower, F.lit(key)), wide(found)).otherwise(found)

    for key, others in V.VARIANT_TERMS.items():
        found = T.let(found, fan(key, others))

    def forms(v):
        plain = T.strip_accents(v)
        return F.array(F.trim(v), F.trim(plain), F.trim(F.upper(v)), F.trim(F.upper(plain)))

    return F.sort_array(F.array_remove(F.array_distinct(F.flatten(F.transform(found, forms))), lower))


def substituted(name: Column, rules: list[tuple[str, list[str]]], n: int, seed: int) -> Column:
    """Up to n replacements (order by a hash of the name) by the first rule whose pattern the name has; none otherwise."""

    def changed(pattern, options):
        order = F.sort_array(F.transform(F.array(*map(F.lit, options)), lambda o: F.struct(F.xxhash64(name, o, F.lit(seed)).alias("h"), o.alias("o"))))
        new = F.transform(F.slice(order, 1, n), lambda s: F.regexp_replace(name, F.lit(pattern), s["o"]))
        return F.when(T.is_all_upper(name), F.transform(new, lambda v: F.upper(v))).otherwise(new)

    out = F
    for pattern, options in rules:
        out = out.when(name.rlike("(?iU)" + pattern), changed("(?iU)" + pattern, options))
    return out.otherwise(F.array().cast("array<string>"))


def company_variants(name: Column, n: int = 3, seed: int = 42) -> Column:
    """Other legal forms and industries of a name; affixes where neither is known.  Hash order replaces random choice."""
    both = F.array_distinct(F.concat(substituted(name, V.TYPE_SUBSTITUTES, n, seed), substituted(name, V.INDUSTRY_SUBSTITUTES, n, seed)))
    affixed = F.array(*[F.struct(F.xxhash64(name, F.lit(a), F.lit(z), F.lit(seed)).alias("h"), F.concat(F.lit(a), name, F.lit(z)).alias("v")) for a, z in V.AFFIXES])
    return F.when(F.size(both) > 0, both).otherwise(F.slice(F.transform(F.sort_array(affixed), lambda s: s["v"]), 1, n))


def augment(names: DataFrame, column: str = "name", n: int = 3, cap: int | None = 2000) -> DataFrame:
    """The names and up to ``cap`` new variants that are not among them (a feature of the operator: smallest hash first)."""
    base = names.select(column).distinct()
    new = base.select(F.explode(company_variants(F.col(column), n)).alias(column)).distinct().join(base, column, "left_anti")
    if cap is not None:
        new = new.orderBy(F.xxhash64(column), column).limit(cap)
    return base.union(new)


REPLY = "array<struct<original string, variations array<struct<text string, type string>>>>"


def parse_replies(replies: DataFrame, column: str = "reply", carry: tuple[str, ...] = ()) -> DataFrame:
    """(original, text, type) rows of JSON replies, fenced or not, behind carried columns; unreadable ones give none."""
    body = F.regexp_replace(F.col(column), r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    rows = replies.select(*carry, F.explode(F.from_json(body, REPLY)).alias("r")).select(*carry, "r.original", F.explode("r.variations").alias("v"))
    return rows.select(*carry, "original", F.col("v.text").alias("text"), F.col("v.type").alias("type"))


def eval_corpus(names: DataFrame, column: str = "name") -> DataFrame:
    """Distinct names in order with ids CORP_0000 and on."""
    from .dedup import with_ids

    base = names.select(F.trim(column).alias("name")).where("name <> ''").distinct()
    return with_ids(base, "name", "n").select(F.concat(F.lit("CORP_"), F.when(F.col("n") < 10_000, F.lpad(F.col("n").cast("string"), 4, "0")).otherwise(F.col("n").cast("string"))).alias("id"), "name")


def eval_queries(corpus: DataFrame) -> DataFrame:
    """Rule-made queries of a corpus with the id of their target."""
    rows = corpus.select(F.col("id").alias("target_id"), F.explode(combinatorial(F.col("name"))).alias("text"))
    return rows.select(F.concat(F.lit("Q_"), F.substring("target_id", 6, 20), F.lit("_"), F.sha2("text", 256).substr(1, 8)).alias("id"), "text", "target_id", F.lit("combinatorial").alias("method"))


def llm_queries(parsed: DataFrame, corpus: DataFrame) -> DataFrame:
    """Parsed replies joined to their corpus rows; ids are unique over all batches."""
    rows = parsed.join(corpus.select(F.col("id").alias("target_id"), F.col("name").alias("original")), "original")
    return rows.select(F.concat(F.lit("Q_LLM_"), F.sha2(F.concat_ws("\0", "target_id", "type", "text"), 256).substr(1, 12)).alias("id"), "text", "target_id", F.concat(F.lit("llm_"), F.col("type")).alias("method"))


class VariantWriter:
    """Asks a language model for variants in batches; ``ask`` (prompt -> reply) is the caller's, as no network is assumed."""

    def __init__(self, ask, tries: int = 3, delay: float = 1.0):
        self.ask, self.tries, self.delay = ask, tries, delay

    def reply(self, names: list[str]) -> str | None:
        """The first reply of up to ``tries`` attempts, waiting twice as long after each failure."""
        import time

        prompt = "Return a JSON list of {original, variations: [{text, type}]} with spelling variants of these company names:\n" + "\n".join(names)
        for k in range(self.tries):
            try:
                return self.ask(prompt)
            except (OSError, ValueError):
                time.sleep(self.delay * 2**k)
        return None
