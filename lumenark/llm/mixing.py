"""Mixing sources to target weights by hierarchical budgeting.

A token budget is handed down a tree domain - language - source. Among siblings it is divided by weight; a
child that cannot use its part (its documents times the epochs allowed) leaves the rest to its siblings, and
only what a whole family cannot use goes back to its parent's siblings. As a family's capacity is the
sum of its members', handing down capped shares level by level does just that. Among siblings, shares are raised
to one level, (budget - capacities of the full) / (weights of the others), again and again until no more
of them are full: each time one aggregation by family, however many siblings it has.

A leaf then takes whole epochs of its documents and the prefix of one more, in an order seeded by epoch.
Prefix sums go by slices of that order, as many as the square root of the leaf's rows, so a leaf with a third of the corpus is
spread over that many groups of about so many rows, and only token counts move. Rows that share id, names and token count are one
document: they enter together or not at all.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenark.llm.common import WORD, cut, fresh, whole_text

# Weights of the production mix; names not listed weigh DEFAULT_WEIGHT. Weights are positive integers.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG_WEIGHTS = {"en": 6, "fr": 2, "de": 1, "es": 1}
SOURCE_WEIGHTS: dict[str, int] = {}
DEFAULT_WEIGHT = 1
#: The budget: this share (numerator, denominator) of the corpus' tokens.
BUDGET = (3, 4)
MAX_EPOCHS = 2
SEED = 17

#: Leaves whose budgets are sent to all tasks, at most (some 100 bytes each).
BROADCAST_LEAVES = 100_000

LEAF = ["domain", "lang", "source"]


def domain_of_source(source: str = "source") -> Column:
    """Four domains by the number that ends a source's name; d0 for a name without one."""
    return F.expr(f"concat('d', cast(coalesce(try_cast(nullif(regexp_extract(coalesce({source}, ''), '([0-9]{{1,9}})$', 1), '') AS bigint), 0) % 4 AS string))")


def _weight(column: str, weights: Mapping[str, int]) -> Column:
    if any(not isinstance(w, int) or w < 1 for w in weights.values()):
        raise ValueError("weights are positive integers")
    out = F.lit(DEFAULT_WEIGHT)
    for name, weight in weights.items():
        out = F.when(F.col(column) == name, weight).otherwise(out)
    return out.cast("long")


def _share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes (parent, more, capacity, weight, _budget of the parent) and `share`: each one's part of that budget."""
    nodes = cut(nodes.withColumn("_full", F.lit(False)))
    before = -1
    while True:
        levels = nodes.groupBy(*parent).agg(
            F.max("_budget").alias("_b"), F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))), F.lit(0)).cast("double").alias("_used"), F.sum(F.when(~F.col("_full"), F.col("weight"))).cast("double").alias("_open")
        ).select(*parent, ((F.col("_b") - F.col("_used")) / F.col("_open")).alias("_level"))  # null where all are full
        leveled = nodes.join(levels, parent) if parent else nodes.crossJoin(levels)  # without a parent levels is one row
        share = F.least(F.col("capacity").cast("double"), F.col("weight").cast("double") * F.col("_level"))
        leveled = cut(leveled.withColumn("share", F.when(F.col("_full"), F.col("capacity").cast("double")).otherwise(share)).withColumn("_full", F.col("_full") | (F.col("share") >= F.col("capacity"))))
        full = leveled.filter("_full").count()
        if full == before or not full:
            return leveled.drop("_full", "_level", "_budget")
        nodes, before = leveled.drop("share", "_level"), full


def leaf_budgets(leaves: DataFrame, budget: tuple[int, int] = BUDGET, max_epochs: int = MAX_EPOCHS, weights: tuple[Mapping[str, int], ...] = (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS)) -> DataFrame:
    """(domain, lang, source, leaf_tokens, leaf_rows) to the same and leaf_budget, tokens to take from the leaf."""
    leaves = leaves.withColumn("capacity", F.col("leaf_tokens") * max_epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    domains = langs.groupBy("domain").agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight("domain", weights[0]))
    whole = domains.agg(F.floor(F.sum("capacity") / max_epochs * budget[0] / budget[1]).cast("double").alias("_budget"))
    domains = _share(domains.crossJoin(whole), []).select("domain", F.col("share").alias("_budget"))  # whole is one row
    langs = _share(langs.join(domains, "domain").withColumn("weight", _weight("lang", weights[1])), ["domain"]).select("domain", "lang", F.col("share").alias("_budget"))
    leaves = _share(leaves.join(langs, ["domain", "lang"]).withColumn("weight", _weight("source", weights[2])), ["domain", "lang"])
    return leaves.select(*LEAF, "leaf_tokens", "leaf_rows", F.floor("share").cast("long").alias("leaf_budget"))


def mix(docs: DataFrame, domain: Column | None = None, budget: tuple[int, int] = BUDGET, max_epochs: int = MAX_EPOCHS, weights: tuple[Mapping[str, int], ...] = (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS), seed: int = SEED) -> DataFrame:
    """One row per row of docs (doc_id, text, lang, source, any more): doc_id, domain, lang, source, tokens, leaf_budget, copies.

    tokens counts the text's words; copies is how often the document enters the mix: once for each whole
    epoch of its leaf, and once more if the seeded order of the next epoch reaches its last token within the
    budget. Null names count as empty ones, null texts as empty (they enter with every epoch, and cost
    nothing). Equal places in an order go by doc_id, then by tokens; null doc_ids come first. Rows equal in doc_id, lang,
    source and tokens get the same copies. Budgets are found by jobs that run when this is called.
    """
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (domain_of_source() if domain is None else domain).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("tokens")))
    leaves = leaf_budgets(rows.groupBy(*LEAF).agg(F.sum("tokens").alias("leaf_tokens"), F.count("*").alias("leaf_rows")), budget, max_epochs, weights)
    leaves = leaves.withColumn("whole", F.expr("CASE WHEN leaf_tokens = 0 THEN 0 ELSE leaf_budget DIV leaf_tokens END")).withColumn("rest", F.expr("leaf_budget - whole * leaf_tokens"))
    leaves = cut(leaves)
    if leaves.count() <= BROADCAST_LEAVES:
        leaves = F.broadcast(leaves)  # counted just now; more leaves join by a shuffle, whose hot leaves Spark splits
    dealt = rows.join(leaves, LEAF).withColumn("place", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    # The slice grows with the place: its first 32 bits, scaled to as many slices as the root of the leaf's rows.
    dealt = dealt.withColumn("slice", F.expr("shiftright(cast(conv(substring(place, 1, 8), 16, 10) AS bigint) * cast(ceil(sqrt(leaf_rows)) AS bigint), 32)"))
    slices = dealt.groupBy(*LEAF, "slice").agg(F.sum("tokens").alias("t"))
    before = slices.select(*LEAF, "slice", (F.sum("t").over(Window.partitionBy(*LEAF).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("t")).alias("before"))
    inside = Window.partitionBy(*LEAF, "slice").orderBy("place", F.col("doc_id").asc_nulls_first(), "tokens")  # up to the last row that is equal in these
    reached = dealt.withColumn("inside", F.sum("tokens").over(inside)).join(before, [*LEAF, "slice"])
    return reached.select("doc_id", *LEAF, "tokens", "leaf_budget", (F.col("whole") + F.when(F.col("before") + F.col("inside") <= F.col("rest"), 1).otherwise(0)).cast("long").alias("copies"))


def take(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs in the mix, each as often as its copies say, with docs' own columns.

    Nulls, empty texts and ties as in mix(). Rows equal in doc_id, lang, source and token count are taken alike, so repeated rows
    never exceed the budget together. Texts of any length move once, with the rows that stay.
    """
    names = {c: fresh(docs, f"mix_{c}") for c in ("doc_id", "lang", "source", "tokens", "copies", "words", "epoch")}
    doc_id, lang, source, tokens, copies, words, epoch = names.values()
    key = [F.col(c).alias(names[c]) for c in ("doc_id", "lang", "source", "tokens")]
    chosen = mix(docs, **options).filter("copies > 0").groupBy(*key).agg(F.max("copies").alias(copies))
    keyed = docs.withColumn(words, F.regexp_count(whole_text(), F.lit(WORD)).cast("long"))
    same = F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.coalesce("lang", F.lit("")) == F.col(lang)) & (F.coalesce("source", F.lit("")) == F.col(source)) & (F.col(words) == F.col(tokens))
    return keyed.join(chosen, same).withColumn(epoch, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))


ORACLE_SQL = """
WITH rows AS (
    SELECT doc_id, 'd' || (coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1), '') AS bigint), 0) % 4) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS bigint) AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, cast(sum(tokens) AS bigint) AS leaf_tokens, cast(sum(tokens) * 2 AS bigint) AS capacity, 1 AS weight FROM rows GROUP BY ALL),
langs AS (SELECT domain, lang, sum(capacity) AS capacity, CASE lang WHEN 'en' THEN 6 WHEN 'fr' THEN 2 ELSE 1 END AS weight FROM leaves GROUP BY ALL),
domains AS (SELECT domain, sum(capacity) AS capacity, CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END AS weight FROM langs GROUP BY ALL),
d1 AS (SELECT *, ((SELECT cast(floor(cast(sum(capacity) AS double) / 2 * 3 / 4) AS double) FROM domains) - cast(coalesce(sum(capacity) OVER (ORDER BY capacity / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS double))
              / cast(sum(weight) OVER (ORDER BY capacity / weight, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS double) AS level FROM domains),
d2 AS (SELECT domain, least(cast(capacity AS double), cast(weight AS double) * max(level) OVER ()) AS budget FROM d1),
l1 AS (SELECT langs.*, (budget - cast(coalesce(sum(capacity) OVER (PARTITION BY domain ORDER BY capacity / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS double))
              / cast(sum(weight) OVER (PARTITION BY domain ORDER BY capacity / weight, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS double) AS level FROM langs JOIN d2 USING (domain)),
l2 AS (SELECT domain, lang, least(cast(capacity AS double), cast(weight AS double) * max(level) OVER (PARTITION BY domain)) AS budget FROM l1),
s1 AS (SELECT leaves.*, (budget - cast(coalesce(sum(capacity) OVER (PARTITION BY domain, lang ORDER BY capacity / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS double))
              / cast(sum(weight) OVER (PARTITION BY domain, lang ORDER BY capacity / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS double) AS level FROM leaves JOIN l2 USING (domain, lang)),
s2 AS (SELECT domain, lang, source, leaf_tokens, cast(floor(least(cast(capacity AS double), cast(weight AS double) * max(level) OVER (PARTITION BY domain, lang))) AS bigint) AS leaf_budget FROM s1),
s3 AS (SELECT *, CASE WHEN leaf_tokens = 0 THEN 0 ELSE leaf_budget // leaf_tokens END AS whole FROM s2),
dealt AS (SELECT rows.*, leaf_budget, whole, leaf_budget - whole * leaf_tokens AS rest, md5('17:' || whole || ':' || coalesce(cast(doc_id AS varchar), '')) AS place FROM rows JOIN s3 USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens, leaf_budget,
       cast(whole + CASE WHEN sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id NULLS FIRST, tokens RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest THEN 1 ELSE 0 END AS bigint) AS copies
FROM dealt"""
