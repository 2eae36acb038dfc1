"""How five filters interact: a Walsh-Hadamard audit of every order they could be applied in.

A document's failing filters are a mask of five bits. For each part of the corpus and each label, Spark sums the
32 signed parities of those masks: parity w of a mask is +1 if mask and w share an even number of bits, else -1.
The sums are all that an audit has to keep: they add up over shards, and the transform, applied again and divided by
32, gives back exactly how many documents have each mask. From these cells come the counts of all 120 orders, and
each filter's Shapley total in closed form: a document that fails f filters meets each of them first in 120 / f orders.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenark.llm.common import prepare, whole_text

# The filters in the order of their bits, and their bounds.
FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 3
ODD_MARKS = "[#$%&*|]"

MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
REPEATED = 1 << FILTERS.index("E")
#: What the parities are summed for.
LABELS = ("all", "good", "toxic")


def own_failures(text: Column) -> Column:
    """The bits of the filters that a text fails by itself, A to D."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct, size = F.size(words), F.size(F.array_distinct(words)).cast("long"), F.char_length(text).cast("long")
    capitals = size - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = (n < LEAST_WORDS, distinct * 100 < n.cast("long") * LEAST_DISTINCT_PERCENT, capitals * 100 > size * MOST_CAPITALS_PERCENT, text.rlike(ODD_MARKS))
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0)).cast("int")


def _sign(mask: Column, w: Column | int) -> Column:
    return 1 - 2 * (F.bit_count(mask.bitwiseAND(w)) % 2)


def parity_sums(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, label, parities): for each part and label that has documents, 32 signed sums over them.

    Rows are counted by text and doc_id first, then by text, part and label, so that copies of one text meet in no
    more rows than there are parts and labels; texts are told apart by SHA-256 and length. Of a text's rows those with its
    smallest doc_id pass filter E, and those with a null doc_id, which is larger than none.
    """
    text, part = whole_text(), F.coalesce(F.col("lang").cast("string"), F.lit(""))
    same = ["sha", "size", "own"]
    rows = docs.select(part.alias("part"), F.col("doc_id").cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("sha"), F.char_length(text).alias("size"), own_failures(text).alias("own"))
    seen = rows.groupBy(*same, "part", "id").agg(F.count("*").alias("n"))
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.expr("coalesce(quality = 1, false)")).alias("good"), F.max(F.expr("coalesce(toxic = 1, false)")).alias("toxic"))
    # Rows without an id have no label; dealt by their text they do not meet in one task.
    seen = seen.withColumn("deal", F.coalesce("id", F.xxhash64("sha")))
    seen = seen.join(known, (F.col("deal") == F.col("label_id")) & F.col("id").isNotNull(), "left")
    merged = seen.groupBy(*same, "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(
        F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("n_least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null")
    )
    smallest = F.min("least").over(Window.partitionBy(*same))
    first = F.col("n_null") + F.when(F.col("least") == smallest, F.col("n_least")).otherwise(0)
    counted = merged.withColumn("first", first).withColumn("repeats", F.col("n") - F.col("first"))
    sums = [F.sum(_sign(F.col("own"), w) * (F.col("first") - F.col("repeats") if w & REPEATED else F.col("n"))).alias(f"s{w}") for w in range(MASKS)]
    by_class = counted.groupBy("part", "good", "toxic").agg(*sums)
    label = F.explode(F.expr("filter(array('all', if(good, 'good', null), if(toxic, 'toxic', null)), x -> x is not null)"))
    by_label = by_class.select("part", label.alias("label"), *(f"s{w}" for w in range(MASKS))).groupBy("part", "label").agg(*(F.sum(f"s{w}").alias(f"s{w}") for w in range(MASKS)))
    return by_label.select("part", "label", F.array(*(f"s{w}" for w in range(MASKS))).alias("parities"))


def _masks() -> Column:
    return F.sequence(F.lit(0), F.lit(MASKS - 1))


def _total(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0).cast("long"), lambda a, x: a + x)


def cells(parities: Column) -> Column:
    """How many documents have each of the 32 masks: the transform of the parities, over 32, which divides it."""
    return F.transform(_masks(), lambda m: F.shiftright(_total(F.zip_with(parities, _masks(), lambda s, w: s * _sign(m, w))), len(FILTERS)))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs (doc_id, text, lang, any more), labels (doc_id, quality, toxic, any more). A part is a value of lang, null as the
    empty string. A null text counts as empty; a row that repeats doc_id and text is a document of its own with
    the same answers. A document is good or toxic if any label row of its id says so; without an id it is neither. Empty
    docs give no rows. Texts of any length are judged whole.
    """
    prepare(docs.sparkSession)
    none = F.transform(_masks(), lambda m: F.lit(0).cast("long"))
    by_part = parity_sums(docs, labels).groupBy("part").agg(*(F.first(F.when(F.col("label") == x, F.col("parities")), ignorenulls=True).alias(x) for x in LABELS))
    by_part = by_part.select("part", *(cells(F.coalesce(x, none)).alias(x) for x in LABELS))
    steps = by_part.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))

    def bits(holds: Callable[[Column], Column]) -> Column:
        """The mask of the filters whose place in the order fits."""
        return sum((F.when(holds(F.instr("filter_order", f)), 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0)).cast("int")

    steps = steps.withColumn("own", bits(lambda at: at == F.col("step"))).withColumn("before", bits(lambda at: at < F.col("step")))
    own, before = F.col("own"), F.col("before")

    def over(label: str, holds: Callable[[Column], Column]) -> Column:
        return _total(F.zip_with(label, _masks(), lambda c, m: F.when(holds(m), c).otherwise(0)))

    fails, gone = (lambda m: m.bitwiseAND(own) != 0), (lambda m: m.bitwiseAND(before) != 0)
    here = lambda m: fails(m) & ~gone(m)
    shapley = _total(F.zip_with("all", _masks(), lambda c, m: F.when(fails(m), c * (F.lit(len(ORDERS)) / F.bit_count(m)).cast("long")).otherwise(0)))
    return steps.select(
        "part", "filter_order", "step", over("all", lambda m: ~fails(m) & ~gone(m)).alias("kept"), over("all", here).alias("removed"), over("all", lambda m: fails(m) & gone(m)).alias("redundant"),
        F.element_at("all", own + 1).alias("unique_fails"), over("good", here).alias("good_lost"), over("toxic", here).alias("toxic_lost"), shapley.alias("shapley"),
    )


ORACLE_SQL = r"""
    WITH texts AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    failures AS (
        SELECT t.doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
               100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
               coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false) AS e,
               coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
        FROM texts t LEFT JOIN (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id) l ON t.doc_id = l.doc_id),
    groups AS (
        SELECT part, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic
        FROM failures GROUP BY part, a, b, c, d, e),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
    orders AS (
        SELECT [p.f, q.f, r.f, s.f, t.f] AS line FROM letters p, letters q, letters r, letters s, letters t
        WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5),
    steps AS (SELECT line, unnest([1, 2, 3, 4, 5])::INT AS step FROM orders),
    judged AS (
        SELECT g.*, array_to_string(line, '') AS filter_order, step, line[step] AS letter, fails[line[step]] AS own,
               len(list_filter(line[1:step - 1], lambda x: fails[x])) > 0 AS gone, len(list_filter(line, lambda x: fails[x])) AS n_fails
        FROM groups g, steps),
    counted AS (
        SELECT part, filter_order, step, letter, sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
               sum(CASE WHEN own AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN own AND n_fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
               sum(CASE WHEN own AND NOT gone THEN n_good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN own AND NOT gone THEN n_toxic ELSE 0 END)::BIGINT AS toxic_lost
        FROM judged GROUP BY part, filter_order, step, letter)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM counted"""
