"""Document fingerprints: threshold-scaled sketches of five-word shingles, in DataFrame functions only.

A sketch keeps every distinct shingle hash below a fixed fraction of the 64-bit range. Since the threshold is
the same for all texts, the union of two sketches is the sketch of both texts together, and the share of one
sketch that another holds estimates how much of one text the other contains, however unequal their
lengths. A text none of whose hashes is below the threshold has an empty sketch; its least hash is kept beside it, in a
column of its own that is no part of the sketch, and only tells two such texts apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenark.llm.common import cut, whole_text

SHINGLE = 5
#: One hash in so many is kept.
SCALE = 4
#: As a Spark SQL literal, which reads an escaped f as the letter.
SPACE = " \\t\\n\\u000B\\u000C\\r"


def _least_kept(scale: int) -> int:
    """Hashes are signed; those below this are kept."""
    return -(1 << 63) + (1 << 64) // scale


def with_sketch(df: DataFrame, text: str, name: str, scale: int = SCALE) -> DataFrame:
    """df and two columns: `name`, the sorted sketch of column `text` (not null), and `name`_least, null unless the
    sketch is empty though the text has words: its least hash.

    A shingle's hash is xxhash64 of its words in turn; a text of fewer than five words is one shingle.
    Words are what stands between ASCII white space, unchanged.
    """
    words, hashes = f"_{name}_words", f"_{name}_hashes"
    shingle = ", ".join(f"get({words}, i + {k})" for k in range(SHINGLE))  # xxhash64 passes over nulls
    return (
        df.withColumn(words, F.expr(f"split(trim(BOTH '{SPACE}' FROM {text}), '[\\\\x20\\\\x09-\\\\x0D]+')"))
        .withColumn(hashes, F.expr(f"IF({words}[0] = '', cast(array() AS array<bigint>), transform(sequence(0, greatest(size({words}) - {SHINGLE}, 0)), i -> xxhash64({shingle})))"))
        .drop(words)
        .withColumn(name, F.expr(f"sort_array(array_distinct(filter({hashes}, h -> h < {_least_kept(scale)}L)))"))
        .withColumn(f"{name}_least", F.expr(f"IF(size({name}) = 0, array_min({hashes}), NULL)"))
        .drop(hashes)
    )


def as_string(sketch: str) -> Column:
    """Comma-joined hashes in hex, in the sketch's order; for an empty one a tilde and the least hash, if there is one."""
    return F.expr(f"IF(size({sketch}) = 0, coalesce('~' || lpad(lower(hex({sketch}_least)), 16, '0'), ''), array_join(transform({sketch}, h -> lpad(lower(hex(h)), 16, '0')), ','))")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity; of two empty sketches 1 if their least hashes are the same (or both have none), or else 0."""
    both = f"size(array_intersect({a}, {b}))"
    return F.expr(f"CASE WHEN size({a}) = 0 AND size({b}) = 0 THEN IF({a}_least <=> {b}_least, 1D, 0D) ELSE {both} / cast(size({a}) + size({b}) - {both} AS double) END")


def containment(a: str, b: str) -> Column:
    """Estimated share of a's shingles that b has; for an empty a 1 if it has no words or b's least hash is the same, or else 0."""
    return F.expr(f"CASE WHEN size({a}) = 0 THEN IF({a}_least IS NULL OR coalesce({a}_least = {b}_least, false), 1D, 0D) ELSE size(array_intersect({a}, {b})) / cast(size({a}) AS double) END")


def merged(a: str, b: str) -> Column:
    """The sketch of two texts together, from theirs."""
    return F.expr(f"sort_array(array_union({a}, {b}))")


def next_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id): for each distinct doc_id but null the next larger one, for the last the first.

    Ids are dealt into ranges once and checkpointed; each range looks up its successors, and only the
    ranges' first ids (one for each partition) meet in one place.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = cut(docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().repartitionByRange(ranges, "doc_id").withColumn("part", F.spark_partition_id()))
    first = ids.groupBy("part").agg(F.min("doc_id").alias("first_id"))
    ordered = Window.orderBy("part")
    after = first.select("part", F.coalesce(F.lead("first_id").over(ordered), F.first("first_id").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).alias("after_id"))
    inside = ids.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    return inside.join(F.broadcast(after), "part").select("doc_id", F.coalesce("next_id", "after_id").alias("next_id"))  # after: a row a partition


def fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """One row per row of docs (doc_id, text, any more); see the module for the sketch.

    doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    held_by_edited, held_by_next. The edited text has its last quarter (rounded down) replaced by as
    many code points from the start of the next document by doc_id; the last document is followed by
    the first. near_ is the likeness to the edited text's and to the next document's sketch, held_by_ the
    containment in it. A null text counts as empty. A row with a null doc_id has no next document:
    its edited text only loses its end, near_next and held_by_next are 0. Where a doc_id
    repeats, the next document is the row with the least text. Texts of any length are read whole. Ids are numbered by
    jobs that run when this is called; the rest runs with the query.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    # Both joins read one shuffle of these by doc_id; sketches are made beyond it, or they would move with the texts.
    placed = texts.filter("doc_id IS NOT NULL")
    following = next_ids(texts)
    asked = texts.filter("doc_id IS NOT NULL").select("doc_id", F.expr("cast(floor(length(text) / 4) AS int)").alias("need"))
    counts = asked.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if counts[0] != counts[1]:
        asked = asked.groupBy("doc_id").agg(F.max("need").alias("need"))
    asked = asked.join(following, "doc_id").withColumnRenamed("doc_id", "for_id")
    # Renamed here, the shuffle of the other side (which renames, too) is the same to Spark and is used again.
    sources = placed.select(F.col("doc_id").alias("source_id"), "text")
    following = asked.hint("merge").join(sources, F.col("next_id") == F.col("source_id"))
    heads = with_sketch(following, "text", "next_sketch", scale).select("for_id", F.expr("substring(text, 1, need)").alias("head"), "next_sketch", "next_sketch_least")
    if counts[0] != counts[1]:
        heads = heads.groupBy("for_id").agg(F.min(F.struct("head", "next_sketch", "next_sketch_least")).alias("h")).select("for_id", "h.*")
    edited = placed.hint("merge").join(heads, F.col("doc_id") == F.col("for_id"), "left").drop("for_id")
    edited = edited.unionByName(texts.filter("doc_id IS NULL"), allowMissingColumns=True).withColumn("n_chars", F.expr("cast(length(text) AS bigint)"))
    edited = edited.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - floor(n_chars / 4) AS int)), substring(coalesce(head, ''), 1, cast(floor(n_chars / 4) AS int)))"))
    both = with_sketch(with_sketch(edited, "text", "sketch", scale), "edited", "edited_sketch", scale)
    none = F.lit(0.0)
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_string("sketch").alias("fingerprint"), as_string("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"), F.when(F.col("next_sketch").isNull(), none).otherwise(likeness("sketch", "next_sketch")).alias("near_next"),
        containment("sketch", "edited_sketch").alias("held_by_edited"), F.when(F.col("next_sketch").isNull(), none).otherwise(containment("sketch", "next_sketch")).alias("held_by_next"),
    )
