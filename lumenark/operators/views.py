"""Summaries kept up to date: totals, drives, and hashes with their copies, changed by what changed.

Of the inventory before and after a change only rows of touched keys are looked at: the old ones are retracted, the new ones added, group
by group. A hash's smallest copy is looked up again only if it may be the one that went. Rebuilding gives the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.sources.durable import checkpointed


@dataclass(frozen=True)
class Summaries:
    """totals, duplicates, unique: one row each, as dedupe.totals(), duplicate_groups() and unique_bytes() give. drives (device_name, files, bytes,
    sized), hashes (sha256, n, total, sized, one): sized counts files whose size is known, one is the smallest size."""

    totals: DataFrame
    drives: DataFrame
    hashes: DataFrame
    duplicates: DataFrame
    unique: DataFrame

    def drive_usage(self) -> DataFrame:
        """As dedupe.drive_usage()."""
        return self.drives.select("device_name", "files", F.when(F.col("sized") > 0, F.col("bytes")).alias("bytes")).orderBy(F.desc("bytes"), "device_name")


def _size() -> F.Column:
    return F.coalesce(F.col("file_size"), F.lit(0)).cast("long")


def _duplicates(hashes: DataFrame) -> DataFrame:
    """What hashes add to duplicates and unique."""
    several = F.col("n") > 1
    return hashes.agg(
        F.count_if(several).alias("dup_groups"), F.coalesce(F.sum(F.when(several, F.col("n"))), F.lit(0)).alias("dup_files"), F.coalesce(F.sum(F.when(several & (F.col("sized") > 0), F.col("total") - F.col("one"))), F.lit(0)).alias("reclaim_bytes"),
        F.count("*").alias("unique_files"), F.coalesce(F.sum("one"), F.lit(0)).alias("unique_bytes"),
    )


def build(files: DataFrame) -> Summaries:
    """From the whole inventory (device_name, sha256, file_size, any more)."""
    size, sized = F.sum(_size()), F.count("file_size")
    drives = checkpointed(files.groupBy("device_name").agg(F.count("*").alias("files"), size.alias("bytes"), sized.alias("sized")))
    hashes = checkpointed(files.filter("sha256 <> ''").groupBy("sha256").agg(F.count("*").alias("n"), size.alias("total"), sized.alias("sized"), F.min(F.col("file_size").cast("long")).alias("one")))
    totals = drives.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("total_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"))
    counted = _duplicates(hashes)
    return Summaries(totals, drives, hashes, counted.select("dup_groups", "dup_files", "reclaim_bytes"), counted.select("unique_files", "unique_bytes"))


def _plus(one: DataFrame, *signed: tuple[int, DataFrame]) -> DataFrame:
    """One row with the sums of one-row tables."""
    rows = one
    for sign, other in signed:
        rows = rows.unionByName(other.select(*((F.col(c) * sign).alias(c) for c in one.columns)))
    return rows.agg(*(F.sum(c).alias(c) for c in one.columns))


def update(old: Summaries, before: DataFrame, after: DataFrame, touched: DataFrame, key: str = "full_path") -> Summaries:
    """Summaries of `after` from those of `before`; touched (key): every key whose rows differ, and any others.

    before and after may be parts of the inventory, as long as they hold all rows of touched keys; `after` has also to hold all files of a hash
    of which a touched row held the smallest copy. Keys that are null are touched if touched has a null. What is returned is cut off from its making.
    """
    columns = ["device_name", "sha256", "file_size"]
    keys = touched.select(F.col(key).alias("_k")).distinct()

    def rows(of: DataFrame, sign: int) -> DataFrame:
        return of.join(keys, F.col(key).eqNullSafe(F.col("_k")), "left_semi").select(*columns, F.lit(sign).cast("long").alias("_s"))

    signed = checkpointed(rows(before, -1).unionByName(rows(after, 1)))
    n, size, sized = F.sum("_s"), F.sum(F.col("_s") * _size()), F.sum(F.when(F.col("file_size").isNotNull(), F.col("_s")).otherwise(0))
    moved = signed.groupBy("device_name").agg(n.alias("files"), size.alias("bytes"), sized.alias("sized"))
    drives = checkpointed(old.drives.unionByName(moved).groupBy("device_name").agg(*(F.sum(c).alias(c) for c in ("files", "bytes", "sized"))).filter("files > 0"))
    totals = _plus(old.totals, (1, moved.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("total_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"))))

    least = lambda sign: F.min(F.when(F.col("_s") == sign, F.col("file_size").cast("long")))
    change = checkpointed(signed.filter("sha256 <> ''").groupBy("sha256").agg(n.alias("dn"), size.alias("dt"), sized.alias("ds"), least(1).alias("came"), least(-1).alias("went")))
    was = old.hashes.join(change.select("sha256"), "sha256", "left_semi")
    now = change.join(was, "sha256", "left").select(
        "sha256", (F.coalesce("n", F.lit(0)) + F.col("dn")).alias("n"), (F.coalesce("total", F.lit(0)) + F.col("dt")).alias("total"), (F.coalesce("sized", F.lit(0)) + F.col("ds")).alias("sized"), "one", "came", "went",
    ).filter("n > 0")
    # Unless the smallest copy went and none as small came, it is the smallest of what there was and what came.
    unsure = F.coalesce((F.col("went") <= F.col("one")) & (F.col("came").isNull() | (F.col("came") > F.col("one"))), F.lit(False))
    now = checkpointed(now.withColumn("_unsure", unsure))
    again = after.join(now.filter("_unsure").select("sha256"), "sha256", "left_semi").groupBy("sha256").agg(F.min(F.col("file_size").cast("long")).alias("found"))
    renewed = now.join(again, "sha256", "left").withColumn("one", F.when(F.col("_unsure"), F.col("found")).otherwise(F.least("one", "came"))).select("sha256", "n", "total", "sized", "one")
    renewed, was = checkpointed(renewed), checkpointed(was)
    hashes = checkpointed(old.hashes.join(change.select("sha256"), "sha256", "left_anti").unionByName(renewed))
    less, more = _duplicates(was), _duplicates(renewed)
    duplicates, unique = (_plus(table, (-1, less.select(*table.columns)), (1, more.select(*table.columns))) for table in (old.duplicates, old.unique))
    return Summaries(checkpointed(totals), drives, hashes, checkpointed(duplicates), checkpointed(unique))
