"""Which mounted volume an indexed drive is now."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenark.functions import rules as R
from lumenark.functions import scalar as S
from lumenark.sources.inventory import latest_roots

VOLUMES = "/Volumes"


def root_fingerprint(names: DataFrame, volume: str, name: str, limit: int = 200) -> DataFrame:
    """Per volume: its visible top-level names, sorted, the first `limit`, joined by |."""
    seen = names.filter(~F.col(name).startswith("."))
    return seen.groupBy(volume).agg(F.array_join(F.slice(F.sort_array(F.collect_set(name)), 1, limit), "|").alias("root_fingerprint"))


def overlap(expected: DataFrame, volumes: DataFrame) -> DataFrame:
    """(device_name, mount, uuid, score): per drive (device_name, top) the volume (mount, uuid, top) that holds most of its
    folder names, the smaller mount among equals; drives that share none are left out."""
    want = expected.select("device_name", F.array_distinct("top").alias("_want"))
    asked = want.select("device_name", F.size("_want").alias("_n"), F.explode("_want").alias("folder"))
    held = volumes.select("mount", "uuid", F.explode(F.array_distinct("top")).alias("folder"))
    shared = asked.join(held, "folder").groupBy("device_name", "mount", "uuid").agg((F.count("*") / F.first("_n")).alias("score"))
    best = Window.partitionBy("device_name").orderBy(F.desc("score"), "mount")
    return shared.withColumn("_k", F.row_number().over(best)).filter("_k = 1").drop("_k")


def matches(expected: DataFrame, volumes: DataFrame, least: float = R.MATCH_STRONG) -> DataFrame:
    """(device_name, mount, uuid, score): all volumes that hold at least the share `least` (over 0) of a drive's folder names, for many drives and volumes.

    A drive with n names that a volume holds m of, m >= least * n, shares one of its n - m + 1 rarest names with it. So only these are looked up,
    and only in volumes of at least m names; what meets is counted by all names. Names that nearly all volumes have are hardly ever looked up.
    """
    want = expected.select("device_name", F.array_distinct("top").alias("_want")).filter("device_name IS NOT NULL AND size(_want) > 0")
    held = volumes.select("mount", "uuid", F.array_distinct("top").alias("_held"))
    names = held.select(F.explode("_held").alias("folder")).groupBy("folder").agg(F.count("*").alias("_volumes"))
    asked = want.select("device_name", F.explode("_want").alias("folder")).join(names, "folder", "left")
    rarest = asked.groupBy("device_name").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("_volumes", F.lit(0)).alias("n"), "folder"))), lambda x: x["folder"]).alias("_rare"))
    need = F.ceil(F.size("_rare") * F.lit(float(least)) - 1e-9).cast("int")
    looked = rarest.withColumn("_need", need).select("device_name", "_need", F.explode(F.slice("_rare", 1, F.size("_rare") - F.col("_need") + 1)).alias("folder"))
    met = looked.join(held.select("mount", "uuid", F.size("_held").alias("_size"), F.explode("_held").alias("folder")), "folder").filter("_size >= _need").select("device_name", "mount", "uuid").distinct()
    shared = F.size(F.array_intersect("_want", "_held"))
    both = met.join(want, "device_name").join(held, ["mount", "uuid"]).withColumn("score", shared / F.size("_want"))
    return both.filter(F.col("score") >= least).select("device_name", "mount", "uuid", "score")


def resolve(drives: DataFrame, volumes: DataFrame, scan_roots: DataFrame, learned: DataFrame) -> DataFrame:
    """(device_name, status, via, mount, confidence, suggestion, renamed) for each drive of the inventory.

    In turn: the startup volume, the drive's name, the UUID seen at ingest, the UUID learned, the mount
    learned, and the share of its folder names a volume holds (one half is a match, less is ambiguous).
    """
    d = drives.withColumn("root_path", F.coalesce(F.nullif("root_path", F.lit("")), F.concat(F.lit(VOLUMES + "/"), "device_name")))
    roots = latest_roots(scan_roots).select(F.col("volume_name").alias("device_name"), F.nullif("volume_uuid", F.lit("")).alias("_seen"), F.nullif("root_fingerprint", F.lit("")).alias("_print"))
    known = learned.select("device_name", F.nullif("uuid", F.lit("")).alias("_uuid"), F.nullif("mount", F.lit("")).alias("_mount"))
    joined = d.join(roots, "device_name", "left").join(known, "device_name", "left")
    by_uuid = volumes.filter("uuid <> ''").groupBy("uuid").agg(F.min("mount").alias("m"))
    mounts = volumes.select("mount").distinct()
    for column, out in (("_seen", "_by_seen"), ("_uuid", "_by_uuid")):
        joined = joined.join(by_uuid.select(F.col("uuid").alias(column), F.col("m").alias(out)), column, "left")
    joined = joined.withColumn("_expected", F.concat(F.lit(VOLUMES + "/"), "device_name"))
    for column, out in (("_expected", "_by_name"), ("_mount", "_by_mount")):
        joined = joined.join(mounts.select(F.col("mount").alias(column), F.col("mount").alias(out)), column, "left")
    wanted = joined.select("device_name", F.array_union(F.coalesce("top", F.array().cast("array<string>")), F.when(F.col("_print").isNotNull(), F.split("_print", r"\|")).otherwise(F.array().cast("array<string>"))).alias("top"))
    found = overlap(wanted, volumes).select("device_name", F.col("mount").alias("_alike"), F.col("score").alias("_score"))
    joined = joined.join(found, "device_name", "left")
    via = (
        F.when(F.col("device_name").isin("/", "") | (F.col("root_path") == "/"), "local").when(F.col("_by_name").isNotNull(), "name").when(F.col("_by_seen").isNotNull(), "uuid-ingest")
        .when(F.col("_by_uuid").isNotNull(), "uuid").when(F.col("_by_mount").isNotNull(), "learned").when(F.col("_score").isNotNull(), "fingerprint")
    )
    v = F.col("via")
    weak = (v == "fingerprint") & (F.col("_score") < R.MATCH_STRONG)
    out = joined.withColumn("via", via).withColumn("status", F.when(v.isNull(), "absent").when(weak, "ambiguous").otherwise("matched"))
    mount = F.when(v == "local", "/").when(v == "name", F.col("_by_name")).when(v == "uuid-ingest", F.col("_by_seen")).when(v == "uuid", F.col("_by_uuid")).when(v == "learned", F.col("_by_mount")).when((v == "fingerprint") & ~weak, F.col("_alike"))
    out = out.withColumn("mount", mount)
    return out.select("device_name", "status", "via", "mount", F.when(v == "fingerprint", F.col("_score")).alias("confidence"), F.when(weak, F.col("_alike")).alias("suggestion"), F.coalesce(~v.isin("local", "name") & F.col("mount").isNotNull(), F.lit(False)).alias("renamed"))


def identity_report(drives: DataFrame, resolved: DataFrame, scan_roots: DataFrame) -> DataFrame:
    """Drives by bytes, with how they were resolved and whether ingest saw a UUID."""
    roots = latest_roots(scan_roots).select(F.col("volume_name").alias("device_name"), (S.text("volume_uuid") != "").alias("has_uuid"))
    return drives.select("device_name", "files", "bytes").join(resolved, "device_name").join(roots, "device_name", "left").withColumn("has_uuid", F.coalesce("has_uuid", F.lit(False))).orderBy(F.desc("bytes"), "device_name")


def remembered(learned: DataFrame, matches: DataFrame) -> DataFrame:
    """learned after matches (device_name, mount, uuid): new mounts, and new UUIDs where they are known."""
    new = matches.select("device_name", F.col("mount").alias("_mount"), F.nullif("uuid", F.lit("")).alias("_uuid"))
    return learned.join(new, "device_name", "full").select("device_name", F.coalesce("_mount", "mount").alias("mount"), F.coalesce("_uuid", "uuid").alias("uuid"))


def mapped_by_hand(learned: DataFrame, device: str, mount: str, volumes: DataFrame) -> DataFrame:
    """learned after a user has said where a drive is; a mount that is not among volumes (mount, uuid) changes nothing."""
    match = volumes.filter((F.col("mount") == mount) & (F.lit(mount) != "")).select(F.lit(device).alias("device_name"), "mount", "uuid").limit(1)
    return remembered(learned, match)


def readable_paths(candidates: DataFrame, mounts: DataFrame, present: DataFrame) -> DataFrame:
    """(path, used_path): candidates (device, path, root) that are present as written, or else on the drive's mount now."""
    there = present.select(F.col("path").alias("_there")).distinct()
    placed = candidates.select("device", "path", "root").distinct().join(mounts.select(F.col("device_name").alias("device"), "mount"), "device", "left")
    placed = placed.withColumn("moved", S.rewritten("path", "root", "mount"))
    as_is = placed.join(there, F.col("path") == F.col("_there"), "left").withColumn("_as_is", F.col("_there").isNotNull()).drop("_there")
    on_mount = as_is.join(there, F.col("moved") == F.col("_there"), "left")
    return on_mount.withColumn("used_path", F.when(F.col("_as_is"), F.col("path")).when(F.col("mount").isNotNull() & F.col("_there").isNotNull(), F.col("moved"))).filter("used_path IS NOT NULL").select("path", "used_path").distinct()
