"""Scalar rules as Column builders; all run inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenark.functions import rules as R


def text(c: Column | str) -> Column:
    """Null as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def low(c: Column | str) -> Column:
    return F.lower(text(c))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often, and in whatever lambda, it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def contains_any(c: Column, parts: Iterable[str]) -> Column:
    return reduce(or_, (c.contains(p) for p in parts))


def first_match(branches: Iterable[tuple[Column, str | int]], default) -> Column:
    """The value of the first branch that holds."""
    out = None
    for condition, value in branches:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default)


# --- files ------------------------------------------------------------------------------------------


def bucket(ext: Column | str) -> Column:
    e = low(ext)
    return first_match(((e.isin(*exts), name) for name, exts in R.BUCKETS.items()), "other")


def device(make: Column | str, model: Column | str, ext: Column | str, name: Column | str, altitude: Column) -> Column:
    """Camera family; the order of the branches is the rule."""
    mk, md, e, n = low(make), low(model), low(ext), low(name)
    return first_match(
        (
            (e.isin(".insv", ".insp") | contains_any(mk, ("insta360", "arashi")) | contains_any(md, ("insta360", "one x", "one r")) | md.isin("x3", "x4", "x5"), "Insta360"),
            (contains_any(md, ("osmo", "pocket")) | mk.contains("osmo"), "Osmo Pocket"),
            (mk.contains("gopro") | md.contains("hero") | (e == ".gpr") | n.rlike(R.GOPRO_NAME), "GoPro"),
            (mk.contains("dji") | md.startswith("fc") | md.contains("l3d") | n.startswith("dji_") | (altitude & e.isin(".dng", ".mp4", ".mov", ".jpg")), "Drone"),
            (mk.contains("sony") | md.contains("ilce") | (e == ".arw") | n.startswith("dsc"), "Sony"),
            (mk.contains("apple") | md.contains("iphone") | (e == ".heic") | (n.startswith("img_") & e.isin(".heic", ".mov", ".jpg")), "iPhone"),
            (mk.contains("canon"), "Canon"),
            (mk.contains("hasselblad"), "Hasselblad"),
        ),
        "Unknown",
    )


def stage(ext: Column | str, name: Column | str, edited: Column, folder: Column | str) -> Column:
    e = low(ext)
    return first_match(((e.isin(*R.STAGE_SIDECARS), "sidecar"), ((e == ".prproj") | edited | low(name).rlike(R.EDITED_NAME) | contains_any(low(folder), R.EDITED_FOLDER), "edited")), "original")


def orientation(width: Column | str, height: Column | str, rotated: Column) -> Column:
    w, h = (F.coalesce((F.col(c) if isinstance(c, str) else c).try_cast("long"), F.lit(0)) for c in (width, height))
    return F.when((w <= 0) | (h <= 0), "Unknown").when(F.when(rotated, h >= w).otherwise(w >= h), "Horizontal").otherwise("Vertical")


def year_month(*dates: str) -> Column:
    """YYYY-MM of the first date that is long enough, else empty."""
    return F.coalesce(*(F.when(F.length(F.trim(d)) >= 7, F.substring(F.replace(F.trim(d), F.lit(":"), F.lit("-")), 1, 7)) for d in dates), F.lit(""))


def metadata_flag(json: Column | str, marks: Iterable[str]) -> Column:
    """Whether raw metadata holds any of the marks, in any case."""
    return contains_any(low(json), (m.lower() for m in marks))


def top_folder(path: str = "full_path", root: str = "root_path") -> Column:
    """First segment after the root; the whole rest if there is none."""
    rest = f"replace({path}, concat({root}, '/'), '')"
    return F.expr(f"CASE WHEN instr({rest}, '/') > 0 THEN substr({rest}, 1, instr({rest}, '/') - 1) ELSE {rest} END")


def basename(path: Column | str) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def dirname(path: Column | str) -> Column:
    return F.regexp_replace(path, "/+[^/]*$", "")


def stem(name: Column | str) -> Column:
    """A name without its last extension; a leading dot is part of the name."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def suffix(name: Column | str) -> Column:
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def mime(ext: Column | str) -> Column:
    return F.when(bucket(ext) == "videos", F.concat(F.lit("video/"), F.ltrim(low(ext), F.lit(".")))).otherwise(F.concat(F.lit("image/"), F.ltrim(low(ext), F.lit("."))))


def path_id(path: Column | str) -> Column:
    """A file's synthetic id: the first 15 hex digits of its path's SHA-1."""
    return F.conv(F.substring(F.sha1(path), 1, 15), 16, 10).cast("long")


def volume_of(path: Column | str) -> Column:
    """The volume a path lies on; / for the startup volume."""
    name = F.regexp_extract(path, "^/Volumes/([^/]+)", 1)
    return F.when(name == "", "/").otherwise(name)


def rewritten(path: str, root: str, mount: str) -> Column:
    """A path moved from its root to the mount, if it starts with the root."""
    return F.expr(f"CASE WHEN coalesce({mount}, '') <> '' AND coalesce({root}, '') <> '' AND startswith({path}, {root}) THEN concat(rtrim('/', {mount}), substr({path}, length({root}) + 1)) ELSE {path} END")


def gib(bytes_: Column | str, digits: int) -> Column:
    """For presentation only; queries carry bytes."""
    return F.round((F.col(bytes_) if isinstance(bytes_, str) else bytes_) / float(R.GIB), digits)


# --- trips ------------------------------------------------------------------------------------------


def slug(name: Column | str) -> Column:
    s = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "Untitled").otherwise(s)


def title_case(name: Column) -> Column:
    """Upper case after anything but a letter, lower case after a letter."""

    def cased(letters: Column) -> Column:
        return F.transform(letters, lambda c, i: F.when((i == 0) | ~F.get(letters, i - 1).rlike(r"\p{L}"), F.upper(c)).otherwise(F.lower(c)))

    return F.array_join(let(F.split(name, ""), cased), "")


def _trip_name(folder: Column | str) -> Column:
    name = text(folder)
    return F.when(name == "", "(root)").otherwise(name)


def _rule(name: Column, which: int, default: Column) -> Column:
    return first_match(((name.rlike("(?iu)" + rule[0]), rule[which]) for rule in R.TRIP_RULES), default)


def trip_label(folder: Column | str) -> Column:
    name = _trip_name(folder)
    cleaned = F.regexp_replace(F.trim(F.regexp_replace(name, "_+", " ")), r"\s+", " ")
    return _rule(name, 1, F.when(cleaned == "", "(root)").otherwise(title_case(cleaned)))


def trip_category(folder: Column | str) -> Column:
    return _rule(_trip_name(folder), 2, F.lit("trips"))


def refined_trip(label: Column, category: Column, place: Column, month: Column) -> Column:
    """Card dumps and unsorted folders go by place and year."""
    base = F.coalesce(place, F.when(category == "camera-dumps", "Camera Dump").otherwise("Unsorted"))
    year = F.substring(month, 1, 4)
    return F.when(category.isin("camera-dumps", "unsorted"), F.when(year != "", F.concat_ws(" ", base, year)).otherwise(base)).otherwise(label)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.lit(2 * 6371.0) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def nearest_place(lat: Column | str, lon: Column | str) -> Column:
    """The nearest gazetteer entry within reach, the earlier one of two as near; null at (0, 0) and for nulls.

    The gazetteer is a literal array, so there is no join and nothing to send around.
    """
    lat, lon = ((F.col(c) if isinstance(c, str) else c).try_cast("double") for c in (lat, lon))
    places = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(a).alias("lat"), F.lit(o).alias("lon")) for n, a, o in R.PLACES))
    found = F.array_min(F.transform(places, lambda p, i: F.struct(haversine_km(lat, lon, p["lat"], p["lon"]).alias("km"), i.alias("i"), p["name"].alias("name"))))
    return F.when(lat.isNotNull() & lon.isNotNull() & ~((lat == 0) & (lon == 0)), let(found, lambda p: F.when(p["km"] < R.PLACE_KM, p["name"])))


def month_hint(trip: Column) -> Column:
    return first_match(((trip == name, month) for name, month in R.TRIP_MONTHS.items()), "")


def drive_rank(drive: Column | str, preference: Mapping[str, int] = R.DRIVE_PREFERENCE) -> Column:
    d = F.col(drive) if isinstance(drive, str) else drive
    return first_match(((d == name, rank) for name, rank in preference.items()), R.OTHER_DRIVE)


# --- search -----------------------------------------------------------------------------------------


def query_filters(query: Column | str) -> Column:
    """A search text's struct of device, orientation, year, month (null: not named) and the words left."""
    q = low(query)
    words = F.split(q, r"\s+")
    known = [*R.DEVICE_WORDS, *R.ORIENTATION_WORDS, *R.MONTHS]
    rest = F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*known) & ~w.rlike(r"^(19|20)\d{2}$")), " ")
    year = F.regexp_extract(q, r"\b((19|20)\d{2})\b", 1)

    def named(table: Mapping[str, str]) -> Column:
        return first_match(((q.rlike(rf"\b{word}\b"), value) for word, value in table.items()), F.lit(None))

    return F.struct(
        named(R.DEVICE_WORDS).alias("device"), named(R.ORIENTATION_WORDS).alias("orientation"), F.when(year != "", year.cast("int")).alias("year"),
        first_match(((q.contains(m), i + 1) for i, m in enumerate(R.MONTHS)), F.lit(None)).alias("month"), F.when(F.trim(rest) == "", F.col(query) if isinstance(query, str) else query).otherwise(F.trim(rest)).alias("text"),
    )


def path_words(path: Column | str) -> Column:
    """A path as words: no extension, separators as spaces, camel case split."""
    base = F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")
    return F.regexp_replace(F.regexp_replace(base, "[/_-]", " "), "([a-z])([A-Z])", "$1 $2")


def word_cells(words: Column) -> Column:
    """Cells of a text's words, by the SHA-1 of each."""
    tokens = F.regexp_extract_all(F.lower(words), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.transform(tokens, lambda t: F.conv(F.substring(F.sha1(t), 38, 3), 16, 10).cast("int") % R.EMBED_DIM)


def lexical_embedding(words: Column) -> Column:
    """Dense unit vector of a text's words; zeros for a text without any. A cell's sign is that of its upper half."""
    count = lambda cells: F.transform(F.sequence(F.lit(0), F.lit(R.EMBED_DIM - 1)), lambda i: F.size(F.filter(cells, lambda c: c == i)) * F.when(i >= R.EMBED_DIM // 2, 1.0).otherwise(-1.0))
    return unit(let(word_cells(words), count))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    with_norm = let(v, lambda a: F.struct(a.alias("v"), F.sqrt(dot(a, a)).alias("n")))
    return let(with_norm, lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(x.cast("double"))))


def search_tokens(query: str) -> list[str]:
    """A search text's words of two or more characters that say something."""
    return [t for t in re.findall(r"[a-z0-9%$.]+", query.lower()) if len(t) >= 2 and t not in R.SEARCH_STOP]


def token_hits(tokens: list[str], hay: Column) -> Column:
    """How many of the tokens the text holds."""
    return reduce(add, (hay.contains(t).cast("int") for t in tokens), F.lit(0))


def snippet(body: Column, tokens: list[str]) -> Column:
    """From 30 characters before the first token found to 70 after; the whole text if none is."""
    found = F.coalesce(*(F.nullif(F.instr(F.lower(body), t), F.lit(0)) for t in tokens), F.lit(None).cast("int"))
    start = F.greatest(F.lit(0), found - 31)
    return F.when(found.isNull(), body).otherwise(F.substr(body, start + 1, found + 69 - start))


def content_bucket(labels: Column, has_text: Column, sample: Column) -> Column:
    """labels: array of label names. Text with a document's label, or long enough, is a document."""
    names = F.transform(labels, F.lower)

    def any_of(words: Iterable[str]) -> Column:
        return F.exists(names, lambda n: n.rlike("|".join(words)))

    document = has_text & (any_of(R.BUCKET_KEYWORDS["Documents"]) | (F.length(text(sample)) > 12))
    return first_match(((document, "Documents"), *((any_of(words), name) for name, words in R.BUCKET_KEYWORDS.items())), "Unsorted")


def lexical_caption(path: Column | str, bucket_: Column, label: Column, sample: Column) -> Column:
    """Bucket, label, folder, up to six words of the name and the start of the text, comma-joined."""
    name = basename(path)
    words = F.filter(F.split(F.lower(stem(name)), r"[\s_\-.]+"), lambda t: (t != "") & ~t.rlike("^[0-9]+$") & ~t.isin(*R.CAPTION_STOP))
    parts = F.concat(F.array(text(bucket_), F.replace(text(label), F.lit("_"), F.lit(" ")), F.regexp_replace(basename(dirname(path)), "[_-]", " ")), F.slice(words, 1, 6), F.array(F.substring(text(sample), 1, 80)))
    caption = F.array_join(F.filter(parts, lambda p: p != ""), ", ")
    return F.when(caption == "", name).otherwise(caption)


def face_crop(bbox: str, width: str, height: str, pad: float = R.FACE_PAD) -> Column:
    """The pixels (x, y, w, h from the top left) around a face, padded and cut to the image; null if either side is under the least.

    bbox: x, y, w, h as shares of the image, from the bottom left.
    """
    x, y, w, h = (F.get(bbox, F.lit(k)) for k in range(4))
    left, top = F.greatest(F.lit(0.0), (x - w * pad) * F.col(width)), F.greatest(F.lit(0.0), (1.0 - y - h * (1 + pad)) * F.col(height))
    wide, high = F.least(w * (1 + 2 * pad) * F.col(width), F.col(width) - left), F.least(h * (1 + 2 * pad) * F.col(height), F.col(height) - top)
    return F.when((wide >= R.FACE_LEAST) & (high >= R.FACE_LEAST), F.struct(left.alias("x"), top.alias("y"), wide.alias("w"), high.alias("h")))
