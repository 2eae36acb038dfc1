"""SQL for DuckDB that states, independently of the operators, what the queries must return."""

from __future__ import annotations

from lumenark.functions import rules as R
from lumenark.plans import demo


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(map(_q, values)) + ")"


def _any(c: str, parts) -> str:
    return "(" + " OR ".join(f"contains({c}, {_q(p)})" for p in parts) + ")"


def _case(pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {default} END"


REST = "replace(full_path, root_path || '/', '')"
BUCKET = _case(((f"e IN {_in(x)}", _q(b)) for b, x in R.BUCKETS.items()), "'other'")
DEVICE = """CASE
    WHEN e IN ('.insv', '.insp') OR contains(mk, 'insta360') OR contains(mk, 'arashi') OR contains(md, 'insta360') OR contains(md, 'one x') OR contains(md, 'one r') OR md IN ('x3', 'x4', 'x5') THEN 'Insta360'
    WHEN contains(md, 'osmo') OR contains(md, 'pocket') OR contains(mk, 'osmo') THEN 'Osmo Pocket'
    WHEN contains(mk, 'gopro') OR contains(md, 'hero') OR e = '.gpr' OR regexp_matches(n, '^(gopr|gx|gh|gp|gs)[0-9]') THEN 'GoPro'
    WHEN contains(mk, 'dji') OR starts_with(md, 'fc') OR contains(md, 'l3d') OR starts_with(n, 'dji_') OR (has_altitude AND e IN ('.dng', '.mp4', '.mov', '.jpg')) THEN 'Drone'
    WHEN contains(mk, 'sony') OR contains(md, 'ilce') OR e = '.arw' OR starts_with(n, 'dsc') THEN 'Sony'
    WHEN contains(mk, 'apple') OR contains(md, 'iphone') OR e = '.heic' OR (starts_with(n, 'img_') AND e IN ('.heic', '.mov', '.jpg')) THEN 'iPhone'
    WHEN contains(mk, 'canon') THEN 'Canon' WHEN contains(mk, 'hasselblad') THEN 'Hasselblad' ELSE 'Unknown' END"""
STAGE = f"""CASE WHEN e IN {_in(R.STAGE_SIDECARS)} THEN 'sidecar' WHEN e = '.prproj' OR edited_sw OR regexp_matches(n, {_q(R.EDITED_NAME)}) OR {_any("lower(top_folder)", R.EDITED_FOLDER)} THEN 'edited' ELSE 'original' END"""
MONTH = "coalesce(" + ", ".join(f"CASE WHEN length(trim({c})) >= 7 THEN substr(replace(trim({c}), ':', '-'), 1, 7) END" for c in ("capture_date", "creation_date")) + ", '')"
TITLE = r"array_to_string(list_transform(range(1, length(t) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(substr(t, i - 1, 1), '\p{L}') THEN upper(substr(t, i, 1)) ELSE lower(substr(t, i, 1)) END), '')"


def rule(which: int, default: str) -> str:
    return _case(((f"regexp_matches(nm, {_q(r[0])}, 'i')", _q(r[which])) for r in R.TRIP_RULES), default)


ENRICHED = f"""
base AS (
    SELECT f.id, full_path, file_name, extension, file_size, sha256, device_name, root_path, CASE WHEN instr({REST}, '/') > 0 THEN substr({REST}, 1, instr({REST}, '/') - 1) ELSE {REST} END AS top_folder,
           capture_date, creation_date, camera_make AS make, camera_model AS model, image_width AS width, image_height AS height, gps_latitude, gps_longitude,
           coalesce({_any("lower(raw_metadata_json)", [R.ALTITUDE_MARK.lower()])}, false) AS has_altitude, coalesce({_any("lower(raw_metadata_json)", [s.lower() for s in R.EDITING_SOFTWARE])}, false) AS edited_sw,
           coalesce({_any("lower(raw_metadata_json)", [s.lower() for s in R.ROTATED_MARKS])}, false) AS rotated,
           lower(coalesce(extension, '')) AS e, lower(coalesce(camera_make, '')) AS mk, lower(coalesce(camera_model, '')) AS md, lower(coalesce(file_name, '')) AS n
    FROM files f LEFT JOIN metadata m ON f.id = m.file_id WHERE deleted_at IS NULL),
enriched AS (
    SELECT *, {DEVICE} AS device, {STAGE} AS stage, {BUCKET} AS bucket, {MONTH} AS month,
           CASE WHEN coalesce(width, 0) <= 0 OR coalesce(height, 0) <= 0 THEN 'Unknown' WHEN CASE WHEN rotated THEN height >= width ELSE width >= height END THEN 'Horizontal' ELSE 'Vertical' END AS orientation
    FROM base)"""

PLACES = "places(i, place, plat, plon) AS (VALUES " + ", ".join(f"({i}, {_q(n)}, {a}::DOUBLE, {o}::DOUBLE)" for i, (n, a, o) in enumerate(R.PLACES)) + ")"
LABELLED = f"""
{PLACES},
near AS (
    SELECT id, arg_min(place, struct_pack(km := km, i := i)) AS place FROM (
        SELECT id, i, place, 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(plat - gps_latitude) / 2), 2) + cos(radians(gps_latitude)) * cos(radians(plat)) * pow(sin(radians(plon - gps_longitude) / 2), 2)))) AS km
        FROM enriched, places WHERE gps_latitude IS NOT NULL AND gps_longitude IS NOT NULL AND NOT (gps_latitude = 0 AND gps_longitude = 0)) k
    WHERE km < {R.PLACE_KM} GROUP BY id),
named AS (
    SELECT id, nm, {rule(2, "'trips'")} AS c0, {rule(1, f"CASE WHEN t = '' THEN '(root)' ELSE {TITLE} END")} AS l0
    FROM (SELECT id, nm, regexp_replace(trim(regexp_replace(nm, '_+', ' ', 'g')), '\\s+', ' ', 'g') AS t FROM (SELECT id, CASE WHEN coalesce(top_folder, '') = '' THEN '(root)' ELSE top_folder END AS nm FROM enriched) x) y),
labelled AS (
    SELECT e.*, coalesce(nullif(o.trip, ''), CASE WHEN c0 IN ('camera-dumps', 'unsorted') THEN coalesce(place, CASE WHEN c0 = 'camera-dumps' THEN 'Camera Dump' ELSE 'Unsorted' END) || CASE WHEN month = '' THEN '' ELSE ' ' || substr(month, 1, 4) END ELSE l0 END) AS trip,
           coalesce(nullif(o.category, ''), c0) AS category, place
    FROM enriched e JOIN named USING (id) LEFT JOIN near USING (id) LEFT JOIN overrides o ON o.key = device_name || '::' || top_folder)"""


def enriched_with(sql: str) -> str:
    return f"{demo.duckdb_with('files', 'metadata')}, {ENRICHED} {sql}"


def labelled_with(sql: str) -> str:
    return f"{demo.duckdb_with('files', 'metadata', 'overrides')}, {ENRICHED}, {LABELLED} {sql}"


RANK = _case(((f"device_name = {_q(d)}", str(r)) for d, r in R.DRIVE_PREFERENCE.items()), str(R.OTHER_DRIVE))
KEY = "coalesce(nullif(sha256, ''), '__nh' || id)"
STEM = r"regexp_replace(file_name, '^(.+)\.[^.]+$', '\1')"
DIR = r"regexp_replace(full_path, '/+[^/]*$', '')"
JUNK = "(starts_with(file_name, '._') OR file_name = '.DS_Store')"
MEDIA_LEAF = "CASE WHEN stage = 'edited' THEN 'edited/' ELSE 'raw/' END || CASE bucket WHEN 'other' THEN 'other/' || device WHEN 'videos' THEN 'videos/' || device || '/' || orientation ELSE 'images/' || device || '/' || orientation END"
LAYOUT = f"""
parents AS (
    SELECT dir, stem, arg_min(leaf, rk * 1000000000 + id) AS leaf FROM (
        SELECT id, {DIR} AS dir, lower({STEM}) AS stem, CASE bucket WHEN 'raw' THEN 0 WHEN 'photos' THEN 1 ELSE 2 END AS rk, coalesce(CASE WHEN e IN {_in(R.PROXY_EXTENSIONS)} THEN '' ELSE {MEDIA_LEAF} END, '') AS leaf
        FROM labelled WHERE bucket IN ('raw', 'photos', 'videos') AND NOT {JUNK}) p GROUP BY ALL),
laid AS (
    SELECT l.*, CASE WHEN {JUNK} OR e IN {_in(R.PROXY_EXTENSIONS)} THEN NULL WHEN bucket = 'sidecar' THEN coalesce(nullif(leaf, ''), '_Sidecars') ELSE {MEDIA_LEAF} END AS dest_rel
    FROM labelled l LEFT JOIN parents ON e IN {_in(R.PAIRED_SIDECARS)} AND dir = {DIR} AND stem = lower({STEM}))"""

DOCS_AS_FILES = "docs AS (SELECT doc_id AS id, text, sha256(text) AS sha256, source AS device_name, 'doc-' || doc_id AS file_name, '/' || source || '/doc-' || doc_id AS full_path, n_chars AS file_size, lang FROM documents)"
