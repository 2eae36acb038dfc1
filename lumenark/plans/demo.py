"""A media inventory derived from the test tables by arithmetic, in SQL that Spark and DuckDB both run.

The engine takes any tables of the schemas; these exist so that every operator has data to run over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Only the hash function's name differs between the dialects.
SPARK = {"sha": "sha2(text, 256)"}
DUCKDB = {"sha": "sha256(text)"}

FILES_SQL = """
SELECT id, root_path || '/' || folder || CASE WHEN g % 3 = 0 THEN '/DCIM/' ELSE '/' END || file_name AS full_path, file_name, extension, file_size,
       '2024-01-01T00:00:00' AS created_time, sha256, root_path, device_name, CASE WHEN id % 29 = 0 THEN '2025-01-1' || cast(id % 10 AS string) || ' 00:00:00' END AS deleted_at
FROM (
    SELECT *, '/Volumes/' || device_name AS root_path, prefix || cast(g AS string) || extension AS file_name
    FROM (
        SELECT doc_id AS id, g, n_chars AS file_size, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE {sha} END AS sha256,
               CASE g % 5 WHEN 0 THEN 'T7 SSD2' WHEN 1 THEN 'T7 SSD1' WHEN 2 THEN 'Past T9' WHEN 3 THEN 'Current T9' ELSE 'Archive' END AS device_name,
               CASE g % 12 WHEN 0 THEN 'Costa Rica 2024' WHEN 1 THEN 'iceland_trip' WHEN 2 THEN 'Sony Camera 15' WHEN 3 THEN 'Unsorted' WHEN 4 THEN 'o''neil fall-2024 vik_a'
                           WHEN 5 THEN 'Wedding exports' WHEN 6 THEN 'drone' WHEN 7 THEN '__' WHEN 8 THEN 'Paris' WHEN 9 THEN 'Office Mac' WHEN 10 THEN 'untitled' ELSE 'lake  house__trip3x' END AS folder,
               CASE g % 7 WHEN 0 THEN 'DSC' WHEN 1 THEN 'DJI_' WHEN 2 THEN 'IMG_' WHEN 3 THEN 'GX01' WHEN 4 THEN 'final-' WHEN 5 THEN '._x' ELSE 'VID_' END AS prefix,
               CASE doc_id % 11 WHEN 0 THEN '.arw' WHEN 1 THEN '.jpg' WHEN 2 THEN '.MP4' WHEN 3 THEN '.xmp' WHEN 4 THEN '.dng' WHEN 5 THEN '.heic' WHEN 6 THEN '.thm' WHEN 7 THEN '.png'
                                WHEN 8 THEN '.zzz' WHEN 9 THEN '.mov' ELSE '.insv' END AS extension
        FROM (SELECT *, cast(floor(doc_id / 4) AS bigint) AS g FROM documents) a
    ) b
) c"""

METADATA_SQL = """
SELECT doc_id AS file_id, CASE doc_id % 4 WHEN 0 THEN '2024:06:0' || cast(1 + g % 9 AS string) || ' 10:00:00' WHEN 1 THEN '2023-0' || cast(1 + g % 9 AS string) || '-01' WHEN 2 THEN ' ' ELSE NULL END AS capture_date,
       CASE g % 3 WHEN 0 THEN '2022-05-05' ELSE NULL END AS creation_date,
       CASE doc_id % 8 WHEN 0 THEN 'SONY' WHEN 1 THEN 'Apple' WHEN 2 THEN 'DJI' WHEN 3 THEN 'Canon' WHEN 4 THEN 'Hasselblad' WHEN 5 THEN '' ELSE NULL END AS camera_make,
       CASE g % 6 WHEN 0 THEN 'ILCE-7M4' WHEN 1 THEN 'iPhone 15' WHEN 2 THEN 'Osmo Pocket 3' WHEN 3 THEN 'HERO11' WHEN 4 THEN 'L3D-100c' ELSE NULL END AS camera_model,
       CASE WHEN doc_id % 10 = 0 THEN 0 WHEN doc_id % 10 = 1 THEN NULL ELSE 1000 + doc_id % 5 * 1000 END AS image_width, 3000 AS image_height,
       CASE g % 7 WHEN 0 THEN cast(64.1 AS double) + cast(doc_id % 10 AS double) / 100 WHEN 1 THEN cast(0 AS double) WHEN 2 THEN cast(5 AS double) WHEN 3 THEN cast(-16.5 AS double) WHEN 4 THEN cast(48.9 AS double) ELSE NULL END AS gps_latitude,
       CASE g % 7 WHEN 0 THEN cast(-21.9 AS double) WHEN 1 THEN cast(0 AS double) WHEN 2 THEN cast(-140 AS double) WHEN 3 THEN cast(-151.7 AS double) WHEN 4 THEN cast(2.3 AS double) + cast(doc_id % 9 AS double) / 50 ELSE NULL END AS gps_longitude,
       CASE g % 9 WHEN 0 THEN '{{"AbsoluteAltitude": 12}}' WHEN 1 THEN '{{"Software": "adobe lightroom 6"}}' WHEN 2 THEN '{{"Orientation": 6}}' WHEN 3 THEN '{{"Orientation":8}}' WHEN 4 THEN '{{"Orientation": 1}}' ELSE NULL END AS raw_metadata_json
FROM (SELECT *, cast(floor(doc_id / 4) AS bigint) AS g FROM documents) a
WHERE n_chars >= 100"""

OVERRIDES_SQL = """
SELECT 'T7 SSD2::Costa Rica 2024' AS key, 'Pura Vida' AS trip, '' AS category UNION ALL SELECT 'Past T9::Sony Camera 15', '', 'events'
UNION ALL SELECT 'Archive::drone', 'Flights', 'personal'"""

TAGS_SQL = """
SELECT id AS file_id, full_path, CASE id % 6 WHEN 0 THEN 'Receipt_paper' WHEN 1 THEN 'portrait' WHEN 2 THEN 'Scarf' WHEN 3 THEN 'sea_lion' WHEN 4 THEN 'thing' ELSE NULL END AS top_label, cast(id % 100 AS double) / 100 AS top_conf,
       CASE id % 5 WHEN 0 THEN 'Documents' WHEN 1 THEN 'People' WHEN 2 THEN 'Screenshots' WHEN 3 THEN '' ELSE NULL END AS content_bucket, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN 'ab' ELSE text END AS text_sample
FROM (SELECT f.*, d.text FROM files f JOIN documents d ON f.id = d.doc_id) t"""

TABLES = {"files": FILES_SQL, "metadata": METADATA_SQL, "overrides": OVERRIDES_SQL, "tags": TAGS_SQL}


def spark_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of TABLES, or a table of sf_dir, as a DataFrame; views made on the way are named after the folder."""
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = TABLES[name].format(**SPARK)
    args = {n: spark_table(spark, sf_dir, n) for n in ("documents", "files") if f" {n} " in sql.replace("\n", " ").replace(")", " ")}
    for n in args:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    # Braces of JSON literals are doubled again for the formatter.
    for marks in ('{"AbsoluteAltitude": 12}', '{"Software": "adobe lightroom 6"}', '{"Orientation": 6}', '{"Orientation":8}', '{"Orientation": 1}'):
        sql = sql.replace(marks, "{" + marks + "}")
    return spark.sql(sql, **args) if args else spark.sql(sql)


def duckdb_with(*names: str) -> str:
    """WITH clause that defines the named tables."""
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n].format(**DUCKDB)})" for n in names)
