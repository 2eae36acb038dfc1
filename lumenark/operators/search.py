"""Text and vector search."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.functions import rules as R
from lumenark.functions import scalar as S


def top_k(vectors: DataFrame, query: list[float], k: int, vec: str = "vec", key: str = "id", digits: int | None = None) -> DataFrame:
    """The k rows most alike to the query (unit vectors), the larger key first among equals; each task keeps k.

    With digits scores are rounded before they are ranked, so that those shown as equal are equals.
    """
    q = F.array(*map(F.lit, map(float, query)))
    score = S.dot(vec, q)
    return vectors.withColumn("score", score if digits is None else F.round(score, digits)).orderBy(F.desc("score"), F.desc(key)).limit(k)


def semantic(vectors: DataFrame, files: DataFrame, query: list[float], k: int = 60, floor: float = R.RELEVANCE["neural"], digits: int | None = None, **filters: str | int) -> DataFrame:
    """Top k among files that pass the filters (columns of files), above the floor, with the files' columns.

    Filters go before the ranking; the floor after it. vectors (id, vec); files (id, any). digits: see top_k().
    """
    kept = files
    for column, value in filters.items():
        kept = kept.filter(F.col(column) == value)
    best = top_k(vectors.join(kept.select("id"), "id", "left_semi"), query, k, digits=digits).filter(F.col("score") > floor)
    return best.drop("vec").join(files, "id")


def text_search(vectors: DataFrame, files: DataFrame, query: str, k: int = 60, dates: bool = False, digits: int | None = None) -> DataFrame:
    """A written query against lexical embeddings: device and orientation in it filter, and year and month if dates are asked for; the rest ranks."""
    asked = vectors.sparkSession.range(1).select(S.query_filters(F.lit(query)).alias("q")).select("q.*", S.lexical_embedding(F.col("q.text")).alias("vec")).first()
    filters = {c: asked[c] for c in ("device", "orientation") if asked[c]}
    if dates:
        files = files.withColumns({"year": F.substring("month", 1, 4).try_cast("int"), "_month": F.substring("month", 6, 2).try_cast("int")})
        filters |= {c: asked[n] for c, n in (("year", "year"), ("_month", "month")) if asked[n]}
    return semantic(vectors, files, list(asked["vec"]), k, R.RELEVANCE["lexical"], digits, **filters)


def embed(files: DataFrame, backend=None) -> DataFrame:
    """(id, full_path, vec): lexical vectors of the paths, or those of a backend, a function from a list of paths to vectors called on Arrow batches."""
    if backend is None:
        return files.select("id", "full_path", S.lexical_embedding(S.path_words("full_path")).cast("array<float>").alias("vec"))

    def run(frames):
        for frame in frames:
            yield frame.assign(vec=[[float(x) for x in v] for v in backend(frame["full_path"].tolist())])

    return files.select("id", "full_path").mapInPandas(run, "id long, full_path string, vec array<float>").withColumn("vec", S.unit("vec").cast("array<float>"))


def captions(rows: DataFrame, query: str, limit: int | None = 60, caption: str = "caption", key: str = "file_id") -> DataFrame:
    """Rows whose caption holds every word of the query, as written, in any case."""
    words = query.lower().split()
    if not words:
        return rows.limit(0)
    found = rows.filter(reduce(and_, (F.lower(caption).contains(w) for w in words)))
    return found.orderBy(key).limit(limit) if limit else found


def keywords(tags: DataFrame, query: str, limit: int | None = 80, key: str = "full_path") -> DataFrame:
    """Tagged files by how many of the query's words their text, label and bucket hold; at least one."""
    tokens = S.search_tokens(query)
    hay = F.lower(F.concat_ws(" ", S.text("text_sample"), S.text("top_label"), S.text("content_bucket")))
    scored = tags.withColumns({"score": S.token_hits(tokens, hay), "snippet": S.snippet(S.text("text_sample"), tokens)}).filter("score > 0")
    return scored.orderBy(F.desc("score"), key).limit(limit) if limit else scored


def tagged(tags: DataFrame, bucket: str | None = None, limit: int = 300) -> DataFrame:
    """Tagged files of a bucket (or all), the surest first."""
    rows = tags.filter(F.col("content_bucket") == bucket) if bucket else tags
    return rows.orderBy(F.desc("top_conf"), "file_id").limit(limit)


def screenshots_to_move(tags: DataFrame, limit: int = 500) -> DataFrame:
    """Of the first `limit` screenshots and documents by id, those not in a folder of their kind."""
    listed = tags.filter(F.lower("content_bucket").isin(*R.SCREENSHOT_BUCKETS)).orderBy("file_id").limit(limit)
    return listed.filter(~S.contains_any(S.low("full_path"), R.SORTED_FOLDERS)).select("file_id", "full_path", "content_bucket", "top_label", F.substring(S.text("text_sample"), 1, 120).alias("text"))


def bucket_histogram(tags: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif("content_bucket", F.lit("")), F.lit("Unsorted"))
    return tags.groupBy(name.alias("content_bucket")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "content_bucket")


def tag(files: DataFrame, observations: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """Tags of files that are present: best label, text and bucket from observed labels (path, labels, texts).

    Of labels those with confidence 0.15 or more count, the five surest; of texts those of two or more characters,
    the first eight read, five joined.
    """
    there = files if present is None else files.join(present.select(F.col("path").alias("full_path")), "full_path", "left_semi")
    sure = F.slice(F.reverse(F.array_sort(F.transform(F.filter("labels", lambda x: x["conf"] >= 0.15), lambda x: F.struct(x["conf"].alias("conf"), x["id"].alias("id"))))), 1, 5)
    texts = F.slice(F.filter(F.slice("texts", 1, 8), lambda t: F.length(t) >= 2), 1, 5)
    seen = observations.select(F.col("path").alias("full_path"), sure.alias("labels"), F.array_join(texts, " | ").alias("text_sample"))
    joined = there.join(seen, "full_path", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<struct<conf: double, id: string>>")))
    has_text = S.text("text_sample") != ""
    return joined.select(F.col("id").alias("file_id"), "full_path", F.get("labels", F.lit(0))["id"].alias("top_label"), F.get("labels", F.lit(0))["conf"].alias("top_conf"), "labels", has_text.alias("has_text"), S.text("text_sample").alias("text_sample"), S.content_bucket(F.transform("labels", lambda x: x["id"]), has_text, F.col("text_sample")).alias("content_bucket"))


def caption(files: DataFrame, tags: DataFrame) -> DataFrame:
    """Captions made of tags, folder and file name."""
    t = tags.select("full_path", "content_bucket", "top_label", "text_sample")
    return files.join(t, "full_path", "left").select(F.col("id").alias("file_id"), "full_path", S.lexical_caption("full_path", F.col("content_bucket"), F.col("top_label"), F.col("text_sample")).alias("caption"), F.lit("lexical").alias("source"))
