"""Substring search for tables of queries: an index of the letters, pairs and triples that texts hold.

A word of a query is looked up by its rarest triple (or by itself, if it has three letters or fewer), the rows that hold one for each
word are joined, and the texts of what is left are asked for the words themselves. Answers equal those of a scan of all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenark.functions import rules as R
from lumenark.functions import scalar as S
from lumenark.sources.durable import checkpointed

LONGEST = 3
#: What parts the words of a query: any white space.
SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]+"


def _codes(text: str) -> np.ndarray:
    """The different grams of a text, as numbers: 21 bits a code point, the last the lowest, code points counted from one."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) + 1
    return np.unique(np.concatenate([sum(c[i : len(c) - n + 1 + i] << 21 * (n - 1 - i) for i in range(n)) for n in range(1, min(LONGEST, len(c)) + 1)] or [c]))


def _gram(code: int) -> str:
    return "".join(chr((code >> shift & (1 << 21) - 1) - 1) for shift in (42, 21, 0) if code >> shift)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, key): the different grams of each text; those of some texts are named together."""
    for batch in batches:
        found, begin, n = [], 0, 0

        def out(end: int) -> pa.RecordBatch:
            codes, at = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_inverse=True)
            rows = np.repeat(np.arange(begin, end), [len(f) for f in found])
            return pa.RecordBatch.from_arrays([pa.array(map(_gram, codes.tolist()), pa.string()).take(pa.array(at)), batch.column(0).take(pa.array(rows, pa.int64()))], ["gram", "key"])

        for k, text in enumerate(batch.column(1).to_pylist()):
            found.append(_codes(text))
            n += len(found[-1])
            if n > 1 << 18:
                yield out(k + 1)
                found, begin, n = [], k + 1, 0
        yield out(batch.num_rows)


def index(rows: DataFrame, key: str, text: str | Column) -> DataFrame:
    """(gram, key): what each row's text holds, in lower case. Null keys and texts are not found."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), low.alias("text")).filter("key IS NOT NULL AND text <> ''").mapInArrow(_grams, f"gram string, key {kind}")


def write(found: DataFrame, path: str) -> None:
    """An index as Parquet, dealt and sorted by gram, so that a lookup reads the row groups of its grams alone."""
    found.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").write.mode("overwrite").parquet(path)


def words(query: Column) -> Column:
    """A written query's words in lower case, each once."""
    return F.array_distinct(F.filter(F.split(F.lower(query), SPACE), lambda w: w != ""))


def tokens(query: Column) -> Column:
    """A search text's words of two or more characters that say something, as often as they stand there."""
    found = F.regexp_extract_all(F.lower(query), F.lit(r"([a-z0-9%$.]+)"))
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(*R.SEARCH_STOP))


# Texts are held in arrays of one where words are looked for in them: Spark 4.1 loses sight of a plain column of one side of a join
# that stands in a function of an array of the other side.


def _candidates(grams: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, key, n): rows that hold the rarest gram of n of a query's different words. asked (query_id, words)."""
    each = asked.select("query_id", F.explode(F.array_distinct("words")).alias("word"))
    parts = F.when(F.length("word") <= LONGEST, F.array("word")).otherwise(F.transform(F.sequence(F.lit(1), F.length("word") - (LONGEST - 1)), lambda i: F.substring(F.col("word"), i, F.lit(LONGEST))))
    looked = each.select("query_id", "word", F.explode(F.array_distinct(parts)).alias("gram"))
    # Of the index only what is asked for is kept, once: texts are read once, and a key that stands in several rows counts once.
    grams = checkpointed(grams.join(F.broadcast(looked.select("gram").distinct()), "gram", "left_semi").distinct())
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = looked.join(counts, "gram", "left").groupBy("query_id", "word").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return grams.join(rarest, "gram").groupBy("query_id", "key").agg(F.count("*").alias("n"))


def _first(rows: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """Of each query the first rows; Spark keeps as many in each task before they move."""
    if limit is None:
        return rows
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("_k") <= limit).drop("_k")


def captions(grams: DataFrame, rows: DataFrame, queries: DataFrame, key: str = "file_id", caption: str = "caption", limit: int | None = 60) -> DataFrame:
    """query_id and the columns of rows whose caption holds every word of the query, as search.captions() finds them; the first by key.

    grams: index() of rows; queries (query_id, query), an id once. A query without a word finds nothing.
    """
    asked = queries.select("query_id", words(F.col("query")).alias("words")).filter(F.size("words") > 0)
    found = _candidates(grams, asked).join(asked, "query_id").filter(F.col("n") == F.size("words")).select("query_id", F.col("key").alias("_key"), "words")
    texts = rows.withColumn("_low", F.array(F.lower(caption)))
    held = texts.join(found, F.col(key) == F.col("_key")).filter(F.forall("words", lambda w: F.col("_low")[0].contains(w)))
    return _first(held.select("query_id", *rows.columns), [F.col(key)], limit)


def hay() -> Column:
    """What keywords are looked for in, of a row of tags."""
    return F.lower(F.concat_ws(" ", S.text("text_sample"), S.text("top_label"), S.text("content_bucket")))


def keywords(grams: DataFrame, tags: DataFrame, queries: DataFrame, key: str = "full_path", limit: int | None = 80) -> DataFrame:
    """query_id, the columns of tags and score, as search.keywords() finds and orders them; at least one word is held.

    grams: index(tags, key, hay()); queries (query_id, query), an id once.
    """
    asked = queries.select("query_id", tokens(F.col("query")).alias("words")).filter(F.size("words") > 0)
    found = _candidates(grams, asked).join(asked, "query_id").select("query_id", F.col("key").alias("_key"), "words")
    texts = tags.withColumn("_hay", F.array(hay()))
    held = texts.join(found, F.col(key) == F.col("_key")).withColumn("score", F.size(F.filter("words", lambda w: F.col("_hay")[0].contains(w)))).filter("score > 0")
    return _first(held.select("query_id", *tags.columns, "score"), [F.desc("score"), F.col(key)], limit)
