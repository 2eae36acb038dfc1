"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. A stage works on all rows its predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lumenark.llm import exact_dedup, mixing, packing, quality, simhash
from lumenark.llm.common import kept_till_exit, prepare, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the good labels keeps (see quality.keep_good).

    Null and empty texts have no features: they stay or go by the draw, as a text that says nothing either way. Rows that
    share a doc_id stay together; null doc_ids share one draw. Without good labels, or rows, all rows stay.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, the one with the largest doc_id (see exact_dedup.keep_one).

    A null text equals an empty one; of rows that repeat both doc_id and text one stays; a null doc_id only stays
    if all of its group are null. Texts of any length are compared whole.
    """
    return exact_dedup.keep_one(docs)


def distant_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a five-word similarity of 0.8 or more, the one with the smallest doc_id (see simhash.keep_one).

    Texts without a word are alike; a null text counts as empty. A null doc_id only stays if all of its group are null.
    """
    return simhash.keep_one(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the target mix, each as often as its epochs say (see mixing.take).

    Null languages and sources count as empty ones; texts without a word cost nothing and enter with each whole epoch.
    """
    return mixing.take(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2,048 tokens (see packing.pack_documents).

    A null or empty text is one piece of one token; longer texts are cut; a document that the mix took twice is packed twice.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_documents),
    ("SimHash near-dedup", distant_documents),
    ("mixing sources to target weights", mixed_documents),
    ("best-fit packing", packed_sequences),
]

#: SQL expresses neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir; what each stage returns is a Parquet table in the shared checkpoint folder,
    which the driver deletes when it ends."""
    prepare(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = kept_till_exit(stage(spark, docs, sf_dir), f"{folder}/{k}")
    return docs
