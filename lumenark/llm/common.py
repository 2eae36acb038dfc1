"""What the operators share: reading tables, Arrow batch limits and durable cut points."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where checkpoints go on a single machine that names no folder.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"

#: Rows in one Arrow batch; texts of 100 KB then still make batches of some 50 MB.
ROWS_PER_BATCH = 512

#: A word, as a Java and as a Python (bytes) pattern: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Limit Arrow batches and make sure a checkpoint folder is set, keeping the cluster's own; a cluster without one is an error."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or LOCAL_CHECKPOINTS)


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it if df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def only(docs: DataFrame, keys: DataFrame, *named: F.Column) -> DataFrame:
    """Rows of docs whose values of `named` (expressions over docs) are a row of keys, nulls matching nulls; docs' own columns."""
    columns = [fresh(docs, f"key{k}") for k in range(len(named))]
    wanted = keys.distinct().toDF(*(f"{c}_wanted" for c in columns))
    held = docs.withColumns(dict(zip(columns, named)))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"{c}_wanted")) for c in columns))
    return held.join(wanted, same, "left_semi").dropDuplicates(columns).drop(*columns)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder at once and go on from there."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def whole_text(column: str = "text") -> F.Column:
    """Null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def kept_till_exit(df: DataFrame, path: str) -> DataFrame:
    """The rows, written to a Parquet table and read from it; the driver deletes it when it ends."""
    spark = df.sparkSession
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.parquet(path)


def spool(df: DataFrame) -> DataFrame:
    """As cut(), but compressed by column: rows go to a Parquet table in the shared checkpoint folder."""
    import uuid

    prepare(df.sparkSession)
    return kept_till_exit(df, f"{df.sparkSession.sparkContext.getCheckpointDir()}/spool-{uuid.uuid4().hex}")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more; it learns of them
    when the driver collects its garbage, which may be long after a spool() has made them useless."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
