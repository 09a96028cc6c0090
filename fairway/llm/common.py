"""Small helpers shared by the training-data operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark (any file system that Spark knows)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one set on the context.

    Only in local mode (tests on one machine) a session without either uses the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder for a table that cuts lineage."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Rows in an Arrow batch of whole texts.  Spark's default of 10,000 would hold tens of MB in each worker.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Lowers the rows in an Arrow batch for this session's texts, unless the caller has set them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops columns whose names an operator is about to write (its outputs win a clash)."""
    return df.drop(*[n for n in names if n in df.columns])


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never trained on: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
