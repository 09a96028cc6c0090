"""Tables written by run or by batch so that a repeated or broken write does no harm.

A write first withdraws its run's mark, then clears what the run left before, appends, and marks the run last.
Readers see marked runs alone, so half a run is never read and a run written twice is there once.  One writer at a
time may write one run; different runs may be written at once.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The result tables of a run (fixed values).
RESULTS = ("drifting_allision", "drifting_grounding", "powered_allision", "powered_grounding", "collision_lines", "collision_points")
_MARKS = "table string, rows long"


def _drop(spark: SparkSession, path: str) -> None:
    """Removes a folder, if it is there, on whatever file system holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _name(value: int | str) -> str:
    """A run's id or a batch's name as part of a path."""
    if not re.fullmatch(r"[A-Za-z0-9._-]+", str(value)):
        raise ValueError(f"not a name for a folder: {value!r}")
    return str(value)


def publish(tables: dict[str, DataFrame], path: str, key: str, value: int | str, by: tuple[str, ...] = ()) -> dict[str, int]:
    """Writes tables under path/<table>/<key>=<value>/ (and folders of ``by``), then the mark; the rows of each table that has any.

    Tables without rows leave no folder; a table keeps the schema of its last write.  Written again, a run is what the last whole write gave it.
    """
    if not tables:
        return {}
    own, found = f"{key}={_name(value)}", {}
    spark = next(iter(tables.values())).sparkSession
    _drop(spark, f"{path}/_marks/{own}")
    for name in _published(spark, path) | set(tables):
        _drop(spark, f"{path}/{name}/{own}")
    for name, rows in tables.items():
        if key in rows.columns:
            raise ValueError(f"{name} has a column {key} of its own")
        rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/_schemas/{name}")
        rows.write.mode("append").partitionBy(*by).parquet(f"{path}/{name}/{own}") if by else rows.write.mode("append").parquet(f"{path}/{name}/{own}")
        n = spark.read.schema(rows.schema).parquet(f"{path}/{name}/{own}").count()
        if n:
            found[name] = n
        else:
            _drop(spark, f"{path}/{name}/{own}")
    spark.createDataFrame(list(found.items()), _MARKS).coalesce(1).write.mode("overwrite").parquet(f"{path}/_marks/{own}")
    return found


def _published(spark: SparkSession, path: str) -> set[str]:
    """Names of all tables ever written, from the folder of their schemas: a handful, whatever the number of runs."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_schemas/*")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return {f.getPath().getName() for f in found or []}


def marks(spark: SparkSession, path: str, key: str, kind: str) -> DataFrame:
    """(table, rows, key) of all marked runs: a row for each table that has rows."""
    return spark.read.schema(f"{_MARKS}, {key} {kind}").parquet(f"{path}/_marks")


def read(spark: SparkSession, path: str, table: str, key: str, kind: str) -> DataFrame:
    """The rows of a table of all marked runs, with their key; folders of other runs are pruned by the marks."""
    done = marks(spark, path, key, kind).where(F.col("table") == table).select(key)
    schema = spark.read.parquet(f"{path}/_schemas/{table}").schema.add(key, kind)
    return spark.read.schema(schema).parquet(f"{path}/{table}").join(done, key, "left_semi")


def withdraw(spark: SparkSession, path: str, key: str, value: int | str) -> None:
    """Deletes a run: its mark first, then its rows in every table."""
    own, names = f"{key}={_name(value)}", _published(spark, path)
    _drop(spark, f"{path}/_marks/{own}")
    for name in names:
        _drop(spark, f"{path}/{name}/{own}")


def write_run(results: dict[str, DataFrame], path: str, run_id: int) -> dict[str, int]:
    """Writes a run's result tables; other names than the six are an error."""
    other = set(results) - set(RESULTS)
    if other:
        raise ValueError(f"no result tables: {sorted(other)}")
    return publish(results, path, "run_id", int(run_id))


def read_run(spark: SparkSession, path: str, table: str) -> DataFrame:
    return read(spark, path, table, "run_id", "long")


def write_segments(segments: DataFrame, path: str, batch: str, t: str = "t1") -> dict[str, int]:
    """Writes a batch of segments under year= and month= (UTC) of their start."""
    when = F.timestamp_micros((F.col(t) * 1_000_000).cast("long"))
    return publish({"segments": segments.withColumn("year", F.year(when)).withColumn("month", F.month(when))}, path, "batch", batch, ("year", "month"))


def read_segments(spark: SparkSession, path: str, year: int | None = None, months: list[int] | None = None) -> DataFrame:
    """Segments of marked batches, of a year and months, read from those folders alone."""
    rows = read(spark, path, "segments", "batch", "string")
    if year is not None:
        rows = rows.where(F.col("year") == year)
    return rows.where(F.col("month").isin(months)) if months else rows
