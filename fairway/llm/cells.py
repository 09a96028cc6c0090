"""Vector tables, and the meeting of query blocks with candidate blocks.

Queries and candidates are each dealt into parts of bounded size; a *cell* is one query part with one
candidate part.  Every cell is a task's work on two bounded matrices, so no group grows with the data,
however many rows share one bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANDIDATES, QUERIES = 8192, 2048


def finite_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id long, vec array<double>, dim) of the rows that take part.

    Rows with a null id, a null vector, or a null or non-finite component take no part.  Of rows that
    repeat an id one stands for all: the least vector in array order.
    """
    vec = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    ok = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ok)
    return rows.groupBy("id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))


def part_of(id_col: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(id_col), parts).cast("int")


def matrix(table: pa.Table, column: str, dim: int) -> np.ndarray:
    flat = table.column(column).combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return np.asarray(flat).reshape(table.num_rows, dim)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(scores) > k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.nonzero(scores >= bound)[0]
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
