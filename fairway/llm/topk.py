"""Exact top-k search by inner product, with norm buckets.

Vectors are grouped by length into geometric levels, each dealt into parts of bounded size.  A first
meeting of every query with a few of the longest vectors (``SEEDS`` more than it needs) gives it a score that
its k-th result must reach.  Against any part that score becomes a *local cosine threshold*, score / (query length *
longest length there).  Above 1 the part is skipped; near 1 the part is searched by coordinates (a vector
can only reach the cosine if its largest coordinates lie in narrow ranges around the query's); otherwise
by length (only vectors long enough can reach it).  What is left is verified by exact products.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import cells, common

LEVELS_PER_DOUBLING = 16
SEEDS = 64
COORDINATES_FROM = 0.9
FOCUS = 3
FOUND = "query_id long, vec_id long, score long"


def _exact_type(queries: np.ndarray, rows: np.ndarray):
    """The fastest number type in which all inner products are exact."""
    a, b = (float(np.abs(m.astype(np.float64)).max()) if m.size else 0.0 for m in (queries, rows))
    reach = max(queries.shape[1], 1) * a * b
    return np.float32 if max(reach, a, b) < 2**24 else np.float64 if max(reach, a, b) < 2**53 else object


def _clip(score) -> int:
    return max(-(2**63), min(2**63 - 1, int(score)))


class _Bucket:
    """One candidate part, longest vectors first."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, kind):
        lengths = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
        order = np.lexsort((ids, -lengths))
        self.ids, self.lengths = ids[order], lengths[order]
        self.rows = rows[order].astype(kind)
        self.longest = float(self.lengths[0]) if len(order) else 0.0
        self.unit = rows[order] / np.maximum(self.lengths, 1e-300)[:, None]
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by_coordinate(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        if c not in self.sorted:
            order = np.argsort(self.unit[:, c], kind="stable")
            self.sorted[c] = order, self.unit[order, c]
        return self.sorted[c]

    def feasible(self, direction: np.ndarray, cosine: float) -> np.ndarray:
        """Places of vectors whose focus coordinates allow the cosine."""
        ranges = []
        for c in np.argsort(-np.abs(direction))[:FOCUS]:
            x = float(direction[c])
            slack = math.sqrt(max(0.0, (1 - x * x) * (1 - cosine * cosine))) + 1e-9
            order, values = self.by_coordinate(int(c))
            # Beyond the query's own coordinate any larger cosine is possible too.
            upper = 1.0 if x >= cosine else x * cosine + slack
            lower = -1.0 if x <= -cosine else x * cosine - slack
            lo = np.searchsorted(values, lower - 1e-9)
            hi = np.searchsorted(values, upper + 1e-9, side="right")
            ranges.append((hi - lo, int(c), lower, upper, order[lo:hi]))
        ranges.sort(key=lambda r: r[0])
        found = ranges[0][4]
        for _, c, lower, upper, _ in ranges[1:]:
            values = self.unit[found, c]
            found = found[(values >= lower - 1e-9) & (values <= upper + 1e-9)]
        return found


def search_cell(query_ids, queries, needed, ids, rows, k: int):
    """Yields (query id, ids, scores) of the candidates that may be among the query's k best."""
    kind = _exact_type(queries, rows)
    bucket = _Bucket(ids, rows, kind)
    lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    exact = queries.astype(kind)
    reach = lengths * bucket.longest
    cosine = np.where(reach > 0, needed / np.where(reach > 0, reach, 1), np.where(needed > 0, np.inf, -np.inf))
    alive = cosine <= 1 + 1e-9
    near = alive & (cosine >= COORDINATES_FROM)
    for i in np.nonzero(near)[0]:
        at = bucket.feasible(queries[i] / lengths[i], min(1.0, float(cosine[i])) - 1e-9)
        yield i, at, bucket.rows[at] @ exact[i], bucket.ids
    rest = np.nonzero(alive & ~near)[0]
    for s in range(0, len(rest), 256):
        some = rest[s : s + 256]
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(lengths[some] > 0, needed[some] / lengths[some], -np.inf).min() - 1e-6
        upto = int(np.searchsorted(-bucket.lengths, -least, side="right"))
        at = np.arange(upto)
        scores = exact[some] @ bucket.rows[:upto].T
        for i, row in zip(some, scores):
            yield i, at, row, bucket.ids


def _cell_search(k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            dim = key[1].as_py()
            query_ids = np.asarray(left.column("id").combine_chunks())
            ids = np.asarray(right.column("id").combine_chunks())
            needed = np.asarray(left.column("needed").combine_chunks().fill_null(-math.inf), np.float64)
            parts = cells.matrix(left, "vec", dim), cells.matrix(right, "vec", dim)
            for i, at, scores, order in search_cell(query_ids, parts[0], needed, ids, parts[1], k):
                names = order[at]
                fine = (names != query_ids[i]) & (scores.astype(np.float64) >= needed[i] - abs(needed[i]) * 1e-12)
                scores, names = scores[fine], names[fine]
                top = cells.best(scores, names, k)
                out[0] += [int(query_ids[i])] * len(top)
                out[1] += names[top].tolist()
                out[2] += [_clip(s) for s in scores[top]]
        return pa.table([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest inner products of every query with all other rows.

    vectors has id long, vec array<long>, dim int, one row per id; is_query is a condition on them.
    Vectors of different dimensions do not meet.  Ties go to the smaller id; scores beyond a long are
    held at its ends.  No queries or no candidates: no rows.
    """
    spark = vectors.sparkSession
    path = common.fresh_path(spark, "topk")
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    level = F.floor(LEVELS_PER_DOUBLING * F.log2(length + 1)).cast("int")
    vectors.withColumn("length", length).withColumn("level", level).withColumn("query", is_query).write.parquet(path)
    rows = spark.read.parquet(path)
    # Of levels there are at most LEVELS_PER_DOUBLING * 1024 in each dimension, however many rows.
    levels = rows.groupBy("dim", "level").agg(F.count("*").alias("n"), F.max("length").alias("longest"))
    levels = F.broadcast(levels.withColumn("parts", F.ceil(F.col("n") / cells.CANDIDATES).cast("int")))
    dims = F.broadcast(rows.where("query").groupBy("dim").agg(F.ceil(F.count("*") / cells.QUERIES).cast("int").alias("query_parts")))
    queries = rows.where("query").select("id", "vec", "dim", "length").join(dims, "dim").withColumn("q", cells.part_of("id", F.col("query_parts")))
    longest = Window.partitionBy("dim").orderBy(F.desc("length"), "id")
    rows.withColumn("place", F.row_number().over(longest)).where(F.col("place") <= k + 1 + SEEDS).select("id", "vec", "dim").write.parquet(f"{path}-longest")
    first = spark.read.parquet(f"{path}-longest")

    def meet(asking: DataFrame, there: DataFrame) -> DataFrame:
        keys = ["q", "dim", "level", "part"]
        left = asking.select(*keys, "id", "vec", "needed").groupBy(*keys)
        right = there.select(*[F.col(c).alias(c) for c in (*keys, "id", "vec")]).groupBy(*keys)
        return left.cogroup(right).applyInArrow(_cell_search(k), FOUND)

    one = lambda df: df.withColumn("level", F.lit(0)).withColumn("part", F.lit(0))
    seeds = meet(one(queries).withColumn("needed", F.lit(None).cast("double")), one(first.join(dims, "dim")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1))))
    seeds.write.parquet(f"{path}-seeds")
    seeds = spark.read.parquet(f"{path}-seeds")
    needed = seeds.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("needed"))
    alive(queries.join(needed, "id", "left"), levels).write.parquet(f"{path}-alive")
    asking = spark.read.parquet(f"{path}-alive")
    met = asking.select("q", "dim", "level", "part").distinct()
    there = rows.select("id", "vec", "dim", "level").join(levels, ["dim", "level"]).withColumn("part", cells.part_of("id", F.col("parts"))).join(first.select("id"), "id", "left_anti")
    found = seeds.unionByName(meet(asking, there.join(met, ["dim", "level", "part"])))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def alive(queries: DataFrame, levels: DataFrame) -> DataFrame:
    """Each query with the parts of the levels in which a vector can reach the score it needs."""
    pair = queries.join(levels, "dim").where(F.col("needed").isNull() | (F.col("needed") <= F.col("length") * F.col("longest") * (1 + 1e-9) + 1e-6))
    return pair.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("q", "dim", "level", "part", "id", "vec", "needed")


def quantized(df: DataFrame) -> DataFrame:
    """finite_vectors with each component x as floor(64 * x)."""
    return cells.finite_vectors(df).withColumn("vec", F.transform("vec", lambda x: F.floor(x * F.lit(64.0)).cast("long")))


def op2_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(quantized(common.table(spark, sf_dir, "embeddings")), F.pmod("id", F.lit(20)) == 0, 20)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
