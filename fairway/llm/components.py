"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and an equi-join, so a hub with very many
links is neither gathered in one task nor sent to the driver; each round is written to the shared folder,
which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node reachable.

    Nodes are longs.  Null ends and self-links are ignored; repeated links count once.
    """
    spark = links.sparkSession
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = links.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("child"), F.least(x, y).alias("parent")).distinct()
    mark, path = None, None
    for _ in range(max_rounds):
        written = common.fresh_path(spark, "components")
        edges.write.parquet(written)
        if path:
            common.drop_path(spark, path)
        path = written
        now = spark.read.parquet(path)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        mark = seen
        edges = _small_star(_large_star(now))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct()
    return now.select(F.col("child").alias("node"), F.col("parent").alias("component")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("child").alias("u"), F.col("parent").alias("v")).unionByName(edges.select(F.col("parent").alias("u"), F.col("child").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("child"), F.col("m").alias("parent")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("child").agg(F.min("parent").alias("m"))
    moved = edges.join(least, "child").where("parent <> m").select(F.col("parent").alias("child"), F.col("m").alias("parent"))
    return least.select("child", F.col("m").alias("parent")).unionByName(moved).distinct()
