"""Approximate nearest neighbours with learned partitions.

On a bounded sample of distinct vectors a graph of nearest neighbours is built and cut into balanced
partitions by recursive bisection: each cut halves the vertices along the slowest-varying direction of
the graph and is then improved by exchanging vertices.  A small softmax classifier learns which partition
a vector belongs to.  Every vector is indexed in its most probable partition; a query goes to its most
probable partitions, until they hold a certain mass of its probability and enough vectors for a whole answer, and
all vectors there are reranked by their exact distance.  The mass is measured: with it the routes of the sample's
vectors, of those learned from and of those kept apart, hold ``TARGET`` of their nearest neighbours in the sample.

``SAMPLE`` bounds the sample of each dimension and so what a fitting task holds; the number of partitions grows
with the cube root of the table.  Every row is indexed.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import cells, common

SAMPLE = 4000
PARTITIONS = 8, 512
NEIGHBOURS = 12
TARGET, APART = 0.97, 0.2
FOUND = "query_id long, vec_id long, score double"


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest other rows of each row."""
    near = np.empty((len(x), min(k, max(len(x) - 1, 0))), np.int64)
    square = (x**2).sum(axis=1)
    for s in range(0, len(x), 512):
        d = square[s : s + 512, None] - 2 * x[s : s + 512] @ x.T + square[None]
        d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
        near[s : s + 512] = np.argpartition(d, near.shape[1] - 1, axis=1)[:, : near.shape[1]] if near.shape[1] else near[s : s + 512]
    return near


def bisect(vertices: np.ndarray, near: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of the vertices with few edges between."""
    place = np.full(max(int(near.max(initial=0)), int(vertices.max())) + 1, -1)
    place[vertices] = np.arange(len(vertices))
    inner = place[near[vertices]]
    a, b = np.repeat(np.arange(len(vertices)), near.shape[1]), inner.ravel()
    a, b = a[b >= 0], b[b >= 0]
    a, b = np.concatenate((a, b)), np.concatenate((b, a))
    degree = np.bincount(a, minlength=len(vertices)) + 1.0
    v = rng.standard_normal(len(vertices))
    for _ in range(60):  # towards the slowest direction that is not constant
        v -= (v * degree).sum() / degree.sum()
        v = 0.5 * v + 0.5 * (np.bincount(a, v[b], len(vertices)) + v) / degree
        v /= max(np.abs(v).max(), 1e-12)
    side = np.zeros(len(vertices), bool)
    side[np.argsort(v, kind="stable")[len(vertices) // 2 :]] = True
    for _ in range(20):  # exchange as many on both sides as gain most
        across = np.bincount(a, side[a] != side[b], len(vertices))
        gain = 2 * across - (degree - 1)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        n = min(len(left), len(right))
        better = int((gain[left[:n]] + gain[right[:n]] > 0).sum()) // 2
        if not better:
            break
        side[left[:better]], side[right[:better]] = True, False
    return vertices[~side], vertices[side]


def partition(x: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """The partition of each row; partitions differ by one row in size at most at each cut."""
    rng = np.random.default_rng(seed)
    near = neighbour_graph(x, NEIGHBOURS)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        groups = [h for g in groups for h in (bisect(g, near, rng) if len(g) > 1 else (g, g[:0]))]
    label = np.zeros(len(x), np.int64)
    for i, g in enumerate(groups):
        label[g] = i
    return label


def learn(x: np.ndarray, label: np.ndarray, parts: int, steps: int = 300) -> np.ndarray:
    """Weights (dim + 1, parts) of a softmax classifier, by gradient steps with momentum."""
    z = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    w, speed = np.zeros((z.shape[1], parts)), np.zeros((z.shape[1], parts))
    target = np.eye(parts)[label]
    rate = 4.0 / max(float((z**2).sum(axis=1).mean()), 1e-12)
    for _ in range(steps):
        s = z @ w
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed - rate * (z.T @ (p - target) / len(z) + 1e-4 * w)
        w += speed
    return w


def partitions(rows: int) -> int:
    """How many partitions an index of so many rows has: a power of two near its cube root."""
    return int(min(max(2 ** round(np.log2(max(rows, 1)) / 3), PARTITIONS[0]), PARTITIONS[1]))


def probabilities(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    s = np.concatenate((x, np.ones((len(x), 1))), axis=1) @ w
    p = np.exp(s - s.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def measured_mass(p: np.ndarray, near: np.ndarray, rows: np.ndarray) -> float:
    """The mass that routes of these rows need to hold TARGET of their neighbours, each in its most probable partition."""
    if not len(rows) or not near.shape[1]:
        return 1.0
    home = p.argmax(axis=1)
    order = np.argsort(-p[rows], axis=1, kind="stable")
    before = np.zeros_like(p[rows])  # what a route holds before it reaches each partition
    np.put_along_axis(before, order, np.cumsum(np.take_along_axis(p[rows], order, axis=1), axis=1) - np.take_along_axis(p[rows], order, axis=1), axis=1)
    needed = np.take_along_axis(before, home[near[rows]], axis=1)
    return float(np.quantile(needed, TARGET)) + 1e-9


def fit(vectors: DataFrame, sample: int = SAMPLE, seed: int = 17) -> dict[int, bytes]:
    """A model for each dimension, from at most ``sample`` distinct vectors of it, chosen by a seeded hash."""
    order = Window.partitionBy("dim").orderBy(F.xxhash64("vec", F.lit(seed)), "vec")
    sizes = vectors.groupBy("dim").agg(F.count("*").alias("rows"))
    chosen = vectors.select("dim", "vec").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample).join(sizes, "dim")

    def run(table: pa.Table) -> pa.Table:
        n = partitions(table.column("rows")[0].as_py())
        x = np.array(sorted(table.column("vec").to_pylist()), np.float64)
        scale = float(np.sqrt((x**2).sum(axis=1).mean()))
        center = x.mean(axis=0)
        x = (x - center) / max(scale, 1e-300)
        apart = np.random.default_rng(seed).random(len(x)) < APART
        w = learn(x[~apart], partition(x, n)[~apart], n) if (~apart).any() else np.zeros((x.shape[1] + 1, n))
        p, near = probabilities(x, w), neighbour_graph(x, NEIGHBOURS)
        mass = max(measured_mass(p, near, np.flatnonzero(a)) for a in (apart, ~apart) if a.any())
        out = io.BytesIO()
        np.savez(out, w=w, center=center, scale=scale, mass=mass)
        return pa.table({"dim": table.column("dim")[:1], "model": pa.array([out.getvalue()], pa.binary())})

    # One row for each dimension there is.
    return {r["dim"]: bytes(r["model"]) for r in chosen.groupBy("dim").applyInArrow(run, "dim int, model binary").collect()}


def probable(models: dict[int, bytes], sizes: dict[int, dict[int, int]] | None = None, least: int = 0):
    """The most probable partition of a vector alone; or, with the sizes of partitions, those of its route: until
    they hold the model's mass of its probability and ``least`` vectors."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        loaded: dict[int, tuple] = {}
        for vectors in batches:
            out: list[list[int]] = [[]] * len(vectors)
            dims = np.asarray(pc.list_value_length(vectors))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim not in loaded:
                    got = np.load(io.BytesIO(models[dim]))
                    w = got["w"]
                    loaded[dim] = w, float(got["mass"]) if sizes else 0.0, got["center"], max(float(got["scale"]), 1e-300), np.array([(sizes or {}).get(dim, {}).get(i, 0) for i in range(w.shape[1])])
                w, mass, center, scale, held = loaded[dim]
                x = np.asarray(vectors.take(pa.array(at)).flatten()).reshape(len(at), dim)
                p = probabilities((x - center) / scale, w)
                order = np.argsort(-p, axis=1, kind="stable")
                wide = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) < mass
                wide |= np.cumsum(held[order], axis=1) < least
                counts = wide.sum(axis=1).clip(0, p.shape[1] - 1) + 1
                for i, o, c in zip(at.tolist(), order, counts):
                    out[i] = o[:c].tolist()
            yield pa.array(out, pa.list_(pa.int32()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<int>")


def _rerank(k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            query_ids = np.asarray(left.column("id").combine_chunks())
            ids = np.asarray(right.column("id").combine_chunks())
            dim = len(left.column("vec")[0])
            q, c = cells.matrix(left, "vec", dim), cells.matrix(right, "vec", dim)
            square = (c**2).sum(axis=1)
            for s in range(0, len(q), 256):
                rough = (q[s : s + 256] ** 2).sum(axis=1)[:, None] - 2 * q[s : s + 256] @ c.T + square[None]
                slack = 1e-9 * ((q[s : s + 256] ** 2).sum(axis=1) + square.max())
                for i, row in enumerate(rough):
                    at = np.arange(len(c))
                    if len(c) > k + 1:  # the query itself may be among them
                        at = np.flatnonzero(row <= np.partition(row, k)[k] + slack[i])
                    at = at[ids[at] != query_ids[s + i]]
                    exact = np.sqrt(((c[at] - q[s + i]) ** 2).sum(axis=1))
                    top = at[cells.best(-exact, ids[at], k)]
                    out[0] += [int(query_ids[s + i])] * len(top)
                    out[1] += ids[top].tolist()
                    out[2] += np.sqrt(((c[top] - q[s + i]) ** 2).sum(axis=1)).tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query, k: int) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest rows found for every query.

    vectors has id long, vec array<double>, dim, one row per id.  Zero vectors take no part.  Vectors of
    different dimensions do not meet: each dimension has its own index.  Ties go to the smaller id.  A query
    has k rows, or as many as there are other vectors of its dimension.  No queries or no vectors: no rows.
    """
    spark = vectors.sparkSession
    path = common.fresh_path(spark, "ann")
    rows = vectors.where(F.exists("vec", lambda x: x != 0)).select("id", "vec", F.col("dim").cast("int").alias("dim"), is_query.alias("query"))
    rows.write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    models = fit(rows)
    rows.select("id", "vec", "dim", "query", probable(models)("vec")[0].alias("home")).write.parquet(f"{path}/index")
    index = spark.read.parquet(f"{path}/index")
    # One row for each of the few partitions of a dimension.
    homes = index.groupBy("dim", "home").agg(F.count("*").alias("n"), F.ceil(F.count("*") / cells.CANDIDATES).cast("int").alias("parts"))
    sizes: dict[int, dict[int, int]] = {}
    for r in homes.collect():
        sizes.setdefault(r["dim"], {})[r["home"]] = r["n"]
    route = probable(models, sizes, k + 1)
    asking = index.where("query").select("id", "vec", "dim", F.explode(route("vec")).alias("home")).join(F.broadcast(homes.select("dim", "home", "parts")), ["dim", "home"])
    asked = asking.groupBy("dim", "home").agg(F.ceil(F.count("*") / cells.QUERIES).cast("int").alias("query_parts"))
    asked.write.parquet(f"{path}/asked")
    asked = F.broadcast(spark.read.parquet(f"{path}/asked"))
    keys = ["dim", "home", "part", "q"]
    asking = asking.join(asked, ["dim", "home"]).withColumn("q", cells.part_of("id", F.col("query_parts"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    there = index.select("id", "vec", "dim", "home").join(F.broadcast(homes.select("dim", "home", "parts")), ["dim", "home"]).join(asked, ["dim", "home"])
    there = there.withColumn("part", cells.part_of("id", F.col("parts"))).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)))
    left = asking.select(*keys, "id", "vec").groupBy(*keys)
    right = there.select(*[F.col(c).alias(c) for c in (*keys, "id", "vec")]).groupBy(*keys)
    found = left.cogroup(right).applyInArrow(_rerank(k), FOUND)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann(spark, sf_dir: str) -> DataFrame:
    return search(cells.finite_vectors(common.table(spark, sf_dir, "embeddings")), F.pmod("id", F.lit(100)) == 0, 10)
