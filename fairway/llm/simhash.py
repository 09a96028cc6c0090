"""SimHash near-duplicate detection with pigeonhole blocks.

Fingerprints of 64 bits are cut into ``BLOCKS`` blocks.  Two fingerprints that differ in at most d bits
differ in at most d blocks, so they agree in at least BLOCKS - d of them: every choice of that many
blocks is a join key, and equal keys are verified by their Hamming distance.  Equal fingerprints are one
node before the join, so exact copies cost nothing there.  A key that very many fingerprints share is
dealt over cells of two salted parts each; every pair still meets in one cell.  Only a spanning forest of
each run of equal keys is kept, which loses no connection.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

BLOCKS = 6
PART = 4096


def fingerprint_of(text: bytes, words_in_shingle: int, seed: int) -> bytes:
    """Eight bytes, most significant first."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, and white space is 0x20 and 0x09 to 0x0D
    if not words:
        return bytes(8)
    digest, joined = xxhash.xxh64_digest, b" ".join(words)
    if len(words) <= words_in_shingle:
        return digest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[: -words_in_shingle])).tolist()
    ends = (ends[words_in_shingle - 1 :] - 1).tolist()
    hashes = np.frombuffer(b"".join([digest(joined[s:e], seed) for s, e in zip(starts, ends)]), np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[k : k + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def fingerprint(text: Column, words_in_shingle: int = 4, seed: int = 42) -> Column:
    """The SimHash of a text as a long; null and wordless texts give 0."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            prints = [fingerprint_of(v.as_buffer().to_pybytes(), words_in_shingle, seed) if v.is_valid else bytes(8) for v in texts]
            yield pa.array(np.frombuffer(b"".join(prints), ">i8").astype(np.int64))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "long")(text.cast("binary"))


def block_masks(distance: int, blocks: int) -> list[int]:
    """One mask for each choice of the blocks that must agree, as signed longs."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(cuts)]
    masks = [sum(chosen) for chosen in itertools.combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(key: np.ndarray, fp: np.ndarray, node: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by key: links that connect all pairs of equal key within the distance."""
    n = len(key)
    label, left, right = np.arange(n), [], []
    at, step = np.arange(n - 1), 0
    while True:
        step += 1
        at = at[at + step < n]
        at = at[key[at] == key[at + step]]  # sorted: once keys differ, they stay different
        if not len(at):
            break
        near = at[(np.bitwise_count((fp[at] ^ fp[at + step]).view(np.uint64)) <= distance) & (label[at] != label[at + step])]
        if not len(near):
            continue
        root = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        for i in near.tolist():
            a, b = find(int(label[i])), find(int(label[i + step]))
            if a != b:
                root[max(a, b)] = min(a, b)
                left.append(i)
                right.append(i + step)
        moved = np.arange(n)
        for x in root:
            moved[x] = find(x)
        label = moved[label]
    return node[left], node[right]


def links(nodes: DataFrame, distance: int = 4, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) between nodes (node long, fp long, one row per fp) that join everything within the distance."""
    masks = block_masks(distance, blocks)
    keyed = nodes.select("node", "fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])).alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > PART).select("key", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    cells = F.when(F.col("parts").isNull(), F.array(F.col("key"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.xxhash64("key", F.least(own, other), F.greatest(own, other)))
    )
    dealt = keyed.join(crowded, "key", "left").select("node", "fp", F.explode(cells).alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held = [np.concatenate((h, np.asarray(batch.column(c)))) for h, c in zip(held, ("cell", "fp", "node"))]
                cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            else:
                cut = len(held[0])
            if cut:
                a, b = _forest(held[0][:cut], held[1][:cut], held[2][:cut], distance)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                held = [h[cut:] for h in held]

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 4, words_in_shingle: int = 4, seed: int = 42, blocks: int = BLOCKS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and wordless texts have fingerprint zero and are linked like any other.  A row with a null doc_id
    has its fingerprint but links nothing and has a null component_id.  Repeated rows stay.  Other columns
    of docs are not read, whatever their names.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    path = common.fresh_path(spark, "simhash")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint(F.col("text"), words_in_shingle, seed).alias("fp")).write.parquet(f"{path}/docs")
    printed = spark.read.parquet(f"{path}/docs")
    printed.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")).write.parquet(f"{path}/nodes")
    nodes = spark.read.parquet(f"{path}/nodes")
    found = components(links(nodes, distance, blocks))
    classes = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("class"))
    classes.write.parquet(f"{path}/classes")
    classes = spark.read.parquet(f"{path}/classes")
    return printed.join(classes, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("component_id"),
    )


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """The documents without near-duplicates: of each component the row whose doc_id is smallest.

    Rows with a null doc_id stay.  Repeated rows of one doc_id count as copies: one stays.
    """
    found = near_duplicates(docs, **params)
    gone = found.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once).select(docs.columns)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
