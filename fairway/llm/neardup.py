"""Near-duplicates by the Jaccard similarity of five-word shingles.

Candidates share one of ``BANDS`` keys of ``ROWS`` min-hashes each, which a pair of similarity 0.8 misses in 4 of
10,000 cases, or lie within the distance of the SimHash operator.  All links are verified on whole sets of shingles.
First every member of a key's group is compared with the group's smallest; then the members of a key that are not all
connected yet meet in cells of bounded parts, with their sets.  A cell counts shared shingles over an inverted index and
gives only a spanning forest of its links, so no table of pairs grows with the square of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash
from .components import components
from .substring import SHINGLE, shingles

BANDS, ROWS = 20, 5
#: Documents and shingles in a part of a key's group, about.
PART, PART_SHINGLES = 2048, 1 << 20
SIMILARITY = 0.8
_RANDOM = np.random.default_rng(42)
_XOR = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None] * np.uint64(2)
_TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; a shorter text is one shingle, a wordless one has none."""
    import xxhash

    words = text.lower().split()
    if 0 < len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    return np.unique(shingles(text))


def band_keys(own: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), 2048):
        least = np.minimum(least, ((own[None, k : k + 2048] ^ _XOR) * _TIMES).min(axis=1))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * np.uint64(0x9FB21C651E98DF25)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, g, n, fp, keys) of texts: h and g stand for the set of shingles, fp is the SimHash."""
    import xxhash

    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            own = shingle_set(data)
            whole = own.tobytes()
            fp = int.from_bytes(simhash.fingerprint_of(data, SHINGLE, 42), "big", signed=True)
            rows.append((doc, *(np.array([xxhash.xxh64_intdigest(whole, k) for k in (0, 1)], np.uint64).view(np.int64).tolist()), len(own), fp, band_keys(own).tolist()))
        cols = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 5 + [pa.list_(pa.int64())])], ["doc_id", "h", "g", "n", "fp", "keys"])


def _dealt_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, node, label, own) of rows (node, label, cells, text): the set of shingles for each cell of a document."""
    for batch in batches:
        for node, label, cells, text in zip(batch.column("node").to_pylist(), batch.column("label").to_pylist(), batch.column("cells").to_pylist(), batch.column("text")):
            own = shingle_set(text.as_buffer().to_pybytes() if text.is_valid else b"").tobytes()
            for k in range(0, len(cells), 64):
                some = cells[k : k + 64]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([node] * len(some)), pa.array([label] * len(some)), pa.array([own] * len(some), pa.binary())], ["cell", "node", "label", "own"])


def forest(label: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Places of links that connect all sets of SIMILARITY or more, beside those that share a label already."""
    m, n = len(sets), np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), n)
    order = np.argsort(flat, kind="stable")  # of each shingle its owners in order
    starts = np.concatenate(([0], np.flatnonzero(np.diff(flat[order])) + 1, [len(flat)]))
    times = np.diff(starts)
    place = np.empty(len(flat), np.int64)  # where each shingle of a document stands in that order
    place[order] = np.arange(len(flat))
    end = np.empty(len(flat), np.int64)
    end[order] = np.repeat(starts[1:], times)
    own, first = owner[order], np.concatenate(([0], np.cumsum(n)))
    group, out = np.unique(label, return_inverse=True)[1], []
    for i in range(m):
        at, to = place[first[i] : first[i + 1]] + 1, end[first[i] : first[i + 1]]  # later documents alone
        size = to - at
        if not size.any():
            continue
        both = np.bincount(own[np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())], minlength=m)
        for j in np.flatnonzero((both > 0) & (both >= SIMILARITY * (n[i] + n - both))).tolist():
            if group[i] != group[j]:
                group[group == group[j]] = group[i]
                out.append((i, j))
    return out


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (cell, node, label, own) sorted by cell: links (a, b) that connect what is similar in each cell."""
    cell, rows = None, []

    def links() -> Iterator[pa.RecordBatch]:
        if len(rows) > 1 and len({label for _, label, _ in rows}) > 1:
            found = forest(np.array([r[1] for r in rows]), [np.frombuffer(r[2], np.uint64) for r in rows])
            if found:
                ends = [sorted((rows[i][0], rows[j][0])) for i, j in found]
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        for own_cell, *row in zip(*(batch.column(c).to_pylist() for c in ("cell", "node", "label", "own"))):
            if own_cell != cell:
                yield from links()
                cell, rows = own_cell, []
            rows.append(row)
    yield from links()


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for a, b in zip(batch.column("text_a"), batch.column("text_b")):
            x, y = (shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in (a, b))
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(both >= SIMILARITY * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _verified(pairs: DataFrame, rows: DataFrame, path: str) -> DataFrame:
    """The pairs that are similar enough, by their texts; only the texts of documents in pairs are moved."""
    spark = pairs.sparkSession
    pairs.distinct().write.parquet(f"{path}-pairs")
    pairs = spark.read.parquet(f"{path}-pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    rows.join(asked, "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text").write.parquet(f"{path}-texts")
    texts = spark.read.parquet(f"{path}-texts")
    text = lambda k: texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}"))
    pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(_similar, "a long, b long").write.parquet(path)
    return spark.read.parquet(path)


def repeated_ids(rows: DataFrame, path: str) -> DataFrame:
    """The doc_id of more than one row, written to path."""
    rows.groupBy("doc_id").count().where("count > 1").select("doc_id").write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of the rows that have an id: the smallest id reachable over pairs of SIMILARITY or more.

    Texts with equal sets of shingles are one node; null and wordless texts are one such set.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    path = common.fresh_path(spark, "neardup")
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    twice = repeated_ids(rows, f"{path}/twice")
    if not twice.isEmpty():  # of rows that repeat an id the text least in order counts; null is least
        one = rows.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text")).alias("t")).select("doc_id", "t.text")
        one.write.parquet(f"{path}/one")
        rows = rows.join(twice, "doc_id", "left_anti").unionByName(spark.read.parquet(f"{path}/one"))
    rows.mapInArrow(_signed, "doc_id long, h long, g long, n long, fp long, keys array<long>").write.parquet(f"{path}/docs")
    signed = spark.read.parquet(f"{path}/docs")
    signed.groupBy("h", "g").agg(F.min("doc_id").alias("node")).write.parquet(f"{path}/sets")
    sets = spark.read.parquet(f"{path}/sets")
    member = signed.select("doc_id", "h", "g").join(sets, ["h", "g"]).select("doc_id", "node").distinct()
    heads = signed.join(sets, ["h", "g"]).where("doc_id = node and n > 0").groupBy("node").agg(F.min(F.struct("n", "fp", "keys")).alias("x")).select("node", "x.*")
    heads.select("node", "n", F.explode("keys").alias("key")).write.parquet(f"{path}/keyed")
    keyed = spark.read.parquet(f"{path}/keyed")
    heads.groupBy("fp").agg(F.min("node").alias("node")).write.parquet(f"{path}/prints")
    least = keyed.groupBy("key").agg(F.min("node").alias("a")).join(keyed, "key").where("a < node").select("a", F.col("node").alias("b"))
    alike = simhash.links(spark.read.parquet(f"{path}/prints")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = _verified(least.unionByName(alike), rows, f"{path}/first")
    labels = components(first).select("node", F.col("component").alias("label"))

    open_ = keyed.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    parts = F.ceil(F.greatest(F.col("k") / PART, F.col("shingles") / PART_SHINGLES)).cast("int")
    groups = open_.groupBy("key").agg(F.count("*").alias("k"), F.sum("n").alias("shingles"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key", parts.alias("parts"))
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.xxhash64("key", F.least(mine, other), F.greatest(mine, other)))
    dealt = open_.join(groups, "key").select("node", "label", cells.alias("cells")).groupBy("node", "label").agg(F.flatten(F.collect_list("cells")).alias("cells"))
    dealt.write.parquet(f"{path}/dealt")
    dealt = spark.read.parquet(f"{path}/dealt")
    sets = dealt.join(rows.withColumnRenamed("doc_id", "node"), "node").select("node", "label", "cells", "text").mapInArrow(_dealt_sets, "cell long, node long, label long, own binary")
    sets.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cell_links, "a long, b long").write.parquet(f"{path}/second")
    second = spark.read.parquet(f"{path}/second")
    found = components(first.unionByName(second))
    return member.join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near-duplicates: of each component the row whose doc_id is smallest.

    Rows with a null doc_id stay.  Of rows that repeat a doc_id the one stays whose text, then whose other columns, are
    least in order, a null text first: the text that was compared.
    """
    path = common.fresh_path(docs.sparkSession, "gone")
    near_duplicates(docs).where("component_id <> doc_id").select("doc_id").distinct().write.parquet(path)
    gone = docs.sparkSession.read.parquet(path)
    kept = docs.join(gone, "doc_id", "left_anti")
    twice = repeated_ids(docs.where("doc_id is not null").select("doc_id"), f"{path}-twice")
    if twice.isEmpty():
        return kept.select(docs.columns)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = kept.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *[F.col(f"`{c}`") for c in rest])).alias("row"))
    once = once.select("doc_id", *[F.col("row").getField(c).alias(c) for c in ("text", *rest)])
    return kept.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(once.select(docs.columns))
