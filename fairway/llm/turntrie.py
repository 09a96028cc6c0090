"""Prefix tries of conversations, packed as double arrays.

A conversation is a sequence of turns; every distinct start of one is a node of a trie.  The operator gives each node its
members and what its subtree holds: childless nodes, and the bytes that need not be worked on again when starts are
shared.

Method.  Texts are hashed to 128 bits and a length before anything moves.  Equal conversations become one sequence with
a count, its smallest id and the digest of its ids.  Sequences are dealt by a start of 1, 2, 4, 8, ... turns: the
shortest that at most ``SHARD`` sequences share is a sequence's *shard*.  A task takes whole shards, gives their turns
dense ids, packs the trie into BASE and CHECK arrays (child = BASE[node] + id, valid if CHECK[child] = node), walks all
sequences through them to count, and sweeps the nodes from the deepest up.  Nodes below a shard's start are whole there.
The nodes above are shared by tasks: their counts are merged by a grouped sum, and subtree sums climb over them in
rounds that double the distance, so their number of rounds is the logarithm of the deepest shared start.

Scale: a start that very many conversations share is never one group, as only longer starts of it are dealt out and its
own counts are combined before the shuffle; copies are one sequence.  The ids of the conversations that end in a node
are hashed in order: they are sorted by range, every task joins those of a node into one text, and these are hashed one
after another.  One conversation's turns (32 bytes each) are one row, which bounds a single conversation, not their
number.

Odd rows: null roles and texts are empty; rows without a conv_id take no part; a null turn comes first, and turns of
equal number follow by the hashes of their role and text.  An empty table has no node, not even the root.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Sequences that a task packs at a time, and the most that share a shard's start.
SHARD = 20_000

#: Conversations of a family share the first turns of its first one: see rebuilt().
FAMILY, HEADS = 5, 9

EMPTY = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as structs of two hashes and the text's bytes."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), F.octet_length(text).cast("long").alias("n")).alias("t")
    )
    ordered = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t.a, t.b, t.n)).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): conversation c starts with the first h turns of c - c % 5, then has its own after the first h."""
    own = turns_of(conversations)
    path = common.fresh_path(own.sparkSession, "turns")
    own.write.parquet(path)
    own = own.sparkSession.read.parquet(path)
    h = F.expr(f"CAST(crc32(CAST(CAST(conv_id AS STRING) AS BINARY)) % {HEADS} AS INT)")
    heads = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, HEADS - 1).alias("head"))
    own = own.withColumn("h", h).withColumn("head_id", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "head_id", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return own.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def _start(length: Column | int) -> Column:
    """Name of the start of a sequence: its length and two hashes."""
    n = F.least(F.size("a"), F.lit(length) if isinstance(length, int) else length)
    return F.struct(n.alias("n"), F.xxhash64(F.slice("a", F.lit(1), n)).alias("x"), F.xxhash64(F.lit(1), F.slice("b", F.lit(1), n)).alias("y"))


def ends_of(rows: DataFrame) -> DataFrame:
    """(whole, ends_sha256): SHA-256 of the ids of equal conversations, ascending and joined by commas."""

    def runs(batches):
        """One text for a sequence's ids that lie in a batch of this task."""
        for batch in batches:
            at = _bounds(batch)
            ids = batch.column("conv_id").to_pylist()
            texts = [",".join(map(str, ids[i:j])).encode() for i, j in zip(at, [*at[1:], len(ids)])]
            yield pa.RecordBatch.from_arrays([batch.column("whole").take(at), batch.column("conv_id").take(at), pa.array(texts, pa.binary())], ["whole", "first_id", "ids"])

    def joined(batches):
        """Runs arrive sorted by sequence and first id; only one hash is open at a time."""
        held, digest = None, None
        for batch in batches:
            whole, ids = batch.column("whole"), batch.column("ids").to_pylist()
            at = _bounds(batch)
            for i, j in zip(at, [*at[1:], len(ids)]):
                key = whole[i]
                if held is None or key.as_py() != held.as_py():
                    if held is not None:
                        yield _digest(held, digest)
                    held, digest = key, hashlib.sha256(ids[i])
                    i += 1
                for text in ids[i:j]:
                    digest.update(b"," + text)
        if held is not None:
            yield _digest(held, digest)

    start = "struct<n: int, x: long, y: long>"
    sorted_rows = rows.select("whole", "conv_id").repartitionByRange("whole", "conv_id").sortWithinPartitions("whole", "conv_id")
    pieces = sorted_rows.mapInArrow(runs, f"whole {start}, first_id long, ids binary").repartition("whole").sortWithinPartitions("whole", "first_id")
    return pieces.mapInArrow(joined, f"whole {start}, ends_sha256 string")


def _bounds(batch: pa.RecordBatch) -> list[int]:
    """Where a new sequence begins."""
    x, y, n = (np.asarray(batch.column("whole").field(k), np.int64) for k in ("x", "y", "n"))
    if not len(x):
        return []
    return [0, *(np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (n[1:] != n[:-1])) + 1).tolist()]


def _digest(key: pa.Scalar, digest) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key.as_py()], key.type), pa.array([digest.hexdigest()])], ["whole", "ends_sha256"])


# ---- double arrays ----------------------------------------------------------------------------------------------


class DoubleArray:
    """A trie over sequences of dense ids from 0: the child of s by c is base[s] + c if check of that is s.

    Node 0 is the root.  Cells that no node uses have a check of -1.
    """

    def __init__(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Sequence i is codes[starts[i] : starts[i] + sizes[i]]."""
        parents, labels, self.at = self._levels(codes, starts, sizes)
        self._pack(parents, labels)

    def _levels(self, codes, starts, sizes):
        """Edges of the trie, breadth first: parent and label of each node but the root."""
        node, parents, labels, total = np.zeros(len(starts), np.int64), [], [], 1
        spread = int(codes.max(initial=0)) + 1
        for d in range(int(sizes.max(initial=0))):
            on = np.flatnonzero(sizes > d)
            edge, of = np.unique(node[on] * spread + codes[starts[on] + d], return_inverse=True)
            parents.append(edge // spread)
            labels.append(edge % spread)
            node[on] = total + of
            total += len(edge)
        none = [np.zeros(0, np.int64)]
        return np.concatenate(parents or none), np.concatenate(labels or none), node

    def _pack(self, parents: np.ndarray, labels: np.ndarray) -> None:
        """First fit, families with most children first; where none of the free cells tried fits, behind the last."""
        total = len(parents) + 1
        spread = int(labels.max(initial=0)) + 1
        check = np.full(total + spread, -1, np.int64)
        check[0] = 0  # the root's own cell
        begin = np.searchsorted(parents, np.arange(total), "left")  # parents ascend
        size = np.searchsorted(parents, np.arange(total), "right") - begin
        cell = np.zeros(total, np.int64)  # of each node; a child is placed when its parent is
        bases, tail, free = np.zeros(total, np.int64), 1, 1
        taken = np.zeros(len(check), bool)
        taken[0] = True
        for node in np.argsort(-size, kind="stable"):
            k = size[node]
            if not k:
                break
            own = labels[begin[node] : begin[node] + k]
            while free < len(taken) and taken[free]:
                free += 1
            place = None
            for f in range(free, min(free + 64, tail)):  # a try for speed only: the tail always fits
                b = f - own[0]
                if not taken[f] and (k == 1 or b + own[-1] < len(taken) and not taken[b + own].any()):
                    place = b
                    break
            if place is None:
                place = max(tail, free) - own[0]
            need = place + own[-1] + 1
            if need > len(taken):
                grow = max(need, 2 * len(taken)) - len(taken)
                taken, check = np.concatenate([taken, np.zeros(grow, bool)]), np.concatenate([check, np.full(grow, -1, np.int64)])
            at = place + own
            taken[at] = True
            cell[begin[node] + 1 : begin[node] + 1 + k] = at
            bases[node] = place
            tail = max(tail, int(at[-1]) + 1)
        self.check = check[:tail]
        base = np.zeros(tail, np.int64)
        base[cell] = bases
        self.check[cell[1:]] = cell[parents]
        self.base = base

    def step(self, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Children of cells by codes; -1 where there is none."""
        to = self.base[cells] + codes
        ok = (to > 0) & (to < len(self.check))
        ok[ok] = self.check[to[ok]] == cells[ok]
        return np.where(ok, to, -1)


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of a start and one more turn, the same in every task."""
    with np.errstate(over="ignore"):
        z = (x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ y.view(np.uint64)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # the finalizer of splitmix64
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
        return (z ^ (z >> np.uint64(31))).view(np.int64)


NODES = "shared boolean, top boolean, depth long, x long, y long, px long, py long, conv_id long, parent_id long, n_convs long, bytes long, n_children long, n_leaves long, saved long, ends string"


def shard_nodes(a: np.ndarray, b: np.ndarray, n: np.ndarray, sizes: np.ndarray, first: np.ndarray, count: np.ndarray, start: np.ndarray, ends: list[str]) -> dict[str, np.ndarray]:
    """The nodes of whole shards.  a, b, n: turns of all sequences one after another; start: turns in a shard's start."""
    begins = np.cumsum(sizes) - sizes
    # Dense ids by first appearance level by level, so that siblings have ids close together.
    pair = np.ascontiguousarray(np.stack([a, b], axis=1)).view([("a", np.int64), ("b", np.int64)]).reshape(-1)
    _, where, code = np.unique(pair, return_index=True, return_inverse=True)
    depth_of = np.arange(len(a)) - np.repeat(begins, sizes)
    order = np.lexsort((where, depth_of[where]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code = rank[code]
    trie = DoubleArray(code, begins, sizes)

    cells = len(trie.check)
    out = {k: np.zeros(cells, np.int64) for k in ("depth", "x", "y", "n_convs", "bytes", "n_children", "n_leaves", "saved")}
    out["conv_id"] = np.full(cells, np.iinfo(np.int64).max)
    shared, now = np.zeros(cells, bool), np.zeros(len(sizes), np.int64)
    shared[0] = True
    np.add.at(out["n_convs"], now, count)
    np.minimum.at(out["conv_id"], now, first)
    for d in range(int(sizes.max(initial=0))):
        on = np.flatnonzero(sizes > d)
        at = begins[on] + d
        to = trie.step(now[on], code[at])
        out["x"][to], out["y"][to] = _mixed(out["x"][now[on]], a[at]), _mixed(out["y"][now[on]], b[at])
        out["depth"][to], out["bytes"][to] = d + 1, n[at]
        shared[to] |= d + 1 < start[on]
        np.add.at(out["n_convs"], to, count[on])
        np.minimum.at(out["conv_id"], to, first[on])
        now[on] = to
    ended = np.full(cells, "", object)
    ended[now] = ends
    out["ends"], out["shared"] = ended, shared

    used = np.flatnonzero(out["n_convs"])
    whole = used[~shared[used]]
    whole = whole[np.argsort(-out["depth"][whole], kind="stable")]
    np.add.at(out["n_children"], trie.check[whole], 1)
    out["n_leaves"][whole] = out["n_children"][whole] == 0
    out["saved"][whole] = (out["n_convs"][whole] - 1) * out["bytes"][whole]
    for d in range(int(out["depth"][whole].max(initial=0)), 0, -1):
        at = whole[out["depth"][whole] == d]
        up = trie.check[at]
        inner = ~shared[up]
        np.add.at(out["n_leaves"], up[inner], out["n_leaves"][at[inner]])
        np.add.at(out["saved"], up[inner], out["saved"][at[inner]])
    up = trie.check[used]
    out |= {"px": out["x"][up], "py": out["y"][up], "parent_id": out["conv_id"][up], "top": shared[up]}
    return {k: v if k in ("px", "py", "parent_id", "top") else v[used] for k, v in out.items()}


def _pack_shards(batches):
    """Whole shards until there are SHARD sequences; rows arrive sorted by shard."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [tuple(x.values()) for x in batch.column("shard").to_pylist()]
        begin = 0
        for i, key in enumerate(keys):
            last = keys[i - 1] if i else (tuple(held[-1].column("shard")[-1].as_py().values()) if held else None)
            if key != last and rows + i - begin >= SHARD:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                yield _packed(held)
                held, rows, begin = [], 0, i
        if begin < len(keys):
            held.append(batch.slice(begin))
            rows += len(keys) - begin
    if held:
        yield _packed(held)


def _packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(held).combine_chunks()
    flat = lambda c: np.asarray(pa.concat_arrays([x.flatten() for x in t.column(c).chunks]), np.int64)
    plain = lambda c: np.asarray(t.column(c), np.int64)
    got = shard_nodes(flat("a"), flat("b"), flat("n"), plain("size"), plain("conv_id"), plain("n_convs"), plain("start"), t.column("ends_sha256").to_pylist())
    kinds = {"shared": pa.bool_(), "top": pa.bool_(), "ends": pa.string()}
    names = [c.split()[0] for c in NODES.split(", ")]
    return pa.RecordBatch.from_pydict({c: pa.array(got[c], kinds.get(c, pa.int64())) for c in names})


# ---- the shared nodes above -------------------------------------------------------------------------------------


def climb(nodes: DataFrame) -> DataFrame:
    """Adds to every node's leaves and saved those of all nodes below it, over parents given by (px, py).

    Each round adds what stands twice as far below as in the round before.
    """
    spark = nodes.sparkSession
    at = common.fresh_path(spark, "climb")
    nodes.select("x", "y", F.when(F.col("depth") > 0, F.col("px")).alias("px"), F.when(F.col("depth") > 0, F.col("py")).alias("py"), "leaves", "saved").write.parquet(at)
    now = spark.read.parquet(at)
    while now.where("px is not null").limit(1).count():
        below = now.where("px is not null").groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.sum("leaves").alias("l_"), F.sum("saved").alias("s_"))
        up = now.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("px").alias("gx"), F.col("py").alias("gy"))
        now = now.join(below, ["x", "y"], "left").join(up, ["px", "py"], "left")
        now = now.select("x", "y", F.col("gx").alias("px"), F.col("gy").alias("py"), (F.col("leaves") + F.coalesce("l_", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s_", F.lit(0))).alias("saved"))
        at = common.fresh_path(spark, "climb")
        now.write.parquet(at)
        now = spark.read.parquet(at)
    return now.select("x", "y", "leaves", "saved")


def trie(sequences: DataFrame, shard: int | None = None) -> DataFrame:
    """The nodes of (conv_id, turns) rows, turns being an array of structs of two hashes a and b and bytes n."""
    spark, limit = sequences.sparkSession, shard or SHARD
    path = common.fresh_path(spark, "sequences")
    rows = sequences.select("conv_id", F.col("turns.a").alias("a"), F.col("turns.b").alias("b"), F.col("turns.n").alias("n"))
    rows.select("*", F.size("a").alias("size"), _start(F.size("a")).alias("whole")).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    distinct = rows.groupBy("whole", "a", "b", "n", "size").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).join(ends_of(rows), "whole")
    distinct.write.parquet(f"{path}/distinct")
    distinct = spark.read.parquet(f"{path}/distinct")
    # The starts of 1, 2, 4, ... turns that few enough share; the shortest is the shard's.
    powers = F.expr("transform(sequence(0, length(bin(size)) - 1), i -> shiftleft(1, i))")
    cuts = distinct.where("size > 0").select("whole", "a", "b", F.explode(powers).alias("start")).where("start <= size")
    cuts = cuts.select("whole", "start", _start(F.col("start")).alias("shard"))
    few = cuts.groupBy("shard").count().where(F.col("count") <= limit)
    chosen = cuts.join(few, "shard").groupBy("whole").agg(F.min(F.struct("start", "shard")).alias("s")).select("whole", "s.*")
    # A sequence that ends among starts which too many share has only shared nodes.
    dealt = distinct.join(chosen, "whole", "left").withColumn("start", F.coalesce("start", F.col("size") + 1)).withColumn("shard", F.coalesce("shard", "whole"))
    dealt = dealt.select("shard", "start", "size", "conv_id", "n_convs", "ends_sha256", "a", "b", "n").repartition("shard").sortWithinPartitions("shard")
    dealt.mapInArrow(_pack_shards, NODES).write.parquet(f"{path}/nodes")
    nodes = spark.read.parquet(f"{path}/nodes")

    whole, parts = nodes.where("not shared"), nodes.where("shared")
    above = parts.groupBy("x", "y").agg(*[F.max(c).alias(c) for c in ("depth", "px", "py", "bytes", "ends")], F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    above.write.parquet(f"{path}/above")
    above = spark.read.parquet(f"{path}/above")
    hung = whole.where("top").select("px", "py", F.col("n_leaves").alias("leaves"), "saved")
    inner = above.where("depth > 0").select("px", "py", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    children = hung.unionByName(inner).groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    above = above.join(children, ["x", "y"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    above = above.withColumn("leaves", F.coalesce("leaves", F.lit(0)) + F.when(F.col("n_children") == 0, 1).otherwise(0)).withColumn("saved", F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("bytes"))
    above.write.parquet(f"{path}/counted")
    above = spark.read.parquet(f"{path}/counted")
    above = above.drop("leaves", "saved").join(climb(above), ["x", "y"])

    fields = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.when(F.col("ends") == "", EMPTY).otherwise(F.col("ends")).alias("ends_sha256")]
    parents = above.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    shared = above.withColumnRenamed("leaves", "n_leaves").join(parents, ["px", "py"], "left").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("parent_conv_id")))
    tops = whole.where("top").join(parents, ["px", "py"])
    inside = whole.where("not top").withColumn("parent_conv_id", F.col("parent_id"))
    return shared.select(*fields).unionByName(tops.select(*fields)).unionByName(inside.select(*fields))


def op12_turntrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(common.table(spark, sf_dir, "conversations")))


_CRC = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: [ascii(ch), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295)"

ORACLE = f"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, {_CRC} % {HEADS} AS h, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST) AS ts FROM t GROUP BY c),
r AS (SELECT o.c, list_concat(p.ts[1:o.h], o.ts[o.h + 1:]) AS ts FROM o LEFT JOIN o p ON p.c = o.c - o.c % {FAMILY}),
m AS (SELECT c, ts, unnest(range(len(ts) + 1)) AS d FROM r),
g AS (SELECT ts[1:d] AS k, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(ts) = d), '') AS ends FROM m GROUP BY 1, 2),
w AS (SELECT k, d, n_convs, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(k[d].text)) END AS saved FROM g),
u AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n FROM g WHERE d > 0 GROUP BY 1, 2),
x AS (SELECT w.*, coalesce(n, 0) AS n, unnest(range(w.d + 1)) AS e FROM w LEFT JOIN u ON u.k = w.k AND u.d = w.d),
s AS (SELECT k[1:e] AS k, e AS d, sum(saved) AS saved, count(*) FILTER (n = 0) AS leaves FROM x GROUP BY 1, 2)
SELECT g.conv_id, CAST(g.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(g.n_convs AS BIGINT) AS n_convs, CAST(coalesce(u.n, 0) AS BIGINT) AS n_children,
    CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(g.ends) AS ends_sha256
FROM g JOIN s ON s.k = g.k AND s.d = g.d LEFT JOIN u ON u.k = g.k AND u.d = g.d LEFT JOIN g p ON g.d > 0 AND p.d = g.d - 1 AND p.k = g.k[1:g.d - 1]
"""
