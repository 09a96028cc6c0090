"""Substring near-duplicates by compact windows.

A document is a sequence of five-word shingles.  For each of ``HASHES`` hash functions a Cartesian tree over
the shingles' hashes gives *compact windows* (first, least, last): every passage of at least ``WORDS`` words
inside the window that holds the least shingle has that shingle as its min-hash.  Windows of different
documents with equal min-hash say that passages of theirs share that signature.  Where windows of a pair of
documents, of ``NEED`` hash functions and near one diagonal, have a passage in common (an interval join of
their spans), that passage is a candidate, which is grown and verified on the texts.

Pairs are not listed in full, as they grow with the square of a group.  What is asked of a document is which of
its passages repeat one of a smaller id, so

1. every window is joined with those of the ``LEADERS`` smallest documents of its signature, and verified where
   ``FIRST`` hash functions agree;
2. a shingle is *unseen* if no smaller document has it where its own repeated windows join.  A passage with too many
   unseen shingles has no partner at all; one that verified passages cover has its partner;
3. what is then left open is held against all smaller documents of its signature, in cells of bounded parts: the
   shingles around both places are compared, and windows that can have a similar passage are joined and verified,
   first the ``TRIED`` most similar of each cell, then all for passages that are open still.

So joined windows don't grow with the square of a group, and no passage with a partner is lost.
Exact copies of a whole text are one document up to the end.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE, WORDS = 5, 50
LEAST = WORDS - SHINGLE + 1
HASHES, NEED, FIRST = 4, 2, 3
SIMILARITY = 0.8
#: Shingles that a passage of LEAST shingles must share with one as long, to be similar enough.
SHARED = int(np.ceil(2 * LEAST * SIMILARITY / (1 + SIMILARITY)))
LEADERS, TRIED, PART = 1, 4, 1024
BAND, GAP = 16, 2 * LEAST
#: A passage is covered if so much of it lies in verified ones.
COVERED = 0.7
#: Shingles to both sides of a window's place that are compared, and how far words may have moved there.
AROUND, SHIFT = LEAST + LEAST // 4, 4
#: Equal shingles so close are one run of repeated words, of which the first stands for all.
PERIOD = 8
#: A signature is dealt by document too if it is in so many of so many sampled documents.  Only the dealing
#: depends on the sample, no result does.
SAMPLED, OFTEN, SALTS = 3000, 12, 64
REACH = (1 << 16) - 1
#: Texts whose shingles a verifying task remembers.
CACHED = 256
LINK = "v long, b long, at_b long, a long, at_a long"
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_NONE = np.iinfo(np.uint64).max


def shingles(text: bytes) -> np.ndarray:
    """64-bit hashes of the five-word shingles, ASCII letters in lower case."""
    import xxhash

    words = text.lower().split()
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = (out ^ own[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return out


def mixed(h: np.ndarray, f: int) -> np.ndarray:
    x = (h ^ (h >> np.uint64(31 + f))) * np.uint64(_MIX[f % 4] + 2 * f)
    return x ^ (x >> np.uint64(32))


def repeats_nearby(base: np.ndarray) -> np.ndarray:
    """True where a shingle occurs at most PERIOD places before."""
    out = np.zeros(len(base), bool)
    for d in range(1, min(PERIOD, len(base) - 1) + 1):
        out[d:] |= base[d:] == base[:-d]
    return out


def compact_windows(h: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(first, place of the least hash, end) of each window that can hold ``least`` shingles; ties go left."""
    out, open_ = [], [(0, len(h))] if len(h) >= least else []
    while open_:
        a, b = open_.pop()
        m = a + int(h[a:b].argmin())
        if h[m] == _NONE:  # nothing but runs of repeated words
            continue
        out.append((a, m, b))
        if m - a >= least:
            open_.append((a, m))
        if b - m > least:
            open_.append((m + 1, b))
    return out


def packed(f: int, a: np.ndarray, c: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Place of the least shingle, hash function, and reach of the window to both sides, as longs."""
    return (c << 34) | (f << 32) | (np.minimum(c - a, REACH) << 16) | np.minimum(b - 1 - c, REACH)


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash function, reach to the left, reach to the right)."""
    return at >> 34, (at >> 32) & 3, (at >> 16) & REACH, at & REACH


def _windows(docs: DataFrame) -> DataFrame:
    """(v, doc, at) of all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                cols = [[] for _ in range(3)]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    base = shingles(text.as_buffer().to_pybytes() if text.is_valid else b"")
                    if len(base) < LEAST:
                        continue
                    again = repeats_nearby(base)
                    for f in range(HASHES):
                        h = mixed(base, f)
                        h[again] = _NONE
                        if windows := compact_windows(h):
                            a, c, b = np.array(windows).T
                            cols[0].append(h[c].view(np.int64))
                            cols[1].append(np.full(len(c), doc))
                            cols[2].append(packed(f, a, c, b))
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in cols], ["v", "doc", "at"])

    return docs.mapInArrow(run, "v long, doc long, at long")


def _batch(names: list[str], *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)


def _with_leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (v, salt, doc, at): each window with those of the group's smallest documents.

    The k-th window of a document is joined with the leader's k-th (or last) and first.  Of salted groups the
    leaders come out once more, without a partner.  No more than the leaders and one document is held.
    """
    names = ("salt", "v", "doc", "at")
    held, old = [np.empty(0, np.int64)] * 4, np.empty(0, bool)
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held = [np.concatenate((h, np.asarray(batch.column(n)))) for h, n in zip(held, names)]
            old = np.concatenate((old, np.zeros(batch.num_rows, bool)))
        salt, v, doc, at = held
        n = len(v)
        if not n:
            continue
        group_starts = np.concatenate(([True], (v[1:] != v[:-1]) | (salt[1:] != salt[:-1])))
        run_starts = group_starts | np.concatenate(([True], doc[1:] != doc[:-1]))
        run = np.cumsum(run_starts) - 1
        firsts = np.flatnonzero(run_starts)
        lengths = np.diff(np.append(firsts, n))
        group_run = run[np.flatnonzero(group_starts)][np.cumsum(group_starts) - 1]  # the group's first run
        rank = run - group_run
        ready = ~old if batch is None else ~old & (run < run[-1])
        nth = np.arange(n) - firsts[run]
        for r in range(LEADERS):
            i = np.flatnonzero(ready & (rank > r))
            lead = group_run[i] + r
            to = firsts[lead] + np.minimum(nth[i], lengths[lead] - 1)
            yield _batch(["v", "b", "at_b", "a", "at_a"], v[i], doc[i], at[i], doc[to], at[to])
            more = to > firsts[lead]
            i, to = i[more], firsts[lead[more]]
            yield _batch(["v", "b", "at_b", "a", "at_a"], v[i], doc[i], at[i], doc[to], at[to])
        i = np.flatnonzero(ready & (rank < LEADERS) & (salt >= 0))
        if len(i):
            none = pa.nulls(len(i), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v[i]), pa.array(doc[i]), pa.array(at[i]), none, none], ["v", "b", "at_b", "a", "at_a"])
        last = (v == v[-1]) & (salt == salt[-1])
        keep = last & ((rank < LEADERS) | (run == run[-1]))
        old = (run < run[-1])[keep]
        held = [x[keep] for x in held]


def _sorted_groups(windows: DataFrame) -> DataFrame:
    return windows.repartition("v", "salt").sortWithinPartitions("v", "salt", "doc", "at").select("salt", "v", "doc", "at").mapInArrow(_with_leaders, LINK)


def _links(wanted: DataFrame, count: int, path: str) -> DataFrame:
    """Windows joined with those of the smallest documents of equal signature, written to path."""
    spark = wanted.sparkSession
    some = wanted.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(max(count, 1))) < SAMPLED)
    hot = _windows(some).groupBy("v").agg(F.count_distinct("doc").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "v").limit(10_000).select("v", F.lit(True).alias("hot"))
    dealt = _windows(wanted).join(F.broadcast(hot), "v", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc"), F.lit(SALTS))).otherwise(F.lit(-1)).cast("long"))
    _sorted_groups(dealt).write.parquet(f"{path}/own")
    own = spark.read.parquet(f"{path}/own")
    leaders = own.where("a is null").select("v", F.col("b").alias("doc"), F.col("at_b").alias("at"), F.lit(-1).cast("long").alias("salt"))
    _sorted_groups(leaders).write.parquet(f"{path}/leaders")
    return own.where("a is not null").unionByName(spark.read.parquet(f"{path}/leaders"))


def _joined(a: np.ndarray, b: np.ndarray, c: np.ndarray, diagonal: np.ndarray, f: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of spans sorted by (a, b, c): the hash functions each joins with, as bits, and the joined spans' ends.

    Two spans lo..hi around places c join if a passage of LEAST shingles in both holds both places, near one diagonal.
    """
    bits, n = 1 << f, len(c)
    low, high = c.copy(), c.copy()
    i, step = np.arange(n), 0
    while True:
        step += 1
        i = i[i + step < n]
        j = i + step
        near = (a[i] == a[j]) & (b[i] == b[j]) & (c[j] <= hi[i])
        i, j = i[near], j[near]
        if not len(i):
            return bits, low, high
        first, last = np.maximum(lo[i], lo[j]), np.minimum(hi[i], hi[j])
        both = (lo[j] <= c[i]) & (last - first >= LEAST - 1) & (np.abs(diagonal[i] - diagonal[j]) <= BAND) & (f[i] != f[j])
        k, m = i[both], j[both]
        for x, y in ((k, m), (m, k)):
            np.bitwise_or.at(bits, x, 1 << f[y])
            np.minimum.at(low, x, first[both])
            np.maximum.at(high, x, last[both])


def _anchors(need: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of links sorted by pair and place: one row per pair with the places of links whose spans, cut to what both
    documents' windows reach, join in enough hash functions."""
    names = ("a", "b", "at_b", "at_a")
    held = [np.empty(0, np.int64)] * 4
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held = [np.concatenate((h, np.asarray(batch.column(n)))) for h, n in zip(held, names)]
        a, b, at_b, at_a = held
        if not len(a):
            continue
        cut = len(a)
        if batch is not None:
            cut = int(np.flatnonzero((a != a[-1]) | (b != b[-1]))[-1]) + 1 if (a[0], b[0]) != (a[-1], b[-1]) else 0
        if cut:
            a, b, at_b, at_a = (x[:cut] for x in held)
            cb, f, left_b, right_b = unpacked(at_b)
            ca, _, left_a, right_a = unpacked(at_a)
            lo, hi = cb - np.minimum(left_a, left_b), cb + np.minimum(right_a, right_b)
            bits = _joined(a, b, cb, cb - ca, f, lo, hi)[0]
            good = np.flatnonzero(np.bitwise_count(bits) >= need)
            if len(good):
                a, b, cb, ca = a[good], b[good], cb[good], ca[good]
                starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
                offsets = pa.array(np.append(starts, len(a)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (ca, cb)]
                yield pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(b[starts]), *lists], ["a", "b", "at_a", "at_b"])
        held = [x[cut:] for x in held]


def _grown(x: np.ndarray, y: np.ndarray) -> int:
    """How far to go along equal places: to the best score, given up once it has fallen far below."""
    best, at, total, n = 0, 0, 0, 64
    start = 0
    while start < len(x):
        score = np.where(x[start : start + n] == y[start : start + n], 1, -4)
        score[0] += total
        score = score.cumsum()
        top = np.maximum.accumulate(np.maximum(score, best))
        fell = top - score > 8 * SHINGLE
        down = int(fell.argmax())
        over = bool(fell[down])
        score = score[:down] if over else score
        if len(score):
            k = int(score.argmax())
            if score[k] > best:
                best, at = int(score[k]), start + k + 1
        if over:
            break
        total, start, n = int(score[-1]), start + n, 4 * n
    return at


def _similarity(x: np.ndarray, y: np.ndarray) -> float:
    mine, other = set(x.tolist()), set(y.tolist())
    both = len(mine & other)
    return both / max(len(mine) + len(other) - both, 1)


def _stretched(x: np.ndarray, y: np.ndarray, e: int, g: int) -> tuple[int, int]:
    """The ends e, g of a passage, moved ahead to the last shingle that a similar window of LEAST shingles reaches.

    Growth stops short of a few equal shingles behind a change; on another diagonal it doesn't see them.
    """
    if g >= len(y) or e >= len(x) or g < LEAST:
        return e, g
    at = max(e - LEAST - BAND, 0)
    own, near = y[g - LEAST : g + LEAST], x[at : e + LEAST + BAND]
    equal = np.isin(own, near)
    sums = np.concatenate(([0], np.cumsum(equal)))
    bad = np.flatnonzero(sums[LEAST:] - sums[:-LEAST] < SHARED)
    far = (int(bad[0]) if len(bad) else len(own) - LEAST + 1) - 1 + LEAST
    q = np.flatnonzero(equal[:far])
    if far <= LEAST or not len(q) or (q := int(q[-1])) < LEAST:
        return e, g
    places = np.flatnonzero(near == own[q]) + at
    p = int(places[np.abs(places - (e + q - LEAST)).argmin()])
    if p < max(e, LEAST - 1) or _similarity(x[p + 1 - LEAST : p + 1], own[q + 1 - LEAST : q + 1]) < SIMILARITY:
        return e, g
    return p + 1, g - LEAST + q + 1


def verify(x: np.ndarray, y: np.ndarray, a0: int, b0: int, a1: int, b1: int) -> tuple[int, int, int, int, float] | None:
    """The passage grown from a0, b0 back and from a1, b1 ahead, as (start, end) in words of both texts and its similarity."""
    n = min(a0, b0)
    back = _grown(x[a0 - n : a0][::-1], y[b0 - n : b0][::-1])
    n = min(len(x) - a1 - 1, len(y) - b1 - 1)
    ahead = _grown(x[a1 + 1 : a1 + 1 + n], y[b1 + 1 : b1 + 1 + n])
    s, e, t, g = a0 - back, a1 + 1 + ahead, b0 - back, b1 + 1 + ahead
    if min(e - s, g - t) < LEAST or (j := _similarity(x[s:e], y[t:g])) < SIMILARITY:
        return None
    end, last = _stretched(x, y, e, g)
    first, start = (len(z) - k for z, k in zip((x, y), _stretched(x[::-1], y[::-1], len(x) - s, len(y) - t)))
    if (first, end, start, last) != (s, e, t, g) and (k := _similarity(x[first:end], y[start:last])) >= SIMILARITY:
        s, e, t, g, j = first, end, start, last, k
    return s, e + SHINGLE - 1, t, g + SHINGLE - 1, j


def _around(x: np.ndarray, y: np.ndarray, a: int, b: int) -> list[tuple[int, int, int, int, float]]:
    """Similar passages on one diagonal near a, b: runs of windows of LEAST shingles that are similar enough."""
    far = 2 * LEAST
    back, ahead = min(a, b, far), min(len(x) - a, len(y) - b, far)
    equal = x[a - back : a + ahead] == y[b - back : b + ahead]
    if len(equal) < LEAST:
        return []
    sums = np.concatenate(([0], np.cumsum(equal)))
    good = np.flatnonzero(sums[LEAST:] - sums[:-LEAST] >= SHARED)
    out = []
    for part in np.split(good, np.flatnonzero(np.diff(good) > 1) + 1) if len(good) else []:
        s, t = int(part[0]) + a - back, int(part[0]) + b - back
        for n in (int(part[-1] - part[0]) + LEAST, LEAST):  # the whole run, or else its first window
            if (j := _similarity(x[s : s + n], y[t : t + n])) >= SIMILARITY:
                out.append((s, s + n + SHINGLE - 1, t, t + n + SHINGLE - 1, j))
                break
    return out + _scattered(x, y, a, b, out)


def _scattered(x: np.ndarray, y: np.ndarray, a: int, b: int, known: list[tuple[int, int, int, int, float]]) -> list[tuple[int, int, int, int, float]]:
    """Windows of LEAST shingles near b that are similar to one near a on any diagonals, a quarter window apart; not those in known passages."""
    far = 2 * LEAST
    at_b, at_a = max(b - far, 0), max(a - far - BAND, 0)
    own, near = y[at_b : b + far], x[at_a : a + far + BAND]
    if min(len(own), len(near)) < LEAST:
        return []
    others = set(near.tolist())
    sums = np.cumsum([0, *(k in others for k in own.tolist())])
    places = np.flatnonzero(sums[LEAST:] - sums[:-LEAST] >= SHARED).tolist()
    places = [q for q in places if not any(t <= at_b + q and at_b + q + WORDS <= g for _, _, t, g, _ in known)]
    if not places:
        return []
    low, high = places[0], places[-1] + LEAST
    equal = np.zeros((high - low + 1, len(near)), np.int16)
    np.cumsum(own[low:high, None] == near, axis=0, out=equal[1:])
    held = np.zeros((len(places), len(near) + 1), np.int16)  # of each window of own: the shingles of near in it, summed up
    starts = np.array(places) - low
    np.cumsum(equal[starts + LEAST] > equal[starts], axis=1, out=held[:, 1:])
    both = held[:, LEAST:] - held[:, :-LEAST]
    most = both.max(axis=1)
    least = SHARED if len(others) == len(near) and len(set(own.tolist())) == len(own) else 1  # repeats count once in the similarity
    out, done = [], -1
    for k, q in enumerate(places):
        if q < done or most[k] < least:
            continue
        best = np.flatnonzero(both[k] == most[k])
        p = int(best[np.abs(best + at_a - a - q - at_b + b).argmin()])
        if (j := _similarity(near[p : p + LEAST], own[q : q + LEAST])) >= SIMILARITY:
            out.append((at_a + p, at_a + p + WORDS, at_b + q, at_b + q + WORDS, j))
            done = q + LEAST // 4
    return out


def passages(x: np.ndarray, y: np.ndarray, at_a: list[int], at_b: list[int]) -> list[tuple[int, int, int, int, float]]:
    """Verified passages from the anchors of a pair, sorted by their place in y.

    A chain of near anchors is tried as a whole; one that is not similar enough is cut at a wide gap near its middle.
    """
    found: list[tuple[int, int, int, int, float]] = []
    anchors = sorted(set(zip(at_b, at_a)))
    chains: list[list[tuple[int, int]]] = []
    growing: list[list[tuple[int, int]]] = []
    for q, p in anchors:
        growing = [c for c in growing if q - c[-1][0] <= GAP]  # anchors come in order of q
        for chain in reversed(growing):
            if abs((q - p) - (chain[-1][0] - chain[-1][1])) <= BAND and p >= chain[-1][1]:
                chain.append((q, p))
                break
        else:
            chains.append([(q, p)])
            growing.append(chains[-1])
    while chains:
        chain = chains.pop()
        (b0, a0), (b1, a1) = chain[0], chain[-1]
        if any(t <= b0 and b1 + SHINGLE <= g and s <= a0 and a1 + SHINGLE <= e for s, e, t, g, _ in found):
            continue
        if one := verify(x, y, a0, b0, a1, b1):
            found.append(one)
        elif len(chain) > 1:
            n = len(chain)  # near the middle, so that a long chain is cut few times
            places = range(max(1, n // 4), max(2, n - n // 4))
            cut = max(places, key=lambda k: chain[k][0] - chain[k - 1][0] + 4 * abs(chain[k][0] - chain[k][1] - chain[k - 1][0] + chain[k - 1][1]))
            chains += [chain[:cut], chain[cut:]]
        else:
            found += [p for p in _around(x, y, a0, b0) if p not in found]
    return found


FOUND = "doc_id long, start_word int, end_word int, source_id long, source_start int, source_end int, similarity double"


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cached = functools.lru_cache(CACHED)(shingles)
    for batch in batches:
        rows = []
        get = [batch.column(n).to_pylist() for n in ("a", "b", "at_a", "at_b")]
        for a, b, at_a, at_b, ta, tb in zip(*get, batch.column("text_a"), batch.column("text_b")):
            x, y = cached(ta.as_buffer().to_pybytes()), cached(tb.as_buffer().to_pybytes())
            rows += [(b, t, g, a, s, e, j) for s, e, t, g, j in passages(x, y, at_a, at_b)]
        cols = list(zip(*dict.fromkeys(rows))) or [()] * 7
        i = pa.int32()
        kinds = [pa.int64(), i, i, pa.int64(), i, i, pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "start_word", "end_word", "source_id", "source_start", "source_end", "similarity"])


def _found(links: DataFrame, texts: DataFrame, need: int, path: str) -> DataFrame:
    """Verified passages of linked pairs, written to path."""
    pairs = links.select("a", "b", "at_b", "at_a").repartition("a", "b").sortWithinPartitions("a", "b", "at_b", "at_a").mapInArrow(functools.partial(_anchors, need), "a long, b long, at_a array<int>, at_b array<int>")
    text = lambda k: texts.select(F.col("doc_id").alias(k), F.col("text").cast("binary").alias(f"text_{k}"))
    pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "at_a", "at_b", "text_a", "text_b").mapInArrow(_verified, FOUND).write.parquet(path)
    return texts.sparkSession.read.parquet(path)


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, runs) of documents (doc, ats): runs of shingle places near which repeated windows join in enough hash functions."""
    for batch in batches:
        lists = batch.column("ats")
        at = np.asarray(lists.flatten())
        own = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
        order = np.lexsort((at, own))
        own, (c, f, left, right) = own[order], unpacked(at[order])
        none = np.zeros(len(c), np.int64)
        bits, low, high = _joined(none, own, c, none, f, c - left, c + right)
        good = np.bitwise_count(bits) >= NEED
        out: dict[int, list[list[int]]] = {}
        for k, s, e in zip(own[good].tolist(), np.maximum(low, c - AROUND)[good].tolist(), (np.minimum(high, c + AROUND) + 1)[good].tolist()):
            runs = out.setdefault(k, [])
            if runs and s <= runs[-1][1]:
                runs[-1] = [min(runs[-1][0], s), max(runs[-1][1], e)]
            else:
                runs.append([s, e])
        docs = batch.column("doc").take(pa.array(list(out), pa.int64()))
        yield pa.RecordBatch.from_arrays([docs, pa.array(list(out.values()), pa.list_(pa.list_(pa.int32())))], ["doc", "runs"])


def _region_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s, doc, pos) of the shingles in the regions of documents."""
    for batch in batches:
        out = [[], [], []]
        for doc, runs, text in zip(batch.column("doc").to_pylist(), batch.column("runs").to_pylist(), batch.column("text")):
            base = shingles(text.as_buffer().to_pybytes())
            pos = np.concatenate([np.arange(s, min(e, len(base))) for s, e in runs])
            for o, x in zip(out, (base[pos].view(np.int64), np.full(len(pos), doc), pos.astype(np.int32))):
                o.append(x)
        if out[0]:
            yield _batch(["s", "doc", "pos"], *(np.concatenate(o) for o in out))


def open_places(runs: list[list[int]], unseen: np.ndarray, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of shingle places in passages that have few unseen shingles and are not covered by verified ones."""
    n = max((e for _, e in runs), default=0)
    if n < LEAST:
        return []
    lacking, done = np.ones(n, np.int64), np.zeros(n + 1, np.int64)
    for s, e in runs:
        lacking[s:e] = 0
    lacking[unseen] = 1
    for s, e in covered:  # of words
        done[min(s, n)] += 1
        done[min(max(e - SHINGLE + 1, s), n)] -= 1
    done = (np.cumsum(done)[:n] > 0).astype(np.int64)
    sums, over = (np.concatenate(([0], np.cumsum(x))) for x in (lacking, done))
    starts = np.flatnonzero((sums[LEAST:] - sums[:-LEAST] <= LEAST - SHARED) & (over[LEAST:] - over[:-LEAST] < COVERED * LEAST))
    out: list[tuple[int, int]] = []
    for s in starts.tolist():
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + LEAST)
        else:
            out.append((s, s + LEAST))
    return out


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, s, e) of the open places of documents."""
    for batch in batches:
        rows = []
        for doc, runs, unseen, spans in zip(batch.column("doc").to_pylist(), batch.column("runs").to_pylist(), batch.column("unseen"), batch.column("spans").to_pylist()):
            places = np.asarray(unseen.values) if unseen.is_valid else np.empty(0, np.int64)
            rows += [(doc, s, e) for s, e in open_places(runs, places, [(x["s"], x["e"]) for x in spans or ()])]
        cols = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32()))], ["doc", "s", "e"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, doc, at, around) of windows: one byte for each shingle around its place, 0 outside the text."""
    margin = AROUND + SHIFT
    for batch in batches:
        for k in range(0, batch.num_rows, 100):
            out: list[list] = [[], [], [], []]
            part = batch.slice(k, 100)
            for doc, windows, text in zip(part.column("doc").to_pylist(), part.column("windows"), part.column("text")):
                base = shingles(text.as_buffer().to_pybytes())
                short = np.zeros(len(base) + 2 * margin, np.uint8)
                short[margin:-margin] = mixed(base, 3) % np.uint64(255) + np.uint64(1)
                v, at = (np.asarray(windows.values.field(n)) for n in ("v", "at"))
                for o, x in zip(out, (v, np.full(len(v), doc), at)):
                    o.append(x)
                out[3] += [short[c : c + 2 * margin + 1].tobytes() for c in (at >> 34).tolist()]
            if out[0]:
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(o)) for o in out[:3]), pa.array(out[3], pa.binary())], ["v", "doc", "at", "around"])


def _likeness(own: np.ndarray, others: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Of each row of others: the most shingles that a passage of LEAST from own, around its place and in lo..hi, shares with it."""
    first, last = max(lo, 1 - LEAST), min(hi, LEAST)
    n = last - first
    if n < LEAST:
        return np.zeros(len(others), np.int64)
    start = AROUND + SHIFT + first
    mine = own[start : start + n]
    equal = np.zeros((len(others), n), bool)
    for d in range(-SHIFT, SHIFT + 1):
        equal |= others[:, start + d : start + d + n] == mine
    equal &= mine > 0
    sums = np.zeros((len(others), n + 1), np.int16)
    np.cumsum(equal, axis=1, out=sums[:, 1:])
    return (sums[:, LEAST:] - sums[:, :-LEAST]).max(axis=1)


def _in_cells(tried: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by cell: links of the open windows of one part with the windows of smaller documents in the
    other that are like enough: all, or those of the most similar ones."""
    names = ("v", "p", "q", "open", "doc", "at", "lo", "hi")
    width = 2 * (AROUND + SHIFT) + 1
    held, around = [np.empty(0, np.int64)] * len(names), np.empty((0, width), np.uint8)
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held = [np.concatenate((h, np.asarray(batch.column(n)).astype(np.int64))) for h, n in zip(held, names)]
            around = np.concatenate((around, np.frombuffer(b"".join(batch.column("around").to_pylist()), np.uint8).reshape(-1, width)))
        v, p, q, open_, doc, at, lo, hi = held
        if not len(v):
            continue
        ends = np.append(np.flatnonzero((v[1:] != v[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1, [len(v)] if batch is None else []).astype(int)
        start = 0
        for end in ends.tolist():
            cut = start + int(np.searchsorted(open_[start:end], 1))
            for i in range(cut, end):
                j = np.arange(start, start + int(np.searchsorted(doc[start:cut], doc[i])))
                like = _likeness(around[i], around[j], int(lo[i]), int(hi[i]))
                j, like = j[like >= SHARED], like[like >= SHARED]
                order = np.lexsort((at[j], -like, doc[j]))  # of each document the window that is most like
                j, like = j[order], like[order]
                one = np.concatenate(([True], doc[j][1:] != doc[j][:-1]))[: len(j)]
                j, like = j[one], like[one]
                if tried and len(j) > tried:
                    j = j[np.lexsort((doc[j], -like))[:tried]]
                if len(j):
                    yield _batch(["v", "b", "at_b", "a", "at_a"], v[j], np.full(len(j), doc[i]), np.full(len(j), at[i]), doc[j], at[j])
            start = end
        held, around = [x[start:] for x in held], around[start:]


def _open_windows(members: DataFrame, open_: DataFrame, path: str) -> DataFrame:
    """(v, doc, at, lo, hi) of the windows in open places, written to path; lo and hi are the place's ends from the window's."""
    place = F.shiftright("at", 34)
    mine = members.join(open_, "doc").where((place >= F.col("s")) & (place < F.col("e"))).select("v", "doc", "at", (F.col("s") - place).alias("lo"), (F.col("e") - place).alias("hi"))
    mine.write.parquet(path)
    return open_.sparkSession.read.parquet(path)


def _used(members: DataFrame, mine: DataFrame, texts: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Texts of the documents that share a signature with open windows, and the contexts of their windows."""
    spark = texts.sparkSession
    in_use = members.join(mine.select("v").distinct(), "v", "left_semi").groupBy("doc").agg(F.collect_list(F.struct("v", "at")).alias("windows"))
    in_use.join(texts.select(F.col("doc_id").alias("doc"), F.col("text").cast("binary").alias("text")), "doc").select("doc", "windows", "text").write.parquet(f"{path}/used")
    used = spark.read.parquet(f"{path}/used")
    used.mapInArrow(_contexts, "v long, doc long, at long, around binary").write.parquet(f"{path}/around")
    return used.select(F.col("doc").alias("doc_id"), "text"), spark.read.parquet(f"{path}/around")


def _open_links(members: DataFrame, mine: DataFrame, around: DataFrame, tried: int | None) -> DataFrame:
    """Links of the open windows with like windows of smaller documents of their signature."""
    asked = mine.groupBy("v").agg(F.ceil(F.count("*") / PART).cast("int").alias("rows"))
    parts = members.join(asked, "v").groupBy("v", "rows").agg(F.ceil(F.count("*") / PART).cast("int").alias("cols"))
    around = around.join(parts, "v")
    part = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    rows = around.join(mine, ["v", "doc", "at"]).select("v", part("rows").alias("p"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("q"), F.lit(1).alias("open"), "doc", "at", "lo", "hi", "around")
    zero = F.lit(0).cast("long")
    cols = around.select("v", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("p"), part("cols").alias("q"), F.lit(0).alias("open"), "doc", "at", zero.alias("lo"), zero.alias("hi"), "around")
    return rows.unionByName(cols).repartition("v", "p", "q").sortWithinPartitions("v", "p", "q", "open", "doc", "at").mapInArrow(functools.partial(_in_cells, tried), LINK)


def _one_text(docs: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) with one row per id, the text least in order, and (doc_id, p, n): the hash and words of that text."""
    spark = docs.sparkSession
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.select("doc_id", text_hash("text").alias("p"), F.size(F.split(F.trim("text"), r"[\x20\x09-\x0D]+")).alias("n")).write.parquet(f"{path}/rows")
    prints = spark.read.parquet(f"{path}/rows")
    twice = prints.groupBy("doc_id").count().where("count > 1").select("doc_id")
    twice.write.parquet(f"{path}/twice")
    twice = spark.read.parquet(f"{path}/twice")
    if twice.isEmpty():
        return rows, prints
    least = rows.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    least.write.parquet(f"{path}/least")
    least = spark.read.parquet(f"{path}/least")
    chosen = least.select("doc_id", text_hash("text").alias("p"))
    one = prints.join(twice, "doc_id", "left_anti").unionByName(prints.join(chosen, ["doc_id", "p"], "left_semi").dropDuplicates(["doc_id"]).select(prints.columns))
    return rows.join(twice, "doc_id", "left_anti").unionByName(least), one


def text_hash(text: str):
    return F.struct(F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages of at least WORDS words that near-duplicate one in a document of smaller id.

    One row per passage and partner: doc_id, start_word, end_word (words from start to end - 1), the same
    of its source, and the Jaccard similarity of their shingles.  A passage has the partners among the
    LEADERS smallest documents of its signatures, or where none of them verifies, all smaller ones.  An exact
    copy of a whole text has one row, against the smallest id with that text; every other text is compared
    through that id.  Rows with a null id or text and texts under WORDS words have no passage; of rows that
    repeat an id the text least in order counts.  Passages that repeat inside one document only are not
    reported.  Other columns are not read.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    path = common.fresh_path(spark, "passages")
    rows, prints = _one_text(docs, path)
    prints = prints.where(F.col("n") >= WORDS)
    groups = prints.groupBy("p").agg(F.min("doc_id").alias("source_id"), F.count("*").alias("times"))
    groups.write.parquet(f"{path}/groups")
    groups = spark.read.parquet(f"{path}/groups")
    copies = prints.join(groups.where("times > 1"), "p").where("doc_id > source_id").select("doc_id", "source_id", "n")
    copies.write.parquet(f"{path}/copies")
    copies = spark.read.parquet(f"{path}/copies")
    wanted = rows.join(copies.select("doc_id"), "doc_id", "left_anti")

    links = _links(wanted, groups.count(), path)
    first = _found(links, wanted, FIRST, f"{path}/first")
    members = links.select("v", F.col("b").alias("doc"), F.col("at_b").alias("at")).unionByName(links.select("v", F.col("a").alias("doc"), F.col("at_a").alias("at"))).distinct()
    members.write.parquet(f"{path}/members")
    members = spark.read.parquet(f"{path}/members")
    members.groupBy("doc").agg(F.collect_list("at").alias("ats")).mapInArrow(_regions, "doc long, runs array<array<int>>").write.parquet(f"{path}/regions")
    near = spark.read.parquet(f"{path}/regions")
    both = near.join(wanted.select(F.col("doc_id").alias("doc"), F.col("text").cast("binary").alias("text")), "doc").select("doc", "runs", "text")
    both.mapInArrow(_region_shingles, "s long, doc long, pos int").write.parquet(f"{path}/shingles")
    shingle = spark.read.parquet(f"{path}/shingles")
    seen = shingle.join(shingle.groupBy("s").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last"), "s", "left")
    seen.where("first is null or first = doc").groupBy("doc").agg(F.collect_list("pos").alias("unseen")).write.parquet(f"{path}/unseen")
    looked = near.join(spark.read.parquet(f"{path}/unseen"), "doc", "left")
    found = first
    for tried in (TRIED, None):
        spans = found.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_set(F.struct(F.col("start_word").alias("s"), F.col("end_word").alias("e"))).alias("spans"))
        looked.join(spans, "doc", "left").select("doc", "runs", "unseen", "spans").mapInArrow(_open, "doc long, s int, e int").write.parquet(f"{path}/open{tried}")
        mine = _open_windows(members, spark.read.parquet(f"{path}/open{tried}"), f"{path}/mine{tried}")
        if tried:  # what is open later was open before
            used, around = _used(members, mine, wanted, path)
        more = _found(_open_links(members, mine, around, tried), used, NEED, f"{path}/more{tried}")
        found = found.unionByName(more.join(found, found.columns, "left_anti"))
    whole = copies.select("doc_id", F.lit(0).alias("start_word"), F.col("n").alias("end_word"), "source_id", F.lit(0).alias("source_start"), F.col("n").alias("source_end"), F.lit(1.0).alias("similarity"))
    return found.unionByName(whole)


def _without_repeats(docs: DataFrame) -> DataFrame:
    """The rows, of equal doc_id and text the one whose other columns are least."""
    found = docs.where("doc_id is not null").groupBy("doc_id", F.xxhash64("text").alias("h")).count().where("count > 1").select("doc_id").distinct()
    if found.isEmpty():
        return docs
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = docs.join(found, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(0).alias("none")])).alias("rest"))
    one = one.select("doc_id", "text", *[F.col("rest").getField(c).alias(c) for c in rest]).select(docs.columns)
    return docs.join(found, "doc_id", "left_anti").unionByName(one)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """The documents without the passages that repeat one of a smaller id; n_chars follows the text.

    White space around a cut becomes one space or, if it held one, a line end.  A document of which nothing
    is left goes; one that has no repeated passage stays as it is.  Of equal rows of one doc_id one stays; of
    several texts of one doc_id all stay and only the least in order is cut.  Rows with a null doc_id or text
    stay as they are.
    """
    docs = _without_repeats(docs)
    spans = repeated_passages(docs).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start_word", "end_word"))).alias("spans_"))
    path = common.fresh_path(docs.sparkSession, "spans")
    texts = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    least = docs.join(texts, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("least_"))
    spans.join(least, "doc_id", "left").write.parquet(path)
    spans = docs.sparkSession.read.parquet(path)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, gone in batches:
            yield pa.array([_without(t.as_py(), s.as_py()) if s.is_valid and t.is_valid else t.as_py() for t, s in zip(texts, gone)], pa.string())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    gone, left = f"spans {path}", f"left {path}"  # names that no column of docs has
    g, t = F.col(f"`{gone}`"), F.col(f"`{left}`")
    other = f"other {path}"
    joined = docs.join(spans.select("doc_id", F.col("spans_").alias(gone), F.col("least_").alias(other)), "doc_id", "left")
    joined = joined.withColumn(gone, F.when(F.coalesce(F.col(f"`{other}`") == F.col("text"), F.col(f"`{other}`").isNull()), g))
    cut = joined.withColumn(left, F.arrow_udf(run, "string")("text", g))
    cut = cut.where(g.isNull() | (t != ""))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(g.isNull(), F.col("n_chars")).otherwise(F.char_length(t)).cast(docs.schema["n_chars"].dataType))
    return cut.withColumn("text", t).select(docs.columns)


def _without(text: str, spans: list[dict]) -> str:
    import re

    words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    gone = np.zeros(len(words) + 1, bool)
    for s in spans:
        gone[s["start_word"] : s["end_word"]] = True
    if not gone.any():
        return text
    out, last = [], None
    for (a, b), g in zip(words, gone):
        if g:
            continue
        if last is not None:
            between = text[last:a]
            out.append(between if not between.strip(" \t\n\r\x0b\x0c") else "\n" if "\n" in between else " ")
        out.append(text[a:b])
        last = b
    return "".join(out)


def op8_substring(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(common.table(spark, sf_dir, "documents"))
