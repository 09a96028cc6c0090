"""URL filters by Bloom filter cascades.

A rule lists a host with all its subdomains and a start of the path, to be blocked or allowed; its key is host and path
put together (``example.net/en/``).  A url can be hit only by the keys that it gives for the *shapes* of the rules, a
shape being a number of host labels and a length of the path: a handful of strings for each url.  Whether such a string
is listed is answered by a cascade: level 0 is a Bloom filter of the listed keys; level 1 holds the other keys of the
corpus that level 0 takes for listed; level 2 the listed ones that level 1 takes, and so on until a level takes none
wrongly.  As the false positives are looked for among all keys that the corpus gives, answers are exact for it, and no
url has to meet the list in a join.  There is one cascade for blocked and one for allowed keys.

Scale: building reads only urls; the keys are made distinct once (combined before the shuffle) and later levels see the
listed keys and level 0's false positives alone.  A cascade's bits come to the driver and are broadcast, in parts of at
most ``PART_BYTES`` planned from the counted keys: a longer list is split by hash into as many parts as it takes, and
each part is one more pass over the urls, written to the shared folder, so no broadcast grows with the list.

Odd rows: a null url, or one without ``://``, has an empty host and path, so no rule fits.  Rules with a null host or
path or another verdict than allow or block count for nothing, repeated rules count once, and a key that is both allowed
and blocked is blocked.  Where two rules fit, the longer key wins; of equally long ones that of the longer host.
Repeated rows stay, an empty table gives an empty one, and columns of the input named like an output give way to it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: A url that no list names passes.
UNLISTED = "allow"

#: Bytes of filters in one broadcast.
PART_BYTES = 32 << 20

#: Bits that travel as one row when a filter is gathered.
PAGE_WORDS = 1024

#: Levels halve what is left; so many are never needed unless two keys have the same two hashes.
MAX_LEVELS = 200

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text: Column) -> Column:
    """A-Z alone."""
    return F.translate(text, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """(verdict, key, labels, size) of the rules that count."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "verdict string, host string, path string")
    rows = rules.where("verdict in ('allow', 'block') and host is not null and path is not null").select("verdict", lower(F.col("host")).alias("host"), "path")
    dots = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit("")))
    rows = rows.select("verdict", F.concat("host", "path").alias("key"), (dots + 1).alias("labels"), F.length("path").alias("size"))
    return rows.groupBy("key", "labels", "size").agg(F.max("verdict").alias("verdict"))  # block comes after allow


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys that can hit, longest first: array of (-length, labels descending, key)."""
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    found = []
    for labels, size in shapes:
        key = F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, size))
        found.append(F.when((dots >= labels - 1) & (F.length(path) >= size), F.struct((-F.length(key)).alias("l"), F.lit(-labels).alias("n"), key.alias("key"))))
    return F.transform(F.sort_array(F.array_compact(F.array(*found))), lambda x: x.key)


# ---- filters ----------------------------------------------------------------------------------------------------


def level_hashes(a: np.ndarray, b: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit hashes of each key for a level, mixed from the key's own two 64-bit ones."""
    with np.errstate(over="ignore"):
        x = a.view(np.uint64) ^ (b.view(np.uint64) * np.uint64(2 * level + 1))
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # the finalizer of splitmix64
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        x ^= x >> np.uint64(31)
    return x >> np.uint64(32), (x & np.uint64(0xFFFFFFFF)) | np.uint64(1)


def places(a: np.ndarray, b: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """A row of bit numbers for each key."""
    first, step = level_hashes(a, b, level)
    return ((first[:, None] + np.arange(hashes, dtype=np.uint64)[None, :] * step[:, None]) % np.uint64(bits)).astype(np.int64)


def shape_of(keys: int, rate: float) -> tuple[int, int]:
    """(bits, hash functions) of a filter for so many keys and such a share of false positives."""
    hashes = max(1, round(-math.log2(rate)))
    return max(64, math.ceil(keys * hashes / math.log(2))), hashes


class Cascade:
    """The levels' bits, and the exact answer for keys of the universe it was built over."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, int, np.ndarray]] = []

    def passed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many levels take each key, up to the first that doesn't."""
        n, alive = np.zeros(len(a), np.int32), np.arange(len(a))
        for level, (bits, hashes, words) in enumerate(self.levels):
            at = places(a[alive], b[alive], level, bits, hashes)
            taken = ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)
            alive = alive[taken]
            n[alive] += 1
            if not len(alive):
                break
        return n

    def listed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A listed key is first refused by a level of false positives, which have odd numbers."""
        return self.passed(a, b) % 2 == 1

    def size(self) -> int:
        return sum(x[2].nbytes for x in self.levels)


def _lanes(batch: pa.RecordBatch, a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(batch.column(a), np.int64), np.asarray(batch.column(b), np.int64)


def _filter_of(keys: DataFrame, level: int, n: int, rate: float) -> tuple[int, int, np.ndarray]:
    """The Bloom filter of n keys (a, b): words are combined by Spark and come to the driver in pages."""
    bits, hashes = shape_of(n, rate)

    def words(batches):
        for batch in batches:
            at = np.unique(places(*_lanes(batch, "a", "b"), level, bits, hashes))
            word, first = np.unique(at >> 6, return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_pydict({"word": pa.array(word, pa.int64()), "value": pa.array(value.view(np.int64), pa.int64())})

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        full = np.zeros(PAGE_WORDS, np.int64)
        full[rows.word.to_numpy() % PAGE_WORDS] = rows.value.to_numpy()
        return pd.DataFrame({"page": [int(rows.word.iloc[0]) // PAGE_WORDS], "bits": [full.tobytes()]})

    found = keys.select("a", "b").mapInArrow(words, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value"))
    pages = found.groupBy(F.floor(F.col("word") / PAGE_WORDS)).applyInPandas(page, "page long, bits binary").collect()  # at most PART_BYTES
    out = np.zeros(-(-bits // (64 * PAGE_WORDS)) * PAGE_WORDS, np.uint64)
    for r in pages:
        out[r.page * PAGE_WORDS : (r.page + 1) * PAGE_WORDS] = np.frombuffer(r.bits, np.uint64)
    return bits, hashes, out


def build(universe: DataFrame, flag: str) -> Cascade:
    """The cascade of the keys (a, b) of the universe whose flag is true, exact for all of them.

    Listed keys number at most what PART_BYTES allows (see judge); the others may be as many as they like.
    """
    spark, cascade = universe.sparkSession, Cascade()
    counts = {r[0]: r[1] for r in universe.groupBy(flag).count().collect()}
    listed, others = counts.get(True, 0), counts.get(False, 0)
    if not listed:
        return cascade
    # As many of the others may pass level 0 as make the levels above cost about as much as the first one.
    rate = min(0.5, max(listed * math.sqrt(0.5) / max(others, 1), 2.0**-40))
    cascade.levels.append(_filter_of(universe.where(flag), 0, listed, rate))
    path = common.fresh_path(spark, "cascade")
    universe.where(F.col(flag) | _passes(cascade)).select("a", "b", flag).write.parquet(path)  # all that the levels above need
    left = spark.read.parquet(path)
    while len(cascade.levels) < MAX_LEVELS:
        level = len(cascade.levels)
        wrong = left.where((F.col(flag) if level % 2 == 0 else ~F.col(flag)) & _passes(cascade))
        n = wrong.count()
        if not n:
            common.drop_path(spark, path)
            return cascade
        cascade.levels.append(_filter_of(wrong, level, n, 0.5))
    raise ValueError("two different keys of the corpus have equal hashes")


def _passes(cascade: Cascade) -> Column:
    """True for keys that all levels take."""
    levels = len(cascade.levels)

    @F.pandas_udf("boolean")
    def all_take(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(cascade.passed(a.to_numpy(np.int64), b.to_numpy(np.int64)) == levels)

    return all_take("a", "b")


def _lanes_of(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


def _first_listed(spark: SparkSession, cascade: Cascade, part: int, parts: int):
    """UDF: the place (from 1) of the first listed key among a row's; null if none."""
    held = spark.sparkContext.broadcast(cascade)

    @F.pandas_udf("int")
    def first(a: pd.Series, b: pd.Series) -> pd.Series:
        sizes = np.array([len(x) for x in a], np.int64)
        at = np.repeat(np.arange(len(a)), sizes)
        flat = [np.concatenate([*x]).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64) for x in (a, b)]
        yes = held.value.listed(*flat) & (_part(flat[0], parts) == part)
        place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        out = np.full(len(a), np.iinfo(np.int32).max)
        np.minimum.at(out, at[yes], place[yes])
        return pd.Series(out).where(pd.Series(out < np.iinfo(np.int32).max)).astype("Int32")

    return first


def _part(a: np.ndarray, parts: int) -> np.ndarray:
    return (a.view(np.uint64) % np.uint64(parts)).astype(np.int64)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, url: str = "url", unlisted: str = UNLISTED, part_bytes: int = PART_BYTES) -> DataFrame:
    """pages with host, path, rule (the key that decides, or null) and verdict."""
    spark, plain = pages.sparkSession, common.without(pages, "host", "path", "rule", "verdict")
    listed = rule_table(spark, rules)
    # One shape for each number of labels and each length of a path that rules have: bounded by the longest url.
    shapes = sorted((r.labels, r.size) for r in listed.select("labels", "size").distinct().collect())
    host, path = host_and_path(F.col(url))
    if not shapes:
        return plain.select("*", host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(unlisted).alias("verdict"))
    given = candidates(host, path, shapes)
    seen = pages.select(F.explode(given).alias("key")).select("key", F.lit(0).alias("code"))
    coded = listed.select("key", F.when(F.col("verdict") == "block", 2).otherwise(1).alias("code"))
    keys = seen.unionByName(coded).groupBy("key").agg(F.max("code").alias("code"))  # numbers, so that Spark hashes instead of sorting
    a, b = _lanes_of(F.col("key"))
    at = common.fresh_path(spark, "urlkeys")
    keys.select(a.alias("a"), b.alias("b"), (F.col("code") == 2).alias("block"), (F.col("code") == 1).alias("allow")).write.parquet(at)
    universe = spark.read.parquet(at)
    counts = universe.agg(F.count("*"), F.count_if("block"), F.count_if("allow")).first()
    # Bits for a listed key: log2(others / listed) / ln 2 in level 0, about 6 in the levels above.
    most = max(counts[1:])
    parts = max(1, math.ceil(2 * most * (math.log2(max(2, counts[0] / max(most, 1))) / math.log(2) + 6) / 8 / part_bytes))
    lanes = lambda k: F.transform("keys_", lambda x: _lanes_of(x)[k])
    now = plain.select("*", host.alias("host"), path.alias("path"), given.alias("keys_"), F.lit(None).cast("int").alias("block_"), F.lit(None).cast("int").alias("allow_"))
    for part in range(parts):
        mine = universe.where(_in_part(part, parts)("a")) if parts > 1 else universe
        for kind in ("block", "allow"):
            first = _first_listed(spark, build(mine, kind), part, parts)
            now = now.withColumn(f"{kind}_", F.least(f"{kind}_", first(lanes(0), lanes(1))))
        if part + 1 < parts:  # one part's filters are in memory at a time
            at = common.fresh_path(spark, "urlpass")
            now.write.parquet(at)
            now = spark.read.parquet(at)
    blocked = F.coalesce(F.col("block_") <= F.coalesce("allow_", "block_"), F.lit(False))
    rule = F.get("keys_", F.least("block_", "allow_") - 1)
    verdict = F.when(rule.isNull(), F.lit(unlisted)).when(blocked, "block").otherwise("allow")
    return now.select(*plain.columns, "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def _in_part(part: int, parts: int):
    @F.pandas_udf("boolean")
    def mine(a: pd.Series) -> pd.Series:
        return pd.Series(_part(a.to_numpy(np.int64), parts) == part)

    return mine


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


ORACLE = f"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r),
l(verdict, h, p) AS (VALUES {", ".join(str(x) for x in RULES)}),
f AS (SELECT page_id, host, path, h || p AS rule, verdict, row_number() OVER (PARTITION BY u.id ORDER BY length(h || p) DESC, length(h) DESC) AS n
    FROM (SELECT *, row_number() OVER () AS id FROM u) u LEFT JOIN l ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, '{UNLISTED}') AS verdict FROM f WHERE n = 1
"""
