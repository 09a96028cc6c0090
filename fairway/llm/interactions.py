"""How text filters act together: what each removes in every order of applying them.

Each document gets a mask with a bit for each filter that it fails, and documents are counted by part and mask: at most
32 cells a part, combined before the shuffle.  A part's cells are then walked in Gray-code order, so that one filter is
switched on or off at a time: every cell keeps the number of active filters that it fails, and the running survivors
change by the cells whose number leaves or reaches zero.  The 32 survivor counts are stored; a step of an order is the
difference of two of them.

Scale: texts are read once and not shuffled; 60 bytes a document are.  A text identical to that of a smaller doc_id is
found by its SHA-256: the least doc_id of each digest (combined before the shuffle) is joined back on digest and doc_id
together, so a group of any number of copies is never one task's.

Odd rows: a null text is empty and a null part is the empty string.  Rows with a null doc_id are no one's copies, have
no smaller doc_id and no label.  Rows that repeat a doc_id count each; with equal texts neither is the other's copy.
A document is good or toxic if any of its label rows says so.  An empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The filters' letters; the place of a letter is its bit.
LETTERS = "ABCDE"

MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SIGNS = 200, 50, 3, "[#$%&*|]"


def words(text: Column) -> Column:
    """Maximal runs of characters other than space and U+0009 to U+000D."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")


def text_failures(text: Column) -> list[Column]:
    """Filters that one text decides, in the order of LETTERS."""
    w = words(text)
    return [
        F.size(w) < MIN_WORDS,
        100 * F.size(F.array_distinct(w)) < DISTINCT_PERCENT * F.size(w),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > UPPER_PERCENT * F.length(text),
        text.rlike(SIGNS),
    ]


def masks(docs: DataFrame, part: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, part, mask): bit i of the mask is set if the document fails filter i."""
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_failures(text))]
    path = common.fresh_path(spark, "masks")
    docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), sum(bits[1:], bits[0]).alias("bits"), F.unhex(F.sha2(text, 256)).alias("digest")).write.parquet(path)
    rows = spark.read.parquet(path)
    firsts = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(firsts, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("bits") + F.when(copy, 1 << 4).otherwise(0)).alias("mask"))


def survivors(cells: np.ndarray, filters: int) -> np.ndarray:
    """What passes each set of active filters: a row for each set (as bits) of the sums of the cells that fail none.

    cells has a row of counts for each mask.  The walk visits every set once, changing one filter at a time.
    """
    fails = (np.arange(len(cells))[:, None] >> np.arange(filters)[None, :]) & 1
    active_failures, running = np.zeros(len(cells), np.int64), cells.sum(axis=0)
    states, now = np.zeros((1 << filters, cells.shape[1]), np.int64), 0
    states[0] = running
    for step in range(1, 1 << filters):
        toggled = (step & -step).bit_length() - 1
        mine = fails[:, toggled] == 1
        now ^= 1 << toggled
        if now >> toggled & 1:
            running = running - cells[mine & (active_failures == 0)].sum(axis=0)
            active_failures[mine] += 1
        else:
            active_failures[mine] -= 1
            running = running + cells[mine & (active_failures == 0)].sum(axis=0)
        states[now] = running
    return states


def steps(states: np.ndarray, letters: str = LETTERS) -> pd.DataFrame:
    """Every order's steps, as differences of stored states (columns of states: all, good, toxic)."""
    n = len(letters)
    everything, total = (1 << n) - 1, states[0]
    alone = [states[everything ^ (1 << i)][0] - states[everything][0] for i in range(n)]
    failing = [total[0] - states[1 << i][0] for i in range(n)]
    rows, shapley = [], [0] * n
    for order in permutations(range(n)):
        done = 0
        for step, i in enumerate(order):
            after = done | 1 << i
            removed, good, toxic = states[done] - states[after]
            shapley[i] += removed
            rows.append(("".join(letters[k] for k in order), step + 1, i, states[after][0], removed, failing[i] - removed, alone[i], good, toxic))
            done = after
    out = pd.DataFrame(rows, columns=["filter_order", "step", "i", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"])
    return out.assign(shapley=out.i.map(dict(enumerate(shapley)))).drop(columns="i")


STEP_COLUMNS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """A row for each part, order of the filters and step."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = masks(docs, **columns).join(known, "doc_id", "left")
    cells = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((1 << len(LETTERS), 3), np.int64)
        counts[part["mask"].to_numpy()] = part[["n", "good", "toxic"]].to_numpy(np.int64)
        return steps(survivors(counts, len(LETTERS))).assign(part=part["part"].iloc[0])

    return cells.groupBy("part").applyInPandas(walk, STEP_COLUMNS)


def op13_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS fails
    FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x(i) AS (SELECT unnest([1, 2, 3, 4, 5])),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, x.i AS step, o[x.i] AS i, o[1:x.i - 1] AS before FROM o, x),
p AS (SELECT DISTINCT part FROM c),
g AS (SELECT p.part, s.o, s.step, s.i,
    sum(n) FILTER (NOT list_bool_or(list_transform(list_append(before, s.i), lambda k: fails[k]))) AS kept,
    sum(n) FILTER (fails[s.i] AND NOT coalesce(list_bool_or(list_transform(before, lambda k: fails[k])), false)) AS removed,
    sum(n) FILTER (fails[s.i] AND list_bool_or(list_transform(before, lambda k: fails[k]))) AS redundant,
    sum(n) FILTER (fails[s.i] AND len(list_filter(fails, lambda k: k)) = 1) AS unique_fails,
    sum(good) FILTER (fails[s.i] AND NOT coalesce(list_bool_or(list_transform(before, lambda k: fails[k])), false)) AS good_lost,
    sum(toxic) FILTER (fails[s.i] AND NOT coalesce(list_bool_or(list_transform(before, lambda k: fails[k])), false)) AS toxic_lost
    FROM p JOIN c ON p.part = c.part CROSS JOIN s GROUP BY ALL)
SELECT part, list_aggregate(list_transform(o, lambda k: substr('ABCDE', k, 1)), 'string_agg', '') AS filter_order, CAST(step AS INTEGER) AS step,
    CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
    CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
    CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, i) AS BIGINT) AS shapley FROM g
"""
