"""Versions of slowly changing vessel tables, and rows joined with the version in force at their time.

A vessel's rows are dealt by time blocks as well as by vessel, so a busy one is many groups.  What a block inherits
is its vessel's last value of the blocks before, found over one row per vessel and block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds of one time block.
BLOCK_S = 5 * 86400.0
#: What tells one ship from another: dimensions fore, aft, port and starboard of the antenna, and the IMO number.
IDENTITY = ["dim_a", "dim_b", "dim_c", "dim_d", "imo"]


def _block(t: str, block_s: float) -> Column:
    return F.coalesce(F.floor(F.col(t) / block_s), F.lit(-(2**62))).cast("long")


def _inherited(rows: DataFrame, key: str, value: str, order: Column) -> DataFrame:
    """(key, block_, inherited_, first_): for each block the last value that is not null of the blocks before, and whether it is the first."""
    ends = rows.groupBy(key, "block_").agg(F.max_by(value, F.when(F.col(value).isNotNull(), order)).alias("end_"))
    w = Window.partitionBy(key).orderBy("block_")
    before = F.last("end_", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return ends.select(key, "block_", before.alias("inherited_"), (F.row_number().over(w) == 1).alias("first_"))


def version_id(key: str, t: str, tie: str) -> Column:
    """Surrogate id of a version: the same whenever it is computed, as it hashes the vessel, the time it holds from and its place."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.round(F.col(t) * 1_000_000).cast("long").cast("string"), F.col(tie).cast("string")))


def versions(reports: DataFrame, state: list[str], key: str = "mmsi", t: str = "t_s", tie: str = "seq", present: Column | None = None, block_s: float = BLOCK_S) -> DataFrame:
    """The reports whose state differs from the last one before, with version_id.

    Nulls are states of their own.  Reports that are not ``present`` say nothing and change nothing, but a vessel's very
    first report always makes a version: with nulls for its state, if it says nothing.  Reports without a vessel
    or a time go; of equal times the smaller tie comes first, rows equal in both are one.
    """
    said = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    rows = reports.where(F.col(key).isNotNull() & F.col(t).isNotNull()).dropDuplicates([key, t, tie, *state])
    rows = rows.withColumn("block_", _block(t, block_s)).withColumn("now_", F.when(said, F.struct(*state)))
    inherited = _inherited(rows, key, "now_", F.struct(t, tie))
    w = Window.partitionBy(key, "block_").orderBy(t, tie, *state)
    rows = rows.withColumn("was_", F.last("now_", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("n_", F.row_number().over(w))
    rows = rows.join(inherited, [key, "block_"])
    first = F.col("first_") & (F.col("n_") == 1)
    was = F.coalesce("was_", "inherited_", F.struct(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in state]))
    kept = rows.where(first | (F.col("now_").isNotNull() & ~F.col("now_").eqNullSafe(was)))
    shown = [F.when(F.col("now_").isNotNull(), F.col(c)).alias(c) if c in state else F.col(c) for c in reports.columns]
    return kept.select(*shown).withColumn("version_id", version_id(key, t, tie))


def as_of(rows: DataFrame, versions_: DataFrame, take: dict[str, str], key: str = "mmsi", t: str = "t_s", since: str = "t_s", tie: str = "seq", block_s: float = BLOCK_S) -> DataFrame:
    """Every row with the columns ``take`` (name in versions_: new name) of the last version not later than its time.

    Columns are null where there is none, and for rows without a vessel or a time.  Of versions of one time the one of
    the larger tie counts.
    """
    found = F.struct(*[F.col(c).alias(n) for c, n in take.items()])
    left = rows.select(key, F.col(t).cast("double").alias("at_"), F.lit(1).alias("kind_"), F.lit(None).cast("long").alias("tie_"), F.struct(*[F.col(c) for c in rows.columns]).alias("row_"))
    right = versions_.where(F.col(key).isNotNull() & F.col(since).isNotNull())
    right = right.select(key, F.col(since).cast("double").alias("at_"), F.lit(0).alias("kind_"), F.col(tie).cast("long").alias("tie_"), found.alias("found_"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("block_", _block("at_", block_s))
    w = Window.partitionBy(key, "block_").orderBy("at_", "kind_", "tie_").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("found_", F.last("found_", ignorenulls=True).over(w)).where("row_ is not null")
    got = met.join(_inherited(both, key, "found_", F.struct("at_", "tie_")).drop("first_"), [key, "block_"], "left")
    return got.withColumn("got_", F.coalesce("found_", "inherited_")).select("row_.*", "got_.*")


def dated(reports: DataFrame, pings: DataFrame, key: str = "mmsi", t: str = "t_s") -> DataFrame:
    """Reports without a time of their own take the time of their vessel's first position."""
    firsts = pings.groupBy(key).agg(F.min(t).alias("first_ping_"))
    return reports.join(firsts, key, "left").withColumn(t, F.coalesce(t, "first_ping_")).drop("first_ping_")


def destination(text: Column) -> Column:
    """A destination as it is kept: trimmed, its first 20 characters."""
    return F.substring(F.trim(text), 1, 20)


def statics(reports: DataFrame, present: Column | None = None) -> DataFrame:
    """Versions of identity; a vessel that has not told its own has one version of nulls."""
    return versions(reports, IDENTITY, present=present)


def states(reports: DataFrame, statics_: DataFrame, present: Column | None = None) -> DataFrame:
    """Versions of a voyage: draught, ship type, destination (as kept) and the identity of that time; a new identity alone makes one."""
    at = as_of(reports.withColumn("destination", destination(F.col("destination"))), statics_, {"version_id": "static_id"})
    return versions(at, ["draught_m", "ship_code", "destination", "static_id"], present=present).withColumnRenamed("version_id", "state_id")


def with_ship(segments: DataFrame, states_: DataFrame, statics_: DataFrame) -> DataFrame:
    """Segments with the voyage of the time they start at and the identity that it refers to; segments of no known voyage go.

    The identity is looked up by its id, which a version has once.
    """
    voyage = as_of(segments, states_, {"state_id": "state_id", "static_id": "static_id", "draught_m": "draught_m", "ship_code": "ship_code", "destination": "destination"}, t="t1")
    return voyage.where("state_id is not null").join(statics_.select(F.col("version_id").alias("static_id"), *IDENTITY), "static_id")
