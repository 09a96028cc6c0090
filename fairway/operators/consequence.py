"""Oil spill consequences of accident frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collision import scope

#: Kinds of accidents, shares by spill level after drifting and after other accidents, the share of oil lost at
#: each level, all in percent, and catastrophe levels in cubic metres (fixed values).
KINDS = ("drifting_allision", "drifting_grounding", "powered_allision", "powered_grounding", "overtaking", "head_on", "crossing", "merging")
DRIFTING_PERCENT, OTHER_PERCENT = (98.0, 2.0, 0.0, 0.0), (97.0, 1.0, 1.0, 1.0)
LOST_PERCENT = (0.0, 10.0, 30.0, 100.0)
CATASTROPHES = {"Minor": 50.0, "Major": 500.0, "Catastrophic": 5000.0}
TANKER_M3, OTHER_M3, OPEN_M = 80.0, 100.0, 50.0
#: Which of the models' own kinds are told as another one.
TOLD_AS = {"headon": "head_on", "bend": "merging"}


def default_matrix(spark: SparkSession) -> DataFrame:
    """(kind, level, percent, lost_percent) of all kinds and levels."""
    rows = [(k, i, p, LOST_PERCENT[i]) for k in KINDS for i, p in enumerate(DRIFTING_PERCENT if k.startswith("drifting") else OTHER_PERCENT)]
    return spark.createDataFrame(rows, "kind string, level int, percent double, lost_percent double")


def routed(collisions: DataFrame | None = None, powered: DataFrame | None = None, drifting: DataFrame | None = None) -> DataFrame:
    """(kind, ship_type, size_bin, frequency) of the models' cells, by the eight kinds of accidents.

    collisions: kind, ship_type, size_bin, frequency; powered and drifting: accident (grounding, allision) in place
    of kind.  Bends count as merging; anchoring is no accident.
    """
    parts = []
    if collisions is not None:
        kind = F.col("kind")
        for own, told in TOLD_AS.items():
            kind = F.when(F.col("kind") == own, F.lit(told)).otherwise(kind)
        parts.append(collisions.withColumn("kind", kind))
    for name, table in (("powered", powered), ("drifting", drifting)):
        if table is not None:
            parts.append(table.where("accident <> 'anchoring'").withColumn("kind", F.concat(F.lit(f"{name}_"), "accident")))
    key = ["kind", *scope(*parts), "ship_type", "size_bin"]
    out = parts[0].select(*key, "frequency")
    for p in parts[1:]:
        out = out.unionByName(p.select(*key, "frequency"))
    return out.groupBy(*key).agg(F.sum("frequency").alias("frequency"))


def interval_length(low, high):
    """The length that stands for a size interval: its middle, or a fixed step above if it is open."""
    top = high.try_cast("double")
    return F.when(top.isNull() | F.isnan(top) | (top == float("inf")), low + OPEN_M).otherwise((low + top) / 2)


def default_oil(cells: DataFrame, is_tanker, length_m=None) -> DataFrame:
    """Oil on board: by mean length for tankers, one amount for others."""
    length = F.col("size_bin") * 25 + 12.5 if length_m is None else length_m
    return cells.withColumn("oil_m3", F.when(is_tanker, TANKER_M3 * length).otherwise(OTHER_M3))


def reshaped_oil(defaults: DataFrame, user: DataFrame) -> DataFrame:
    """The default grid with the user's numbers (ship_type, size_bin, oil as text) where they are numbers."""
    own = user.select(*scope(defaults, user), "ship_type", "size_bin", F.col("oil").try_cast("double").alias("own_m3"))
    rows = defaults.join(own, [*scope(defaults, user), "ship_type", "size_bin"], "left")
    return rows.withColumn("oil_m3", F.coalesce("own_m3", "oil_m3")).drop("own_m3")


def spills(accidents: DataFrame, oil: DataFrame, matrix: DataFrame) -> DataFrame:
    """(kind, ship_type, size_bin, level, frequency, volume_m3) of accidents (kind, ship_type, size_bin, frequency).

    Kinds that the matrix does not have have no row here, but one in unknown_kinds.
    """
    rows = accidents.where("frequency > 0").join(oil, [*scope(accidents, oil), "ship_type", "size_bin"], "left")
    rows = rows.withColumn("oil_m3", F.coalesce("oil_m3", F.lit(0.0))).join(matrix.where("percent > 0"), [*scope(accidents, matrix), "kind"])
    frequency, volume = F.col("frequency") * F.col("percent") / 100, F.col("oil_m3") * F.coalesce("lost_percent", F.lit(0.0)) / 100
    return rows.select("kind", *scope(accidents), "ship_type", "size_bin", "level", frequency.alias("frequency"), volume.alias("volume_m3"))


def unknown_kinds(accidents: DataFrame, matrix: DataFrame) -> DataFrame:
    """(kind, frequency) of accidents that the spill matrix has no row for."""
    lost = accidents.join(matrix.select(*scope(accidents, matrix), "kind").distinct(), [*scope(accidents, matrix), "kind"], "left_anti")
    return lost.groupBy("kind", *scope(accidents)).agg(F.sum("frequency").alias("frequency"))


def exceedance(spilled: DataFrame, levels: dict[str, float] = CATASTROPHES) -> DataFrame:
    """Yearly frequency of spills over each level (level, name, quantity_m3), in order; levels that none exceeds have 0."""
    order = sorted(levels.items(), key=lambda x: x[1])
    over = [F.coalesce(F.sum(F.when(F.col("volume_m3") > q, F.col("frequency"))), F.lit(0.0)).alias(f"f{i}") for i, (_, q) in enumerate(order)]
    sums = spilled.groupBy(*scope(spilled)).agg(*over)
    rows = [F.struct(F.lit(i).alias("level"), F.lit(n).alias("name"), F.lit(q).alias("quantity_m3"), F.col(f"f{i}").alias("frequency")) for i, (n, q) in enumerate(order)]
    return sums.select(*scope(spilled), F.inline(F.array(*rows)))


def totals(spilled: DataFrame) -> DataFrame:
    """Per kind: yearly frequency of any spill and mean volume a year."""
    any_spill = F.sum(F.when(F.col("volume_m3") > 0, F.col("frequency")).otherwise(0.0)).alias("spill_frequency")
    return spilled.groupBy("kind", *scope(spilled)).agg(any_spill, F.sum(F.col("frequency") * F.col("volume_m3")).alias("volume_m3_per_year"))


def findings(matrix: DataFrame, levels: DataFrame | None = None, oil: DataFrame | None = None) -> DataFrame:
    """(check, kind, level) of faults in a spill matrix (kind, level, percent, lost_percent), catastrophe levels
    (name, quantity_m3) and oil on board (ship_type, size_bin, oil_m3).

    Sums off 100 by more than 0.05, shares and lost parts out of 0 to 100, repeated rows; fewer than two levels,
    quantities not above 0, repeated names; negative or missing oil (kind is its ship type, level its size).
    """
    row = lambda df, check, kind=F.lit(None), level=F.lit(None): df.select(F.lit(check).alias("check"), kind.cast("string").alias("kind"), level.cast("int").alias("level"))
    kind, level = F.col("kind"), F.col("level")
    found = row(matrix.groupBy("kind").agg(F.sum("percent").alias("s")).where(F.abs(F.col("s") - 100) > 0.05), "row_sum", kind)
    found = found.unionByName(row(matrix.where(~F.coalesce(F.col("percent").between(0, 100), F.lit(False))), "range", kind, level))
    found = found.unionByName(row(matrix.groupBy("kind", "level").count().where("count > 1"), "duplicate", kind, level))
    if "lost_percent" in matrix.columns:
        found = found.unionByName(row(matrix.where(~F.coalesce(F.col("lost_percent").between(0, 100), F.lit(False))), "lost_range", kind, level))
    if levels is not None:
        found = found.unionByName(row(levels.agg(F.count("*").alias("n")).where("n < 2"), "few_levels"))
        found = found.unionByName(row(levels.where("quantity_m3 is null or quantity_m3 <= 0"), "quantity", F.col("name")))
        found = found.unionByName(row(levels.groupBy("name").count().where("count > 1"), "repeated_name", F.col("name")))
    if oil is not None:
        found = found.unionByName(row(oil.where("oil_m3 is null or oil_m3 < 0"), "oil", F.col("ship_type"), F.col("size_bin")))
    return found
