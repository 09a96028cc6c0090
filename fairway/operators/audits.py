"""Audits of projects against defaults, and the registry of junctions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import network
from .collision import scope

#: Default causation factors, drift settings and repair distribution (fixed values).
CAUSATION_DEFAULTS = {"headon": 4.9e-5, "overtaking": 1.1e-4, "crossing": 1.3e-4, "bend": 1.3e-4, "grounding": 1.6e-4, "allision": 1.9e-4}
DRIFT_DEFAULTS = {"speed": 1.0, "anchor_p": 0.7, "anchor_d": 7.0, "drift_p": 1.0}
REPAIR_DEFAULTS = {"std": 0.95, "loc": 0.2, "scale": 0.85}
#: Ship types whose default blackout rate is not 1, and that rate (fixed values).
RARE_BLACKOUTS, RARE_RATE = (8, 9, 10, 11), 0.1
UNIFORM = 0.125


def _close(a, b, rel: float = 1e-3, absolute: float = 1e-9):
    return F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def against_defaults(settings: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """(scenario_id, name, value, default, delta_pct) of settings (scenario_id, name, value) that are not the default.

    delta_pct is null where the default is 0.
    """
    base = F.col("default")
    known = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    rows = settings.withColumn("default", F.element_at(known, F.col("name"))).where(base.isNotNull() & F.col("value").isNotNull() & ~_close(F.col("value"), base))
    return rows.select("scenario_id", "name", "value", "default", F.when(base != 0, (F.col("value") - base) / F.nullif(base, F.lit(0.0)) * 100).alias("delta_pct"))


def rose_skew(rose: DataFrame) -> DataFrame:
    """Of scenarios whose wind rose (scenario_id, direction, value) is not uniform, the two strongest directions."""
    skewed = rose.groupBy("scenario_id").agg(F.max(~_close(F.col("value"), F.lit(UNIFORM))).alias("skewed")).where("skewed").select("scenario_id")
    order = Window.partitionBy("scenario_id").orderBy(F.desc("value"), "direction")
    return rose.join(skewed, "scenario_id").withColumn("place", F.row_number().over(order)).where("place <= 2").select("scenario_id", "place", "direction", "value")


def changed_blackouts(rates: DataFrame) -> DataFrame:
    """How many ship types of each scenario (scenario_id, ship_type, rate) have another blackout rate than the default."""
    default = F.when(F.col("ship_type").isin(*RARE_BLACKOUTS), RARE_RATE).otherwise(1.0)
    return rates.groupBy("scenario_id").agg(F.count_if(~_close(F.col("rate"), default)).alias("changed"))


def completeness(legs: DataFrame, obstacles: DataFrame, cells: DataFrame, junctions: DataFrame) -> DataFrame:
    """Per scenario of legs: numbers of legs, of those with traffic, of depth and object obstacles, and of junctions by source."""
    base = legs.groupBy("scenario_id").agg(F.count_distinct("leg_id").alias("legs"))
    busy = cells.where("freq > 0").select("scenario_id", "leg_id").distinct().join(legs.select("scenario_id", "leg_id").distinct(), ["scenario_id", "leg_id"]).groupBy("scenario_id").agg(F.count("*").alias("legs_with_traffic"))
    found = obstacles.groupBy("scenario_id").agg(F.count_distinct(F.when(F.col("kind") == "depth", F.col("obstacle_id"))).alias("depths"), F.count_distinct(F.when(F.col("kind") == "object", F.col("obstacle_id"))).alias("objects"))
    source = junctions.groupBy("scenario_id").agg(*[F.count_distinct(F.when(F.col("source") == s, F.col("junction_id"))).alias(f"junctions_{s}") for s in ("user", "ais", "geometry")])
    out = base
    for t in (busy, found, source):
        out = out.join(t, "scenario_id", "left")
    return out.na.fill(0)


def consequence_inputs(matrix: DataFrame, levels: DataFrame, oil: DataFrame, default_levels: dict[str, float]) -> DataFrame:
    """Per scenario: cells of the spill matrix and of oil on board, number of catastrophe levels, and whether those are the default."""
    order = Window.partitionBy("scenario_id").orderBy("quantity_m3", "name")
    known = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(q).alias("quantity_m3")) for n, q in sorted(default_levels.items(), key=lambda x: x[1])])
    ranked = levels.withColumn("place", F.row_number().over(order)).withColumn("d", F.get(known, F.col("place") - 1))
    same = F.coalesce((F.col("d.name") == F.col("name")) & _close(F.col("quantity_m3"), F.col("d.quantity_m3")), F.lit(False))
    per_level = ranked.groupBy("scenario_id").agg(F.count("*").alias("levels"), ((F.count("*") == len(default_levels)) & F.min(same)).alias("default_levels"))
    per_cell = lambda df, name: df.groupBy("scenario_id").agg(F.count("*").alias(name))
    out = per_level.join(per_cell(matrix, "spill_cells"), "scenario_id", "full_outer").join(per_cell(oil, "oil_cells"), "scenario_id", "full_outer")
    return out.na.fill(0, ["levels", "spill_cells", "oil_cells"]).na.fill(False, ["default_levels"])


def route_findings(legs: DataFrame) -> DataFrame:
    """(check, a, b, value): waypoints that are nearly one (their distance) and legs that cross (the place along the first)."""
    near = network.close_waypoints(legs).select(F.lit("close_waypoints").alias("check"), "a", "b", F.col("distance_m").alias("value"))
    cross = network.intersections(legs).select(F.lit("crossing_legs").alias("check"), F.col("leg_a").cast("string").alias("a"), F.col("leg_b").cast("string").alias("b"), F.col("t").alias("value"))
    return near.unionByName(cross)


def user_rows(rows: DataFrame) -> DataFrame:
    """A user's share rows (junction_id, in_leg, out_leg, share as text or number): what is no number goes, negatives are 0, rows sum to 1."""
    key = [*scope(rows), "junction_id", "in_leg"]
    own = rows.withColumn("share", F.col("share").try_cast("double")).where(F.col("share").isNotNull()).withColumn("share", F.greatest("share", F.lit(0.0)))
    total = F.sum("share").over(Window.partitionBy(*key))
    return own.select(*key, "out_leg", F.when(total > 0, F.col("share") / total).otherwise(F.col("share")).alias("share"))


def upserted(shares: DataFrame, user: DataFrame) -> DataFrame:
    """Shares (junction_id, in_leg, out_leg, share, source) with the user's rows in place of rows of their in_leg; unknown junctions go."""
    key = [*scope(shares, user), "junction_id"]
    own = user_rows(user).join(shares.select(*key).distinct(), key, "left_semi").withColumn("source", F.lit("user"))
    return shares.join(own.select(*key, "in_leg").distinct(), [*key, "in_leg"], "left_anti").unionByName(own.select(shares.columns))


def refreshed(shares: DataFrame, ends: DataFrame) -> DataFrame:
    """The registry after legs have changed: users' matrices stay where all of their legs still meet at the junction;
    all else comes from geometry.

    shares: junction_id, in_leg, out_leg, share, source; ends: network.junctions of the legs as they are now.
    """
    user = shares.where("source = 'user'")
    legs_of = ends.select("junction_id", F.col("leg_id").alias("leg")).distinct()
    named = user.select("junction_id", F.explode(F.array("in_leg", "out_leg")).alias("leg")).distinct()
    broken = named.join(legs_of, ["junction_id", "leg"], "left_anti").select("junction_id").distinct()
    kept = user.join(broken, "junction_id", "left_anti").select("junction_id", "in_leg", "out_leg", "share", "source")
    fresh = network.geometric_shares(ends).join(kept.select("junction_id").distinct(), "junction_id", "left_anti")
    return kept.unionByName(fresh.select("junction_id", "in_leg", "out_leg", "share", F.lit("geometry").alias("source")))
