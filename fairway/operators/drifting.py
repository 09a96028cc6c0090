"""Blackouts, drifting and the chance not to be repaired in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairway.functions import expr as X

HOURS = 8760.0
#: Default repair-time distribution in hours, and default speed of a drifting ship in knots (fixed values).
REPAIR = {"kind": "lognormal", "shape": 0.95, "loc": 0.2, "scale": 0.85}
DRIFT_KN = 1.0
#: Block coefficient where the type has none.
BLOCK = 0.75
#: Block coefficients by place of the ship type (fixed values); other types have BLOCK.
BLOCKS = [0.70, 0.50, 0.65, 0.55, 0.65, 0.60, 0.65, 0.65, 0.70, 0.65, 0.65, 0.70, 0.65, 0.67, 0.72, 0.72, 0.72, 0.80, 0.80, 0.82, 0.67]


def blackout_exposure(cells: DataFrame, legs: DataFrame, rates: DataFrame, default_rate: float = 1.0) -> DataFrame:
    """Expected blackouts a year of each cell: hours on the leg, times frequency, times rate per year."""
    base = F.col("length_m") / (F.col("speed_kn") * 1852.0) * F.col("freq") * F.coalesce("rate", F.lit(default_rate)) / HOURS
    leg = [k for k in ("scenario_id", "leg_id") if k in cells.columns and k in legs.columns]
    return cells.where("speed_kn > 0").join(legs.select(*leg, "length_m"), leg).join(rates, "ship_type", "left").withColumn("base", base).drop("rate")


def normalized_rose(rose: DataFrame) -> DataFrame:
    """Shares of the wind directions; those without any go."""
    return rose.where("value > 0").withColumn("rp", F.col("value") / F.sum("value").over(Window.partitionBy("scenario_id")))


def reach_m(longest_m: float, kind: str = REPAIR["kind"], shape: float = REPAIR["shape"], loc: float = REPAIR["loc"], scale: float = REPAIR["scale"], drift_kn: float = DRIFT_KN) -> float:
    """How far to look: ten longest legs, or where 99 of 100 ships are repaired if that is nearer."""
    import math

    hours = {"lognormal": lambda: loc + scale * math.exp(shape * 2.3263478740408408), "weibull": lambda: loc + scale * math.log(100.0) ** (1 / shape)}.get(kind, lambda: math.inf)()
    return min(10.0 * longest_m, drift_kn * X.KNOT_MS * 3600.0 * hours) if drift_kn > 0 else 10.0 * longest_m


def projection_m(kind: str = REPAIR["kind"], shape: float = REPAIR["shape"], loc: float = REPAIR["loc"], scale: float = REPAIR["scale"], drift_ms: float = DRIFT_KN * X.KNOT_MS, most_m: float = 50_000.0) -> float:
    """How far corridors reach: to where one ship in a thousand is still adrift.

    10 km, if that is less than most_m, for other kinds than the lognormal, for no spread, and beyond 48 hours; speeds
    of 0 and less or above 10 m/s count as 1.
    """
    import math

    speed = drift_ms if 0 < drift_ms <= 10 else 1.0
    if kind != "lognormal" or shape <= 0 or scale <= 0:
        return min(10_000.0, most_m)
    hours = loc + scale * math.exp(shape * 3.090232306167813)
    return min(hours * 3600 * speed, most_m) if 0 <= hours <= 48 else min(10_000.0, most_m)


def not_repaired(df: DataFrame, distance: str, out: str = "p_not_repaired", drift_kn: float = DRIFT_KN, **repair) -> DataFrame:
    """Adds the chance that a ship is still adrift after the distance."""
    r = REPAIR | repair
    tau = f"({distance}) / {X.num(drift_kn * X.KNOT_MS * 3600.0)}"
    return df.withColumn(out, F.expr(X.not_repaired(r["kind"], tau, r["shape"], r["loc"], r["scale"])))


def edge_intervals(facing: DataFrame, slices: int, spread: float = 5.0) -> DataFrame:
    """Lateral intervals from which a ship that drifts meets each edge, per slice of the leg (lo, hi), cut to +-spread deviations.

    facing: cascade.facing_edges.  Where the drift runs straight across the leg, all places of a slice are on one
    line, and those from which an edge on it lies ahead count.
    """
    at = facing.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("f", (F.col("slice") + 0.5) / slices)
    for p in "ab":
        at = at.withColumn(f"u{p}", F.expr(f"x{p} - f * x1")).withColumn(f"y{p}", F.expr(f"c{p} - f * c1"))
    at = at.where((F.greatest("ua", "ub") > 0) & (F.least("ua", "ub") < F.col("reach_m")) & (F.col("ya") != F.col("yb")))
    across = F.abs("spread") < 1e-6
    met = at.where(~across | F.expr("least(ya, yb) <= 0e0 and greatest(ya, yb) > 0e0"))
    wa, wb = (F.col(y) / F.when(~across, F.col("spread")) for y in ("ya", "yb"))
    stop = F.expr("(ua - ya / (yb - ya) * (ub - ua))") / F.when(across, F.col("along"))
    low, high = F.col("mean_m") - spread * F.col("std_m"), F.col("mean_m") + spread * F.col("std_m")
    lo = F.when(across, F.when(F.col("along") > 0, low).otherwise(stop)).otherwise(F.least(wa, wb))
    hi = F.when(across, F.when(F.col("along") > 0, stop).otherwise(high)).otherwise(F.greatest(wa, wb))
    met = met.withColumn("lo", F.greatest(lo, low)).withColumn("hi", F.least(hi, high)).where("lo < hi")
    return met.select(*_KEY, "slice", "mean_m", "std_m", "lo", "hi")


_KEY = ["scenario_id", "leg_id", "dir_idx", "direction", "obstacle_id"]


def holes(intervals: DataFrame, slices: int) -> DataFrame:
    """Chance per leg, directions and obstacle: the normal's mass on the union of intervals, averaged over slices.

    Intervals of a slice are merged by a running maximum of their ends.
    """
    order = Window.partitionBy(*_KEY, "slice").orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = intervals.withColumn("new_", F.when(before >= F.col("lo"), 0).otherwise(1))
    islands = islands.withColumn("island", F.sum("new_").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy(*_KEY, "slice", "island", "mean_m", "std_m").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    mass = F.expr(f"{X.phi('(hi - mean_m) / std_m')} - {X.phi('(lo - mean_m) / std_m')}")
    return merged.groupBy(*_KEY).agg((F.sum(mass) / slices).alias("hole"))


def block_coefficient(ship_type):
    """The coefficient of a ship type's place; BLOCK for null and all others."""
    return F.when(ship_type.between(0, len(BLOCKS) - 1), F.element_at(F.array(*[F.lit(b) for b in BLOCKS]), ship_type.cast("int") + 1)).otherwise(F.lit(BLOCK))


def squat_m(speed_kn, block=None):
    """How much deeper a ship lies under way: its block coefficient times the square of its speed; 0 if it lies still."""
    c = F.lit(BLOCK) if block is None else F.coalesce(block, F.lit(BLOCK))
    return F.when(speed_kn > 0, c * speed_kn**2 / 100.0).otherwise(0.0)
