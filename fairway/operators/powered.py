"""Powered grounding and allision: rays cast on from the end of each leg.

Rays are numbered from one side of the lateral distribution to the other; every obstacle edge makes only the
numbers inside its own lateral span, so rays and edges are never crossed.  Legs and edges meet on grid cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairway.functions import expr as X

from .collision import scope

RAYS, SPREAD, RANGE_M, AI_S = 500, 4.0, 50_000.0, 180.0
#: Metres per degree of longitude at the equator, and of latitude (fixed values).
LON_M, LAT_M = 111_320.0, 110_540.0
CELL_M = 5_000.0


def projected(df: DataFrame, lon0: float, lat0: float, **points: tuple[str, str]) -> DataFrame:
    """Adds name_x, name_y in metres from (lon0, lat0) for each name = (lon column, lat column)."""
    k = F.cos(F.radians(F.lit(lat0))) * LON_M
    for name, (lon, lat) in points.items():
        df = df.withColumn(f"{name}_x", (F.col(lon) - lon0) * k).withColumn(f"{name}_y", (F.col(lat) - lat0) * LAT_M)
    return df


def box_edges(obstacles: DataFrame) -> DataFrame:
    """The four edges of each box, counter-clockwise."""
    corner = lambda x1, y1, x2, y2: F.struct(F.col(x1).alias("a_lon"), F.col(y1).alias("a_lat"), F.col(x2).alias("b_lon"), F.col(y2).alias("b_lat"))
    edges = F.array(corner("x0", "y0", "x1", "y0"), corner("x1", "y0", "x1", "y1"), corner("x1", "y1", "x0", "y1"), corner("x0", "y1", "x0", "y0"))
    return obstacles.select("obstacle_id", "kind", "value_m", F.posexplode(edges).alias("edge", "e")).select("obstacle_id", "kind", "value_m", "edge", "e.*")


BOX = ["x0", "y0", "x1", "y1"]


def foremost(obstacles: DataFrame) -> DataFrame:
    """Of obstacles on one box the one of smallest id: rays that meet it meet the others as far on, so never first."""
    return obstacles.groupBy(*BOX).agg(F.min(F.struct("obstacle_id", "kind", "value_m")).alias("o")).select("o.*", *BOX)


def foremost_by_depth(obstacles: DataFrame) -> DataFrame:
    """Of obstacles on one box those that accidents can choose: the object of smallest id, and each contour that has a
    smaller id than all that are less deep.  Copies meet in the sums first, so a box of many is no large group.
    """
    each = obstacles.groupBy(*BOX, "kind", "value_m").agg(F.min("obstacle_id").alias("obstacle_id"))
    less_deep = Window.partitionBy(*BOX).orderBy("value_m").rowsBetween(Window.unboundedPreceding, -1)
    contours = each.where("kind = 'depth' and value_m is not null").withColumn("before_", F.min("obstacle_id").over(less_deep))
    contours = contours.where("before_ is null or obstacle_id < before_").drop("before_")
    return contours.unionByName(foremost(each.where("kind = 'object'")))


def turning_points(legs: DataFrame, lateral: DataFrame, speeds: DataFrame, lon0: float, lat0: float) -> DataFrame:
    """Per leg and direction, and scenario where a table has one: where ships fail to turn, the way they go on, and their lateral spread."""
    p = projected(legs, lon0, lat0, s=("lon1", "lat1"), e=("lon2", "lat2")).withColumn("len", F.expr("sqrt(pow(e_x - s_x, 2e0) + pow(e_y - s_y, 2e0))")).where("len > 0")
    out = p.select(*scope(p), "leg_id", "s_x", "s_y", "e_x", "e_y", F.expr("(e_x - s_x) / len").alias("ux"), F.expr("(e_y - s_y) / len").alias("uy"), F.explode(F.array(F.lit(0), F.lit(1))).alias("dir_idx"))
    ahead = F.col("dir_idx") == 0
    out = out.select(*scope(p), "leg_id", "dir_idx", F.when(ahead, F.col("e_x")).otherwise(F.col("s_x")).alias("tx"), F.when(ahead, F.col("e_y")).otherwise(F.col("s_y")).alias("ty"), F.when(ahead, F.col("ux")).otherwise(-F.col("ux")).alias("dx"), F.when(ahead, F.col("uy")).otherwise(-F.col("uy")).alias("dy"), (-F.col("uy")).alias("nx"), F.col("ux").alias("ny"))
    out = out.join(lateral, [*scope(out, lateral), "leg_id", "dir_idx"])
    return out.join(speeds.where("speed_kn > 0"), [*scope(out, speeds), "leg_id", "dir_idx"])


def _boxed(df: DataFrame, xs: list, ys: list) -> DataFrame:
    """Each row once for every grid cell that the box around the places touches, as cell_x, cell_y."""
    span = lambda c: F.explode(F.sequence(F.floor((F.least(*c) - 1.0) / CELL_M), F.floor((F.greatest(*c) + 1.0) / CELL_M)))
    return df.withColumn("cell_x", span(xs)).withColumn("cell_y", span(ys))


def near(corridors: DataFrame, edges: DataFrame, length_m: float) -> DataFrame:
    """Corridors joined with the edges (a_x, a_y, b_x, b_y) that may reach into them, on grid cells.

    A corridor goes from (at_x, at_y) along (to_x, to_y) for length_m, from left_m to right_m along (side_x, side_y).
    An edge counts with all places as near as it is long, so the box around it in the corridor's frame does too.  A
    pair is repeated for each cell that it shares.  Where both have scenarios they meet within one.
    """
    n = max(1, int(-(-length_m // CELL_M)))
    parts = corridors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    xs, ys = ([F.expr(f"at_{k} + {g} * to_{k} * {X.num(length_m / n)} + {w} * side_{k}") for g in ("part", "(part + 1)") for w in ("left_m", "right_m")] for k in ("x", "y"))
    mine = _boxed(parts, xs, ys).drop("part").distinct()
    long = F.expr("sqrt(pow(b_x - a_x, 2e0) + pow(b_y - a_y, 2e0))")
    xs, ys = ([F.col(f"{e}_{k}") + sign * long for e in ("a", "b") for sign in (-1, 1)] for k in ("x", "y"))
    there = _boxed(edges, xs, ys).hint("merge")  # Spark takes them for as few as the obstacles, and would broadcast them
    return mine.join(there, [*scope(mine, edges), "cell_x", "cell_y"]).drop("cell_x", "cell_y", "at_x", "at_y", "to_x", "to_y", "side_x", "side_y", "left_m", "right_m")


def ray_hits(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Nearest hit of each ray with each obstacle: leg_id, dir_idx, ray, mass, obstacle_id, kind, value_m, along_m.

    points: turning_points; edges: projected box_edges (a_x, a_y, b_x, b_y).  With scenarios in either, hits have them too.
    """
    p = points.withColumn("low", F.col("mean_m") - SPREAD * F.col("std_m")).withColumn("step", 2 * SPREAD * F.col("std_m") / (RAYS - 1))
    strip = {"at_x": F.col("tx"), "at_y": F.col("ty"), "to_x": F.col("dx"), "to_y": F.col("dy"), "side_x": F.col("nx"), "side_y": F.col("ny"), "left_m": F.col("low"), "right_m": F.col("low") + (RAYS - 1) * F.col("step")}
    both = near(p.withColumns(strip), edges, RANGE_M)  # repeats don't matter to the minimum
    for k in ("a", "b"):
        both = both.withColumn(f"x{k}", F.expr(f"({k}_x - tx) * dx + ({k}_y - ty) * dy")).withColumn(f"y{k}", F.expr(f"({k}_x - tx) * nx + ({k}_y - ty) * ny"))
    both = both.where("ya <> yb and greatest(xa, xb) > 0").withColumn("lo", F.least("ya", "yb")).withColumn("hi", F.greatest("ya", "yb"))
    first = F.greatest(F.lit(0), F.ceil((F.col("lo") - F.col("low")) / F.col("step")).cast("int") - 1)
    last = F.least(F.lit(RAYS - 1), F.floor((F.col("hi") - F.col("low")) / F.col("step")).cast("int") + 1)
    rays = both.withColumn("first", first).withColumn("last", last).where("first <= last").withColumn("ray", F.explode(F.sequence("first", "last")))
    rays = rays.withColumn("offset", F.col("low") + F.col("ray") * F.col("step")).where("offset >= lo and offset < hi")
    rays = rays.withColumn("along_m", F.expr("xa + (offset - ya) / (yb - ya) * (xb - xa)")).where(f"along_m > 0 and along_m < {X.num(RANGE_M)}")
    mass = F.exp(-((F.col("offset") - F.col("mean_m")) ** 2) / (2 * F.col("std_m") ** 2)) / (F.col("std_m") * 2.5066282746310002) * F.col("step")
    return rays.withColumn("mass", mass).groupBy(*scope(rays), "leg_id", "dir_idx", "ray", "obstacle_id", "kind", "value_m").agg(F.min("along_m").alias("along_m"), F.first("mass").alias("mass"))


def first_hits(hits: DataFrame, *by: str) -> DataFrame:
    """The obstacle that each ray meets first, for each value of the columns by; of equal distances the smaller id."""
    best = F.min(F.struct("along_m", "obstacle_id", "kind", "value_m", "mass")).alias("h")
    own = [*scope(hits), "leg_id", "dir_idx", "ray", *by]
    return hits.groupBy(*own).agg(best).select(*own, "h.*")


def summaries(first: DataFrame, points: DataFrame, *by: str) -> DataFrame:
    """Per leg, direction and obstacle: mass, mean distance, and the chance not to have turned in time."""
    v = F.col("speed_kn") * X.KNOT_MS
    rows = first.join(points.select(*scope(points), "leg_id", "dir_idx", "speed_kn"), [*scope(first, points), "leg_id", "dir_idx"])
    out = rows.groupBy(*scope(rows), "leg_id", "dir_idx", *by, "obstacle_id", "kind", "value_m", "speed_kn").agg(F.sum("mass").alias("mass"), (F.sum(F.col("mass") * F.col("along_m")) / F.sum("mass")).alias("mean_m"), F.sum(F.col("mass") * F.exp(-F.col("along_m") / (AI_S * v))).alias("p_integral"), F.count("*").alias("n_rays"))
    return out.withColumn("p_approx", F.col("mass") * F.exp(-F.col("mean_m") / (AI_S * v))).drop("speed_kn")


def contributions(cells: DataFrame, parts: DataFrame, gate, causation: float, *by: str) -> DataFrame:
    """Each cell's yearly frequency at each obstacle that passes the gate on (cell, obstacle).

    Cells of several scenarios share parts that have none: rays of one network and chart are then cast once for all.
    """
    v = F.when(F.col("speed_kn") > 0, F.col("speed_kn")).otherwise(10.0) * X.KNOT_MS
    both = cells.join(parts, [*scope(cells, parts), "leg_id", "dir_idx", *by]).where(gate)
    value = causation * F.col("freq") * F.col("mass") * F.exp(-F.col("mean_m") / (AI_S * v))
    return both.select(*scope(both), "leg_id", "dir_idx", "ship_type", "size_bin", "obstacle_id", value.alias("frequency"))


def depth_bins(cells: DataFrame, depths: DataFrame) -> DataFrame:
    """Adds bin_m: the deepest depth contour not deeper than the draught (null if none).

    depths (value_m, and scenario_id if the cells have it) are contours, of which a chart has few different ones.
    """
    own = scope(cells, depths)
    bins = depths.groupBy(*own).agg(F.sort_array(F.collect_set("value_m")).alias("bins_"))
    both = cells.join(bins, own, "left") if own else cells.join(F.broadcast(bins))  # one row
    return both.withColumn("bin_m", F.expr("array_max(filter(bins_, b -> b <= draught_m))")).drop("bins_")


def accidents(cells: DataFrame, hits: DataFrame, points: DataFrame, depths: DataFrame, causation: dict[str, float]) -> DataFrame:
    """Yearly frequencies of kind grounding and allision, by cell and obstacle.

    A ship grounds on what its rays meet first among the contours not deeper than its depth bin, and hits what they
    meet first among the objects alone, if it is as high.  depths (value_m, with scenario_id if hits have one) are the
    contours of the scenario.  Cells may have scenarios that hits and depths don't have.
    """
    depth = hits.where("kind = 'depth'")
    own = scope(depth, depths)
    bins = depths.groupBy(*own).agg(F.sort_array(F.collect_set("value_m")).alias("bins"))  # a row for each scenario
    # A contour is first for the bins from its own depth to below the least of those met before it.
    met = Window.partitionBy(*scope(depth), "leg_id", "dir_idx", "ray").orderBy("along_m", "obstacle_id", "value_m").rowsBetween(Window.unboundedPreceding, -1)
    ahead = depth.withColumn("least_", F.min("value_m").over(met)).where("least_ is null or value_m < least_")
    each = (ahead.join(bins, own) if own else ahead.join(F.broadcast(bins))).withColumn("bin_m", F.explode(F.expr("filter(bins, b -> b >= value_m and (least_ is null or b < least_))"))).drop("bins", "least_")
    shoals = summaries(each, points, "bin_m")
    grounding = contributions(depth_bins(cells, depths), shoals, F.lit(True), causation["grounding"], "bin_m")
    objects = summaries(first_hits(hits.where("kind = 'object'")), points)
    allision = contributions(cells, objects, F.col("height_m") >= F.col("value_m"), causation["allision"])
    return grounding.withColumn("accident", F.lit("grounding")).unionByName(allision.withColumn("accident", F.lit("allision")))


def closed_form(q, mass, distance_m, speed_kn, causation: float, ai_s: float = AI_S):
    """Yearly frequency of category II: ships that fail to turn and do not recover on the way."""
    return causation * q * mass * F.exp(-distance_m / (ai_s * speed_kn * X.KNOT_MS))


def category_1(q, share, causation: float):
    """Yearly frequency of category I: the share of ships whose course leads onto the obstacle."""
    return causation * q * share


def recovery_m(speed_kn, ai_s: float = AI_S):
    """Distance on which a share 1 / e of the ships has not recovered."""
    return ai_s * speed_kn * X.KNOT_MS
