"""The drifting cascade: blackouts on legs, carried by wind to obstacles, less those that anchor or are repaired.

Ships start on rays: slices along a leg, and lateral places across it, each with a share of the traffic's mass.
A ray reaches an obstacle if it meets it within reach and before any obstacle that stands earlier in order of
distance; it is in an anchor zone if it has met one before.  So shadows are running minima in a window, and the
shares that reach an obstacle are sums of masses.  Obstacles that a ship meets depend on its draught only through
the deepest contour under it, so ships share one evaluation for each pair of contours (its *bucket*).

All tables carry scenario_id; where legs and edges have none, all scenarios share one geometry and its rays are cast
once.  With merged contours a ship meets one obstacle for the ground under it and one for its anchor depth, however many
charts' polygons they are made of.  Rays are generated for each edge inside its own span, and edges meet legs on grid
cells, so nothing is crossed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairway.functions import expr as X
from fairway.functions.shared import written

from . import drifting, polygons
from .powered import CELL_M, _boxed

DIRECTIONS, SLICES, RAYS, SPREAD = 8, 20, 60, 5.0
#: Least opposition of an edge's outer normal to the drift for the edge to be met from ahead.
FACING = 0.17
#: Default share of ships that anchor where they can, and how many draughts deep that is (fixed values).
ANCHOR_SHARE, ANCHOR_DRAUGHTS = 0.7, 7.0
LEG = ["scenario_id", "leg_id", "dir_idx"]


def frames(legs: DataFrame, lateral: DataFrame) -> DataFrame:
    """Per leg, travel direction and drift direction (eighths of a turn from north): the drift's frame at the leg's start.

    legs: scenario_id, leg_id, s_x, s_y, e_x, e_y in metres; lateral: scenario_id, leg_id, dir_idx, mean_m, std_m.
    x is ahead along the drift, c to its left; ``spread`` and ``along`` turn a place across the leg into c and x.
    """
    at = legs.withColumn("len", F.expr("sqrt(pow(e_x - s_x, 2e0) + pow(e_y - s_y, 2e0))")).where("len > 0").join(lateral, ["scenario_id", "leg_id"])
    at = at.withColumn("direction", F.explode(F.sequence(F.lit(0), F.lit(DIRECTIONS - 1))))
    angle = F.radians(F.col("direction") * (360.0 / DIRECTIONS))
    at = at.withColumn("ex", F.sin(angle)).withColumn("ey", F.cos(angle)).withColumn("nx", F.expr("-(e_y - s_y) / len")).withColumn("ny", F.expr("(e_x - s_x) / len"))
    at = at.withColumn("spread", F.expr("ex * ny - ey * nx")).withColumn("along", F.expr("ex * nx + ey * ny"))
    return at.withColumn("x1", F.expr("(e_x - s_x) * ex + (e_y - s_y) * ey")).withColumn("c1", F.expr("ex * (e_y - s_y) - ey * (e_x - s_x)")).drop("nx", "ny")


def facing_edges(at: DataFrame, edges: DataFrame, reach_m: Column | str = "reach_m") -> DataFrame:
    """Frames with the edges in reach, on grid cells: their ends as xa, ca, xb, cb in the drift's frame.

    edges: scenario_id, obstacle_id, kind, value_m, edge, a_x, a_y, b_x, b_y; at has reach_m.
    """
    pad = F.abs("mean_m") + SPREAD * F.col("std_m")
    reach = F.col(reach_m) if isinstance(reach_m, str) else reach_m
    parts = at.withColumn("parts", F.greatest(F.ceil(reach / CELL_M).cast("int"), F.lit(1))).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    step = lambda g, k: (F.col("part") + g) / F.col("parts") * reach * F.col(f"e{k}")
    box = {k: [F.col(f"{p}_{k}") + step(g, k) + sign * pad for p in "se" for g in (0, 1) for sign in (-1, 1)] for k in "xy"}
    mine = _boxed(parts, box["x"], box["y"]).select("scenario_id", "leg_id", "dir_idx", "direction", "cell_x", "cell_y").distinct()
    ids = ["scenario_id", "obstacle_id", "edge"]
    there = _boxed(edges, [F.col("a_x"), F.col("b_x")], [F.col("a_y"), F.col("b_y")]).select(*ids, "cell_x", "cell_y").hint("merge")
    pairs = mine.join(there, ["scenario_id", "cell_x", "cell_y"]).select(*LEG, "direction", "obstacle_id", "edge").distinct()
    both = pairs.join(at, [*LEG, "direction"]).join(edges.hint("merge"), ids)  # Spark takes repeats for as few as the obstacles, and would broadcast them
    for p in "ab":
        both = both.withColumn(f"x{p}", F.expr(f"({p}_x - s_x) * ex + ({p}_y - s_y) * ey")).withColumn(f"c{p}", F.expr(f"ex * ({p}_y - s_y) - ey * ({p}_x - s_x)"))
    # What the grid lets pass must also lie beside the leg across the drift, and neither behind it nor out of reach.
    wide = f"(abs(mean_m) + {X.num(SPREAD)} * std_m + 1e0)"
    both = both.where(f"greatest(ca, cb) >= least(0e0, c1) - {wide} and least(ca, cb) <= greatest(0e0, c1) + {wide}")
    return both.where(f"greatest(xa, xb) >= least(0e0, x1) - {wide}").where(F.expr(f"least(xa, xb) - greatest(0e0, x1) - {wide}") <= reach)


def ray_hits(facing: DataFrame, slices: int = SLICES, rays: int = RAYS) -> DataFrame:
    """Where each ray enters and leaves each obstacle: slice, ray, mass, enter_m, exit_m.

    Lateral places cover SPREAD deviations to both sides of the mean; masses are the normal's over each place's
    share, divided by the number of slices.
    """
    # Slices from which the edge lies within the lateral places, across the drift.
    ws = [F.expr(f"spread * (mean_m {s} {X.num(SPREAD)} * std_m)") for s in "-+"]
    slanted = F.abs("c1") > 1e-6
    fs = [(e - w) / F.when(slanted, F.col("c1")) for e in (F.least("ca", "cb"), F.greatest("ca", "cb")) for w in ws]
    low = F.greatest(F.lit(0), F.floor(F.least(*fs) * slices - 0.5).cast("int") - 1)
    high = F.least(F.lit(slices - 1), F.ceil(F.greatest(*fs) * slices - 0.5).cast("int") + 1)
    at = facing.withColumn("low_", F.when(slanted, low).otherwise(0)).withColumn("high_", F.when(slanted, high).otherwise(slices - 1)).where("low_ <= high_")
    at = at.withColumn("slice", F.explode(F.sequence("low_", "high_"))).withColumn("f", (F.col("slice") + 0.5) / slices)
    at = at.withColumn("ya", F.expr("ca - f * c1")).withColumn("yb", F.expr("cb - f * c1")).withColumn("low", F.col("mean_m") - SPREAD * F.col("std_m"))
    at = at.withColumn("step", 2 * SPREAD * F.col("std_m") / rays).where("step > 0")
    # Where the drift runs straight across the leg, all lateral places of a slice are on one line.
    across = F.abs("spread") < 1e-6
    wa, wb = (F.col(y) / F.when(~across, F.col("spread")) for y in ("ya", "yb"))
    first = F.when(across, 0).otherwise(F.greatest(F.lit(0), F.floor((F.least(wa, wb) - F.col("low")) / F.col("step")).cast("int") - 1))
    last = F.when(across, rays - 1).otherwise(F.least(F.lit(rays - 1), F.ceil((F.greatest(wa, wb) - F.col("low")) / F.col("step")).cast("int") + 1))
    met = at.where(~across | (F.expr("least(ya, yb) <= 0e0 and greatest(ya, yb) > 0e0"))).withColumn("first", first).withColumn("last", last).where("first <= last")
    met = met.withColumn("ray", F.explode(F.sequence("first", "last"))).withColumn("w", F.expr("low + (ray + 5e-1) * step")).withColumn("c", F.when(across, F.lit(0.0)).otherwise(F.expr("w * spread")))
    met = met.where("ya <> yb and least(ya, yb) <= c and greatest(ya, yb) > c")
    met = met.withColumn("t", F.expr("xa + (c - ya) / (yb - ya) * (xb - xa) - f * x1 - w * along")).where("t >= 0 and t <= reach_m")
    hits = met.groupBy(*LEG, "direction", "slice", "ray", "obstacle_id", "kind", "value_m").agg(F.min("t").alias("enter_m"), F.max("t").alias("exit_m"))
    # Places are so many deviations off the mean on every leg, so the mass needs the ray alone: after the sums, once a hit.
    z = lambda k: f"({X.num(2 * SPREAD / rays)} * (ray + {k}) - {X.num(SPREAD)})"
    return hits.withColumn("mass", F.expr(f"({X.phi(z('1e0'))} - {X.phi(z('0e0'))}) / {X.num(slices)}"))


def plain_holes(hits: DataFrame) -> DataFrame:
    """Share of the traffic that meets each obstacle, if it stood alone, and the least distance to it."""
    return hits.groupBy(*LEG, "direction", "obstacle_id", "kind", "value_m").agg(F.sum("mass").alias("hole"), F.min("enter_m").alias("distance_m"))


def with_buckets(cells: DataFrame, depths: DataFrame, anchor_draughts: float = ANCHOR_DRAUGHTS) -> DataFrame:
    """Adds ground_m and anchor_m: the deepest contour less deep than the draught, and than that many draughts.

    depths (value_m, and scenario_id if each scenario has its own) are contours; a chart has few different ones.  Null
    where there is none.
    """
    own = [k for k in ("scenario_id",) if k in depths.columns]
    bins = depths.groupBy(*own).agg(F.sort_array(F.collect_set("value_m")).alias("bins_"))
    under = lambda x: F.expr(f"array_max(filter(bins_, b -> b < {x}))")
    draught = "round(draught_m, 2)"
    both = cells.join(bins, own, "left") if own else cells.join(F.broadcast(bins))  # one row
    return both.withColumn("ground_m", under(draught)).withColumn("anchor_m", under(f"round({X.num(anchor_draughts)} * {draught}, 2)")).drop("bins_")


def with_merged_contours(edges: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """edges with the depths merged: one obstacle for each depth that occurs, of all polygons up to it (its id is negative).

    used (scenario_id, value_m): the depths that any ship has for its ground or anchor contour; others are left out.
    """
    depths = polygons.merged_contours(edges.where("kind = 'depth'"))
    if used is not None:
        depths = depths.join(used.select("scenario_id", F.col("value_m").alias("boundary_m")).distinct(), ["scenario_id", "boundary_m"], "left_semi")
    merged = polygons.as_obstacles(depths)
    objects = edges.where("kind = 'object'").withColumn("edge", F.col("edge").cast("long"))
    return objects.select(merged.columns).unionByName(merged)


def _rows_of_buckets(rows: DataFrame, buckets: DataFrame, merged: bool) -> DataFrame:
    """Hits with the buckets that meet their obstacle, and as what: place and accident."""
    role = lambda place, accident: [F.lit(place).alias("place"), F.lit(accident).alias("accident")]
    if merged:  # one contour stands for all above it, so depths meet their own buckets alone
        meant = lambda kind, of, *r: F.struct(F.lit(kind).alias("kind"), of.alias("of_m"), *role(*r))
        roles = F.array(meant("object", F.lit(0.0), 0, "allision"), meant("depth", F.col("anchor_m"), 1, "anchoring"), meant("depth", F.col("ground_m"), 2, "grounding"))
        met = buckets.select(*LEG, "ground_m", "anchor_m", F.inline(roles)).where("of_m is not null")
        return rows.withColumn("of_m", F.when(F.col("kind") == "object", 0.0).otherwise(F.col("value_m"))).join(met, [*LEG, "kind", "of_m"]).drop("of_m")
    kinds = F.array_compact(
        F.array(
            F.when(F.col("kind") == "object", F.struct(*role(0, "allision"))),
            F.when((F.col("kind") == "depth") & (F.col("value_m") <= F.col("anchor_m")), F.struct(*role(1, "anchoring"))),
            F.when((F.col("kind") == "depth") & (F.col("value_m") <= F.col("ground_m")), F.struct(*role(2, "grounding"))),
        )
    )
    return rows.join(buckets, LEG).select("*", F.inline(kinds))


def reached(hits: DataFrame, buckets: DataFrame, merged: bool = False) -> DataFrame:
    """Per bucket and obstacle: accident (allision, grounding, anchoring), hole, h_reach, h_in_anchor, distance_m.

    buckets: scenario_id, leg_id, dir_idx, ground_m, anchor_m, each once.  Obstacles stand in order of their least
    distance, of equal ones objects first, then by id; an anchor zone stands before the ground of the same contour.
    """
    far = plain_holes(hits)
    rows = hits.join(far.select(*LEG, "direction", "obstacle_id", "distance_m", "hole"), [*LEG, "direction", "obstacle_id"])
    rows = _rows_of_buckets(rows, buckets, merged)
    bucket = [*LEG, "direction", "ground_m", "anchor_m"]
    # A hash of the keys leads the sort: few rows share its prefix, while most rows share scenario and leg.
    spot = [*bucket, "slice", "ray"]
    rows = rows.select(F.xxhash64(*spot).alias("spot"), *spot, "obstacle_id", "value_m", "distance_m", "hole", "mass", "enter_m", "exit_m", "place")
    order = Window.partitionBy("spot", *spot).orderBy("distance_m", F.least("place", F.lit(1)), "obstacle_id", "place").rowsBetween(Window.unboundedPreceding, -1)
    none, anchoring = F.lit(float("inf")), F.col("place") == 1
    rows = rows.withColumn("blocked_m", F.coalesce(F.min(F.when(~anchoring, F.col("enter_m"))).over(order), none))
    rows = rows.withColumn("anchors_m", F.coalesce(F.min(F.when(anchoring, F.col("enter_m"))).over(order), none))
    free = F.col("enter_m") < F.col("blocked_m")
    inside = free & ~anchoring & (F.col("anchors_m") <= F.least("exit_m", "blocked_m"))
    sums = rows.groupBy(*bucket, "obstacle_id", "place").agg(
        *[F.max(c).alias(c) for c in ("value_m", "distance_m", "hole")],  # the same in all rows of an obstacle
        F.sum(F.when(free, F.col("mass")).otherwise(0.0)).alias("h_reach"), F.sum(F.when(inside, F.col("mass")).otherwise(0.0)).alias("h_in_anchor"),
    )
    return sums.withColumn("accident", F.get(F.array(*[F.lit(a) for a in ("allision", "anchoring", "grounding")]), F.col("place"))).drop("place")


def edge_shares(facing: DataFrame) -> DataFrame:
    """Per leg, directions, obstacle and edge: share of the obstacle's edges that face the drift inside its
    corridor, by length, and the mean distance of the edge's ends from the leg along the drift.

    Edges run counter-clockwise around their obstacle.  If none of them counts, all near the corridor share equally.
    """
    side = [F.expr(f"spread * (mean_m {s} {X.num(SPREAD)} * std_m)") for s in "-+"]
    low, high = F.least(F.lit(0.0), "c1") + F.least(*side), F.greatest(F.lit(0.0), "c1") + F.greatest(*side)
    e = facing.withColumn("long", F.expr("sqrt(pow(xb - xa, 2e0) + pow(cb - ca, 2e0))")).where("long > 0")
    e = e.withColumn("low", low).withColumn("high", high)
    lo, hi = F.greatest(F.least("ca", "cb"), "low"), F.least(F.greatest("ca", "cb"), "high")
    # The outer normal's part along the drift is the edge's step to the left, turned back.
    met = F.expr("(cb - ca) / long") <= -FACING
    e = e.withColumn("inside_m", F.when(met, F.greatest(hi - lo, F.lit(0.0)) / F.abs(F.col("cb") - F.col("ca")) * F.col("long")).otherwise(0.0))
    for p in "ab":
        ahead = F.when(F.abs("c1") > 1e-6, F.col("x1") * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"c{p}") / F.col("c1")))).otherwise(F.greatest(F.lit(0.0), "x1"))
        e = e.withColumn(f"d{p}", F.col(f"x{p}") - ahead)
    near = lambda p: F.when(F.col(f"d{p}") >= 0, F.col(f"d{p}"))
    distance = F.coalesce((near("a") + near("b")) / 2, near("a"), near("b"))
    e = e.withColumn("edge_m", F.when(F.col("inside_m") > 0, distance)).withColumn("inside_m", F.when(F.col("edge_m") <= F.col("reach_m"), F.col("inside_m")).otherwise(0.0))
    whole = e.groupBy(*LEG, "direction", "obstacle_id").agg(F.sum("inside_m").alias("all_m"), F.count("*").alias("edges"))
    share = F.when(F.col("all_m") > 0, F.try_divide("inside_m", "all_m")).otherwise(1.0 / F.col("edges"))
    out = e.join(whole, [*LEG, "direction", "obstacle_id"]).withColumn("share", share).where("share > 0")
    return out.select(*LEG, "direction", "obstacle_id", "edge", "share", F.when(F.col("all_m") > 0, F.col("edge_m")).alias("edge_m"))


def _chances(reach: DataFrame, shares: DataFrame, rose: DataFrame, anchor_share: float, drift_kn: float, factors: dict[str, float] | None, repair: dict, shared: bool = False) -> DataFrame:
    """Per bucket, drift direction, obstacle and edge: the chance that a blackout ends there, by accident."""
    parts = reach.join(shares, [*LEG, "direction", "obstacle_id"], "left")
    parts = parts.drop("scenario_id").join(rose, "direction") if shared else parts.join(rose, ["scenario_id", "direction"])
    parts = parts.withColumn("share", F.coalesce("share", F.lit(1.0))).withColumn("edge_m", F.coalesce("edge_m", "distance_m"))
    parts = drifting.not_repaired(parts, "edge_m", drift_kn=drift_kn, **repair)
    free = F.when(F.col("accident") == "anchoring", F.col("h_reach")).otherwise(F.greatest(F.lit(0.0), F.col("h_reach") - anchor_share * F.col("h_in_anchor")))
    last = F.when(F.col("accident") == "anchoring", F.lit(anchor_share)).otherwise(F.col("p_not_repaired"))
    factor = F.lit(1.0)
    for accident, f in (factors or {}).items():
        factor = F.when(F.col("accident") == accident, F.lit(f)).otherwise(factor)
    return parts.withColumn("h_eff", free * F.col("share")).withColumn("chance", F.col("rp") * F.col("h_eff") * last * factor).where("chance > 0")


#: What the fact table has a row for: cells at edges, all of a bucket's cells at edges, or cells at all edges together.
DETAILS = ("all", "places", "cells")


def contributions(exposure: DataFrame, reach: DataFrame, shares: DataFrame, rose: DataFrame, anchor_share: float = ANCHOR_SHARE, drift_kn: float = drifting.DRIFT_KN, factors: dict[str, float] | None = None, detail: str = "all", shared: bool = False, **repair) -> DataFrame:
    """The cascade's fact table: yearly frequency of each cell at each edge of each obstacle, by drift direction.

    exposure: with_buckets of blackout_exposure; reach: reached; rose: scenario_id, direction, rp; factors: by
    accident, 1 where missing.  With shared, reach and shares are of one geometry for all scenarios.
    Where no report asks for both cells and places, detail "places" or "cells" sums up the other side before the
    join, so that cells and edges are never paired: ship_type and size_bin, or obstacle_id and edge, are null then.
    """
    if detail not in DETAILS:
        raise ValueError(f"detail is one of {DETAILS}")
    parts = _chances(reach, shares, rose, anchor_share, drift_kn, factors, repair, shared)
    own = exposure.select(*LEG, "ship_type", "size_bin", "base", "freq", "ground_m", "anchor_m")
    bucket = [*LEG, "ground_m", "anchor_m"]
    nothing = F.lit(None).cast("int")
    if detail == "places":
        own = own.groupBy(*bucket).agg(F.sum("base").alias("base")).withColumn("ship_type", nothing).withColumn("size_bin", nothing)
    if detail == "cells":
        mean = lambda c: (F.sum(F.col(c) * F.col("chance")) / F.sum("chance")).alias(c)
        parts = parts.groupBy(*bucket, "direction", "accident", "rp").agg(F.sum("chance").alias("chance"), mean("p_not_repaired"), F.min("edge_m").alias("edge_m"), *[F.sum(c).alias(c) for c in ("hole", "h_reach", "h_in_anchor", "h_eff")])
        parts = parts.withColumn("obstacle_id", F.lit(None).cast("long")).withColumn("edge", nothing)
    # Null-safe: a ship may have no contour under it.
    named = parts.withColumnsRenamed({k: f"{k}_" for k in bucket})
    both = own.join(named, [own[k] == F.col(f"{k}_") for k in LEG] + [own[k].eqNullSafe(F.col(f"{k}_")) for k in ("ground_m", "anchor_m")])
    return both.select(
        *LEG, "direction", "ship_type", "size_bin", "accident", "obstacle_id", "edge", "edge_m", "p_not_repaired", "hole", "h_reach", "h_in_anchor", "h_eff", "base", "rp",
        (F.col("base") * F.col("chance")).alias("frequency"),
    )


def cascade(
    cells: DataFrame, legs: DataFrame, lateral: DataFrame, edges: DataFrame, rose: DataFrame, rates: DataFrame, reach: DataFrame, anchor_share: float = ANCHOR_SHARE, anchor_draughts: float = ANCHOR_DRAUGHTS,
    drift_kn: float = drifting.DRIFT_KN, slices: int = SLICES, rays: int = RAYS, factors: dict[str, float] | None = None, detail: str = "all", merged: bool = False, **repair,
) -> DataFrame:
    """The fact table of all scenarios.  reach: scenario_id, reach_m; legs also have length_m; edges as facing_edges.

    If legs, lateral, edges and reach have no scenario_id, all scenarios of cells and rose share their geometry.
    """
    shared = "scenario_id" not in legs.columns
    exposure = drifting.blackout_exposure(cells, legs, rates)
    depths = edges.where("kind = 'depth'").select(*([] if shared else ["scenario_id"]), "value_m")
    exposure = with_buckets(exposure, depths, anchor_draughts)
    if shared:
        legs, lateral, edges, reach = (t.withColumn("scenario_id", F.lit(0).cast("long")) for t in (legs, lateral, edges, reach))
    scope = F.lit(0).cast("long") if shared else F.col("scenario_id")
    buckets = exposure.select(scope.alias("scenario_id"), "leg_id", "dir_idx", "ground_m", "anchor_m").distinct()
    # An object on the place of another comes after it and is never reached, so of copies the one of smallest id stays.
    edges = polygons.shapes(edges.where("kind = 'object'"))[0].unionByName(edges.where("kind <> 'object'"))
    if merged:
        used = buckets.select("scenario_id", F.explode(F.array("ground_m", "anchor_m")).alias("value_m")).where("value_m is not null")
        edges = with_merged_contours(edges, used)
    facing = written(facing_edges(frames(legs, lateral).join(reach, "scenario_id"), edges), "facing")
    hits = written(ray_hits(facing, slices, rays), "hits")  # read for the holes and again for their shadows
    return contributions(exposure, reached(hits, buckets, merged), edge_shares(facing), rose, anchor_share, drift_kn, factors, detail, shared, **repair)


def rolled_up(facts: DataFrame, *keys: str) -> DataFrame:
    """Frequencies by accident and the keys, with means weighted by frequency and the least distance."""
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("frequency")), F.sum("frequency")).alias(c)
    return facts.groupBy("scenario_id", "accident", *keys).agg(F.sum("frequency").alias("frequency"), mean("p_not_repaired"), mean("h_eff"), F.min("edge_m").alias("distance_m"))


def exposed_hours(facts: DataFrame, rate: float = 1.0) -> DataFrame:
    """Ship-hours a year behind the facts of each scenario: each cell and drift direction once, over the blackout rate."""
    once = facts.groupBy(*LEG, "direction", "ship_type", "size_bin").agg(F.first("base").alias("base"), F.first("rp").alias("rp"))
    return once.groupBy("scenario_id").agg((F.sum(F.col("base") * F.col("rp")) * drifting.HOURS / rate).alias("ship_hours"))


def drift_fans(hits: DataFrame, buckets: DataFrame, reach: DataFrame) -> DataFrame:
    """Per ray that meets something: how far a ship drifts (reach_m), and from where on it can anchor (anchor_m_at)."""
    rows = hits.join(buckets, LEG).join(reach, "scenario_id")
    stops = (F.col("kind") == "object") | (F.col("value_m") <= F.col("ground_m"))
    anchor = (F.col("kind") == "depth") & (F.col("value_m") <= F.col("anchor_m"))
    fan = rows.groupBy(*LEG, "direction", "ground_m", "anchor_m", "slice", "ray", "reach_m").agg(F.first("mass").alias("mass"), F.min(F.when(stops, F.col("enter_m"))).alias("stop_m"), F.min(F.when(anchor, F.col("enter_m"))).alias("anchor_at_m"))
    return fan.withColumn("drift_m", F.least(F.coalesce("stop_m", "reach_m"), "reach_m")).withColumn("anchor_at_m", F.when(F.col("anchor_at_m") <= F.col("drift_m"), F.col("anchor_at_m"))).drop("reach_m")


def exposure_factor(drift_deg: Column, normal_deg: Column) -> Column:
    """How squarely a drift meets an edge: the cosine of its angle to the reverse of the outer normal, 0 from behind."""
    return F.greatest(F.cos(F.radians(drift_deg - normal_deg - 180.0)), F.lit(0.0))
