"""Drift corridors as convex regions: a leg's band swept along the drift, what it meets, and how far ships get in it.

A band is a leg, moved sideways by the traffic's mean and widened by a disc; swept along a drift it is the sum of the
parallelogram of leg and drift with the disc, which a regular polygon of ``CORNERS`` corners stands for.  Such a region
is kept as its half-planes (nx, ny, c: n * p <= c): both parts' sides, each as far out as the corners reach.  So edges
are clipped to it without making its hull first.  Bands meet edges on grid cells along the drift.

legs: scenario_id, leg_id, s_x, s_y, e_x, e_y in metres; lateral: scenario_id, leg_id, dir_idx, mean_m, std_m;
reach: scenario_id, reach_m; edges: scenario_id, obstacle_id, kind, value_m, edge, a_x, a_y, b_x, b_y.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairway.functions import expr as X

from .polygons import covering, shapes, with_copies
from .powered import CELL_M, _boxed

#: Corners of the polygon that stands for a disc, and directions of drift.
CORNERS, DIRECTIONS = 32, 8
#: Deviations that a band covers to both sides: of the coverage bands, and of the engine's corridors (fixed values).
BAND_SPREAD, ENGINE_SPREAD = 4.89, 3.0
KEY = ["scenario_id", "leg_id", "dir_idx", "direction"]


# ---- regions ----------------------------------------------------------------------------------------------------


def bands(legs: DataFrame, lateral: DataFrame, reach: DataFrame, spread: float = BAND_SPREAD, least_m: float = 0.0) -> DataFrame:
    """Per leg, travel direction and drift direction (eighths of a turn from north) the moved leg, drift and radius.

    o_x ... f_y: the leg itself; s_x ... e_y: moved to its left by the mean; l_, h_: unit vectors of leg and drift;
    g_: the drift, reach_m long; radius_m: spread deviations, but least_m at least.  Legs without length go.
    """
    at = legs.withColumn("len", F.expr("sqrt(pow(e_x - s_x, 2e0) + pow(e_y - s_y, 2e0))")).where("len > 0").join(lateral, ["scenario_id", "leg_id"]).join(reach, "scenario_id")
    at = at.withColumns({f"l_{k}": F.expr(f"(e_{k} - s_{k}) / len") for k in "xy"}).withColumn("direction", F.explode(F.sequence(F.lit(0), F.lit(DIRECTIONS - 1))))
    angle = F.radians(F.col("direction") * (360.0 / DIRECTIONS))
    at = at.withColumn("h_x", F.sin(angle)).withColumn("h_y", F.cos(angle)).withColumn("g_x", F.expr("reach_m * h_x")).withColumn("g_y", F.expr("reach_m * h_y"))
    at = at.withColumns({"o_x": F.col("s_x"), "o_y": F.col("s_y"), "f_x": F.col("e_x"), "f_y": F.col("e_y")})
    moved = {f"{p}_{k}": F.expr(f"{p}_{k} {side} mean_m * l_{o}") for p in "se" for k, o, side in (("x", "y", "-"), ("y", "x", "+"))}
    at = at.withColumns(moved).withColumn("radius_m", F.greatest(F.lit(float(least_m)), spread * F.col("std_m")))
    return at.select(*KEY, "mean_m", "std_m", "len", "reach_m", "radius_m", *[f"{p}_{k}" for p in "ofselhg" for k in "xy"])


def plane_texts(corners: int = CORNERS) -> list[tuple[str, str, str]]:
    """SQL of the half-planes (nx, ny, c) of a band swept along its drift, in the columns of bands()."""
    far = lambda nx, ny: f"greatest({nx} * s_x + {ny} * s_y, {nx} * e_x + {ny} * e_y) + greatest(0e0, {nx} * g_x + {ny} * g_y)"
    out = []
    for k in range(corners):
        nx, ny = (X.num(f(2 * math.pi * (k + 0.5) / corners)) for f in (math.cos, math.sin))
        out.append((nx, ny, f"{far(f'({nx})', f'({ny})')} + {X.num(math.cos(math.pi / corners))} * radius_m"))
    step = X.num(2 * math.pi / corners)
    for v in "lh":
        for nx, ny in ((f"{v}_y", f"(-{v}_x)"), (f"(-{v}_y)", f"{v}_x")):
            corner = f"(round(atan2({ny}, {nx}) / {step}) * {step})"  # the disc's corner that lies farthest that way
            out.append((nx, ny, f"{far(nx, ny)} + radius_m * ({nx} * cos({corner}) + {ny} * sin({corner}))"))
    return out


def with_planes(at: DataFrame) -> DataFrame:
    return at.withColumn("planes", F.array(*[F.struct(F.expr(nx).alias("nx"), F.expr(ny).alias("ny"), F.expr(c).alias("c")) for nx, ny, c in plane_texts()]))


def inside_texts(planes: str = "planes", arrow: str = "p ->", most: str = "array_max", least: str = "array_min", each: str = "transform") -> tuple[str, str]:
    """SQL of the part (t0, t1) of the edge from a to b inside all half-planes; t0 >= t1 if there is none."""
    da, db = (f"(p.nx * {e}_x + p.ny * {e}_y - p.c)" for e in "ab")
    low = f"CASE WHEN {da} > 0e0 THEN CASE WHEN {db} <= 0e0 THEN {da} / ({da} - {db}) ELSE 2e0 END ELSE 0e0 END"
    high = f"CASE WHEN {da} <= 0e0 AND {db} > 0e0 THEN {da} / ({da} - {db}) ELSE 1e0 END"
    return f"{most}({each}({planes}, {arrow} {low}))", f"{least}({each}({planes}, {arrow} {high}))"


def corners_of(at: DataFrame) -> DataFrame:
    """The corners of the swept bands, counter-clockwise: KEY, place, x, y; where sides lie on each other there are fewer."""
    turned = F.sort_array(F.transform("planes", lambda p: F.struct(F.atan2(p.ny, p.nx).alias("a"), p.nx.alias("nx"), p.ny.alias("ny"), p.c.alias("c"))))
    rows = with_planes(at).select(*KEY, turned.alias("ps")).select(*KEY, F.posexplode(F.arrays_zip(F.col("ps").alias("p"), F.concat(F.slice("ps", 2, 1000), F.slice("ps", 1, 1)).alias("q"))).alias("place", "pq"))
    rows = rows.select(*KEY, "place", "pq.*").withColumn("det", F.expr("p.nx * q.ny - p.ny * q.nx")).where("abs(det) > 1e-9")
    return rows.select(*KEY, "place", F.expr("(p.c * q.ny - q.c * p.ny) / det").alias("x"), F.expr("(p.nx * q.c - q.nx * p.c) / det").alias("y"))


# ---- what a corridor meets --------------------------------------------------------------------------------------


def near(at: DataFrame, edges: DataFrame) -> DataFrame:
    """Bands with the edges that may reach into them, each pair once: the boxes around both share a grid cell."""
    parts = at.select(*KEY, "s_x", "s_y", "e_x", "e_y", "h_x", "h_y", "radius_m", "reach_m").withColumn("parts", F.greatest(F.ceil(F.col("reach_m") / CELL_M).cast("int"), F.lit(1))).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    step = lambda g, k: (F.col("part") + g) / F.col("parts") * F.col("reach_m") * F.col(f"h_{k}")
    box = {k: [F.col(f"{p}_{k}") + step(g, k) + sign * F.col("radius_m") for p in "se" for g in (0, 1) for sign in (-1, 1)] for k in "xy"}
    mine = _boxed(parts, box["x"], box["y"]).select(*KEY, "cell_x", "cell_y").distinct()
    edges = edges.hint("merge")  # Spark takes repeats for as few as the obstacles, and would broadcast them
    there = _boxed(edges.select("scenario_id", "obstacle_id", "edge", "a_x", "a_y", "b_x", "b_y"), [F.col("a_x"), F.col("b_x")], [F.col("a_y"), F.col("b_y")]).select("scenario_id", "obstacle_id", "edge", "cell_x", "cell_y").hint("merge")
    pairs = mine.join(there, ["scenario_id", "cell_x", "cell_y"]).select(*KEY, "obstacle_id", "edge").distinct()
    return pairs.join(at, KEY).join(edges, ["scenario_id", "obstacle_id", "edge"])


def inside_parts(at: DataFrame, edges: DataFrame) -> DataFrame:
    """near() with the part (t0, t1) of each edge inside the swept band, and its length inside_m; those without go."""
    t0, t1 = inside_texts()
    met = with_planes(near(at, edges)).withColumn("t0", F.expr(t0)).withColumn("t1", F.expr(t1)).where("t0 < t1")
    return met.withColumn("inside_m", F.expr("(t1 - t0) * sqrt(pow(b_x - a_x, 2e0) + pow(b_y - a_y, 2e0))"))


def overlaps(at: DataFrame, edges: DataFrame) -> DataFrame:
    """The obstacles that each swept band overlaps: KEY, obstacle_id, inside_m, the length of their edges inside it.

    An obstacle that holds the whole band has no edge inside, but holds the leg's start.
    """
    own, copies = shapes(edges)
    return with_copies(_overlaps(at, own), copies)


def _overlaps(at: DataFrame, edges: DataFrame) -> DataFrame:
    """overlaps() of obstacles of different shapes."""
    met = inside_parts(at, edges).groupBy(*KEY, "obstacle_id").agg(F.sum("inside_m").alias("inside_m"))
    starts = at.select(*KEY, F.col("s_x").alias("x"), F.col("s_y").alias("y"))
    over = covering(starts, edges, CELL_M).select(*KEY, "obstacle_id", F.lit(0.0).alias("inside_m"))
    return met.unionByName(over).groupBy(*KEY, "obstacle_id").agg(F.sum("inside_m").alias("inside_m"))


def distance_text(px: str, py: str, o: str = "o", f: str = "f") -> str:
    """SQL of how far along the drift a place lies behind the leg from o to f; null if it lies before it.

    That is where a ray from the place against the drift first meets the leg; if it doesn't, the part along the drift
    of the way from the leg's nearest point.
    """
    ahead, left = (lambda x, y: f"(({x}) * h_x + ({y}) * h_y)"), (lambda x, y: f"(h_x * ({y}) - h_y * ({x}))")
    d = lambda x, y: (f"({x}) - {o}_x", f"({y}) - {o}_y")
    xp, cp = ahead(*d(px, py)), left(*d(px, py))
    x1, c1 = ahead(*d(f"{f}_x", f"{f}_y")), left(*d(f"{f}_x", f"{f}_y"))
    share = f"({cp} / (CASE WHEN abs({c1}) > 1e-6 THEN {c1} ELSE 1e0 END))"
    across = f"({xp} - {share} * {x1})"
    nearest = f"({xp} - greatest(0e0, least(1e0, ({xp} * {x1} + {cp} * {c1}) / ({x1} * {x1} + {c1} * {c1}))) * {x1})"
    return f"""(CASE WHEN abs({c1}) > 1e-6 AND {share} BETWEEN 0e0 AND 1e0 AND {across} >= 0e0 THEN {across}
        WHEN abs({c1}) <= 1e-6 AND abs({cp}) <= 1e-6 AND {xp} >= least(0e0, {x1}) THEN {xp} - least({xp}, greatest(0e0, {x1}))
        WHEN {nearest} >= 0e0 THEN {nearest} END)"""


WIDTH = "greatest(1e0, greatest(2e0 * radius_m, abs(h_x * (f_y - o_y) - h_y * (f_x - o_x))))"


def target_hits(legs: DataFrame, lateral: DataFrame, reach: DataFrame, edges: DataFrame, ships: DataFrame, spread: float = ENGINE_SPREAD, from_mean: bool = False) -> DataFrame:
    """Per leg, directions and ship the targets in its corridor: role, obstacle_id, distance_m and coverage_percent.

    ships: scenario_id, ship_id, draught_m, anchor_draughts, height_m.  A depth less than the draught is a grounding,
    one less than anchor_draughts draughts an anchoring, an object is a structure; where ships have a height, only
    those not higher.  distance_m is the least over the target's corners, from the leg itself or, with from_mean, from
    the leg moved by the mean; a target before the leg is no hit.  coverage_percent is the length of its edges in the
    corridor by the corridor's width, 100 at most.  The geometry is worked out once for all ships.
    """
    at = bands(legs, lateral, reach, spread, 1.0)
    own, copies = shapes(edges)
    o, f = ("s", "e") if from_mean else ("o", "f")
    corners = _overlaps(at, own).join(at, KEY).join(own.select("scenario_id", "obstacle_id", F.col("a_x").alias("v_x"), F.col("a_y").alias("v_y")), ["scenario_id", "obstacle_id"])
    hits = corners.groupBy(*KEY, "obstacle_id", "inside_m").agg(F.min(F.expr(distance_text("v_x", "v_y", o, f))).alias("distance_m"), F.first(F.expr(WIDTH)).alias("width_m")).where("distance_m is not null")
    what = edges.select("scenario_id", "obstacle_id", "kind", "value_m").distinct()
    hits = with_copies(hits, copies).join(what, ["scenario_id", "obstacle_id"])
    hits = hits.withColumn("coverage_percent", F.least(F.lit(100.0), F.col("inside_m") / F.col("width_m") * 100.0))
    is_depth = F.col("kind") == "depth"
    roles = F.array_compact(
        F.array(
            F.when(is_depth & (F.col("value_m") < F.col("draught_m")), F.lit("grounding")),
            F.when(is_depth & (F.col("value_m") < F.col("draught_m") * F.col("anchor_draughts")), F.lit("anchoring")),
            F.when(~is_depth & (F.col("height_m").isNull() | (F.col("value_m") <= F.col("height_m"))), F.lit("structure")),
        )
    )
    return hits.join(ships, "scenario_id").select(*KEY, "ship_id", F.explode(roles).alias("role"), "obstacle_id", "distance_m", "coverage_percent")


# ---- the cascade's corridor: two rectangles ---------------------------------------------------------------------


def clip_texts(planes: list[tuple[str, str, str]]) -> tuple[str, str]:
    """As inside_texts, for few half-planes given as SQL, of an edge from (ua, wa) to (ub, wb)."""
    lows, highs = ["0e0"], ["1e0"]
    for nx, ny, c in planes:
        da, db = (f"({nx} * u{e} + {ny} * w{e} - {c})" for e in "ab")
        lows.append(f"CASE WHEN {da} > 0e0 THEN CASE WHEN {db} <= 0e0 THEN {da} / ({da} - {db}) ELSE 2e0 END ELSE 0e0 END")
        highs.append(f"CASE WHEN {da} <= 0e0 AND {db} > 0e0 THEN {da} / ({da} - {db}) ELSE 1e0 END")
    return f"greatest({', '.join(lows)})", f"least({', '.join(highs)})"


def rectangle_texts() -> tuple[str, str]:
    """SQL of whether the leg's rectangle and the drifted one overlap, and of the share of an edge in the corridor.

    In the leg's frame the first is 0 <= u <= len, |w| <= radius_m and the second lies (du, dw) off.  If they overlap
    the corridor is their union, so what lies in both counts once; if not, it is the hull of both.
    """
    box = lambda u0, u1, w0, w1: [("1e0", "0e0", u1), ("(-1e0)", "0e0", f"(-({u0}))"), ("0e0", "1e0", w1), ("0e0", "(-1e0)", f"(-({w0}))")]
    first, second = box("0e0", "len", "(-radius_m)", "radius_m"), box("du", "(len + du)", "(dw - radius_m)", "(dw + radius_m)")
    both = box("greatest(0e0, du)", "least(len, len + du)", "greatest(-radius_m, dw - radius_m)", "least(radius_m, dw + radius_m)")
    hull = box("least(0e0, du)", "(len + greatest(0e0, du))", "(least(0e0, dw) - radius_m)", "(greatest(0e0, dw) + radius_m)")
    for sign in ("", "-"):
        nx, ny = f"({sign}dw)", f"({'-' if not sign else ''}du)"
        hull.append((nx, ny, f"(greatest(0e0, {nx} * len) + abs({ny}) * radius_m)"))
    part = lambda planes: "greatest(0e0, {1} - {0})".format(*clip_texts(planes))
    touching = "(abs(du) <= len AND abs(dw) <= 2e0 * radius_m)"
    return touching, f"(CASE WHEN {touching} THEN {part(first)} + {part(second)} - {part(both)} ELSE {part(hull)} END)"


def corridor_lengths(at: DataFrame, edges: DataFrame) -> DataFrame:
    """near() with inside_m, the length of each edge in the corridor of the leg's and the drifted rectangle; those without go."""
    met = near(at, edges).withColumn("du", F.expr("g_x * l_x + g_y * l_y")).withColumn("dw", F.expr("l_x * g_y - l_y * g_x"))
    for e in "ab":
        met = met.withColumn(f"u{e}", F.expr(f"({e}_x - s_x) * l_x + ({e}_y - s_y) * l_y")).withColumn(f"w{e}", F.expr(f"l_x * ({e}_y - s_y) - l_y * ({e}_x - s_x)"))
    return met.withColumn("inside_m", F.expr(f"{rectangle_texts()[1]} * sqrt(pow(b_x - a_x, 2e0) + pow(b_y - a_y, 2e0))")).where("inside_m > 0")


# ---- weighted coverage ------------------------------------------------------------------------------------------


def clipped_ring(ring: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Corners of a ring cut to half-planes (rows nx, ny, c), one after the other; where it falls into parts they stay joined by edges of no width."""
    for nx, ny, c in planes:
        if not len(ring):
            break
        d = ring @ (nx, ny) - c
        if (d <= 0).all():  # nothing to cut, as for most half-planes
            continue
        out = []
        for p, q, dp, dq in zip(ring, np.roll(ring, -1, axis=0), d, np.roll(d, -1)):
            if dp <= 0:
                out.append(p)
            if (dp < 0 < dq) or (dq < 0 < dp):
                out.append(p + dp / (dp - dq) * (q - p))
        ring = np.array(out).reshape(-1, 2)
    return ring


def _overlap_corners(frames):
    """Rows with planes and an obstacle's corners by ring: the corners of the overlap (each once) and its centroid."""
    for rows in frames:
        out = []
        for r in rows.itertuples(index=False):
            planes = np.array([(p["nx"], p["ny"], p["c"]) for p in r.planes])
            area, moment, corners = 0.0, np.zeros(2), []
            origin = np.array([r.s_x, r.s_y])
            shifted = planes - np.c_[np.zeros((len(planes), 2)), planes[:, :2] @ origin]
            for ring in r.rings:
                cut = clipped_ring(np.array([(p["x"], p["y"]) for p in sorted(ring["points"], key=lambda p: p["edge"])]) - origin, shifted)
                if len(cut) < 3:
                    continue
                to = np.roll(cut, -1, axis=0)
                cross = cut[:, 0] * to[:, 1] - to[:, 0] * cut[:, 1]
                area, moment = area + cross.sum() / 2, moment + ((cut + to) * cross[:, None]).sum(axis=0) / 6
                corners.append(cut)
            if abs(area) > 1e-9:
                at = moment / area + origin
                for x, y in np.unique(np.round(np.concatenate(corners), 6), axis=0) + origin:
                    out.append((r.scenario_id, r.leg_id, r.dir_idx, r.direction, r.obstacle_id, x, y, *at))
        yield pd.DataFrame(out, columns=[*KEY, "obstacle_id", "x", "y", "center_x", "center_y"])


def weighted_coverage(at: DataFrame, edges: DataFrame, mixture: DataFrame) -> DataFrame:
    """Per swept band and obstacle the coverage of the overlap: 100 times the mixture's density, summed over its corners.

    mixture: scenario_id, leg_id, dir_idx, kind (normal or uniform), p1, p2, weight; p1, p2 are mean and deviation, or
    low and high end.  Densities are taken at the corners' distances from the point of the line down the band's middle
    that is nearest to the overlap's centroid.  Every corner counts once.
    """
    edges, copies = shapes(edges)
    part = F.col("part") if "part" in edges.columns else F.lit(0)
    points = edges.withColumn("part", part).groupBy("scenario_id", "obstacle_id", "part").agg(F.collect_list(F.struct("edge", F.col("a_x").alias("x"), F.col("a_y").alias("y"))).alias("points"))
    rings = points.groupBy("scenario_id", "obstacle_id").agg(F.collect_list(F.struct("points")).alias("rings"))
    pairs = _overlaps(at, edges).select(*KEY, "obstacle_id").join(with_planes(at).select(*KEY, "s_x", "s_y", "planes"), KEY).join(rings, ["scenario_id", "obstacle_id"])
    corners = pairs.mapInPandas(_overlap_corners, "scenario_id long, leg_id long, dir_idx int, direction int, obstacle_id long, x double, y double, center_x double, center_y double").join(at, KEY)
    mx, my = "(s_x + e_x) / 2e0", "(s_y + e_y) / 2e0"
    along = f"greatest(0e0, least(reach_m, (center_x - {mx}) * h_x + (center_y - {my}) * h_y))"
    corners = corners.withColumn("d", F.expr(f"sqrt(pow(x - {mx} - {along} * h_x, 2e0) + pow(y - {my} - {along} * h_y, 2e0))"))
    whole = mixture.groupBy("scenario_id", "leg_id", "dir_idx").agg(F.sum("weight").alias("all_"))
    parts = mixture.join(whole, ["scenario_id", "leg_id", "dir_idx"]).withColumn("w", F.col("weight") / F.col("all_")).select("scenario_id", "leg_id", "dir_idx", F.col("kind").alias("form"), "p1", "p2", "w")
    density = F.expr("w * CASE WHEN form = 'uniform' THEN CASE WHEN d BETWEEN p1 AND p2 THEN 1e0 / (p2 - p1) ELSE 0e0 END ELSE exp(-pow((d - p1) / p2, 2e0) / 2e0) / (p2 * 25066282746310002e-16) END")
    covered = corners.join(parts, ["scenario_id", "leg_id", "dir_idx"]).groupBy(*KEY, "obstacle_id").agg((F.sum(density) * 100.0).alias("coverage"), F.min("d").alias("nearest_m"), F.countDistinct("x", "y").alias("corners"))
    return with_copies(covered, copies)


# ---- reach fans -------------------------------------------------------------------------------------------------


def fans(at: DataFrame, stops: DataFrame, anchors: DataFrame, rays: int = 100) -> DataFrame:
    """How far ships drift in each corridor, line by line along the drift: KEY, ray, width_m, start_m, end_m, stop_m, anchor_m.

    The band is the leg widened by radius_m across it; lines of equal distance cover its width across the drift.  A
    line starts where the band begins, and ends reach_m past where it ends (end_m), or at the first edge of a stop
    (stop_m).  From anchor_m on, where it meets the first edge of an anchor zone, ships can anchor.  What a line starts
    inside of holds from its start.  stops and anchors are edges; give merged contours of a threshold each.
    """
    lines = _band_lines(at, rays)
    spots = lines.withColumn("x", F.expr("o_x + start_m * h_x - c * h_y")).withColumn("y", F.expr("o_y + start_m * h_y + c * h_x")).select(*KEY, "ray", "x", "y")
    for name, edges in (("stop_m", stops), ("anchor_m", anchors)):
        met = _line_hits(lines, near(at, edges))
        inside = covering(spots, edges, CELL_M).select(*KEY, "ray", F.lit(float("-inf")).alias("t"))
        found = met.unionByName(inside).groupBy(*KEY, "ray").agg(F.min("t").alias(name))
        lines = lines.join(found, [*KEY, "ray"], "left")
    met = {c: F.when(F.col(c).isNotNull(), F.greatest(c, "start_m")) for c in ("stop_m", "anchor_m")}
    lines = lines.withColumns(met)
    anchor = F.when(F.col("anchor_m") < F.coalesce("stop_m", "end_m"), F.col("anchor_m"))
    return lines.select(*KEY, "ray", "width_m", "start_m", "end_m", "stop_m", anchor.alias("anchor_m"))


def _band_lines(at: DataFrame, rays: int) -> DataFrame:
    """Lines across the drift over the rectangle of a leg: c to the left of the leg's start, ahead from start_m to end_m."""
    rows = at.withColumn("x1", F.expr("(f_x - o_x) * h_x + (f_y - o_y) * h_y")).withColumn("c1", F.expr("h_x * (f_y - o_y) - h_y * (f_x - o_x)"))
    # The way across the leg, radius_m to both sides of the mean, in the drift's frame.
    rows = rows.withColumn("xw", F.expr("-l_y * h_x + l_x * h_y")).withColumn("cw", F.expr("h_x * l_x + h_y * l_y"))
    rows = rows.withColumn("half", F.expr("(abs(c1) + abs(cw) * 2e0 * radius_m) / 2e0")).withColumn("mid", F.expr("c1 / 2e0 + cw * mean_m"))
    rows = rows.where("half > 0").withColumn("ray", F.explode(F.sequence(F.lit(0), F.lit(rays - 1)))).withColumn("width_m", F.expr(f"2e0 * half / {X.num(rays)}"))
    rows = rows.withColumn("c", F.expr("mid - half + (ray + 5e-1) * width_m"))
    # On a line f * c1 + w * cw = c, and x = f * x1 + w * xw, for f in [0, 1] and w within radius_m of the mean.
    low, high = "(mean_m - radius_m)", "(mean_m + radius_m)"
    f = lambda w: f"((c - {w} * cw) / c1)"
    clipped = lambda w: f"greatest(0e0, least(1e0, {f(w)}))"
    slanted = [F.expr(f"{g} * x1 + (CASE WHEN abs(cw) > 1e-9 THEN (c - {g} * c1) / cw ELSE {w} END) * xw") for w in (low, high) for g in (clipped(w),)]
    straight = [F.expr(f"{g} * x1 + c / cw * xw") for g in ("0e0", "1e0")]  # the leg lies along the drift
    ends = [F.when(F.abs("c1") > 1e-9, s).otherwise(p) for s, p in zip(slanted, straight)]
    return rows.withColumn("start_m", F.least(*ends)).withColumn("end_m", F.greatest(*ends) + F.col("reach_m")).select(*KEY, "ray", "c", "width_m", "start_m", "end_m", "o_x", "o_y", "h_x", "h_y")


def _line_hits(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """Where lines meet edges ahead of their start: an edge makes only the lines inside its own width."""
    frame = lines.groupBy(*KEY).agg(F.min("c").alias("first_c"), F.max("ray").alias("last"), F.first("width_m").alias("width_m"))
    p = pairs
    for e in "ab":
        p = p.withColumn(f"x{e}", F.expr(f"({e}_x - o_x) * h_x + ({e}_y - o_y) * h_y")).withColumn(f"c{e}", F.expr(f"h_x * ({e}_y - o_y) - h_y * ({e}_x - o_x)"))
    p = p.where("ca <> cb").select(*KEY, "xa", "ca", "xb", "cb").join(frame, KEY)
    first = F.greatest(F.lit(0), F.ceil((F.least("ca", "cb") - F.col("first_c")) / F.col("width_m")).cast("int") - 1)
    last = F.least(F.col("last"), F.floor((F.greatest("ca", "cb") - F.col("first_c")) / F.col("width_m")).cast("int") + 1)
    p = p.withColumn("from_", first).withColumn("to_", last).where("from_ <= to_").withColumn("ray", F.explode(F.sequence("from_", "to_"))).select(*KEY, "ray", "xa", "ca", "xb", "cb")
    met = p.join(lines.select(*KEY, "ray", "c", "start_m", "end_m"), [*KEY, "ray"]).where("least(ca, cb) <= c and greatest(ca, cb) > c")
    return met.withColumn("t", F.expr("xa + (c - ca) / (cb - ca) * (xb - xa)")).where("t >= start_m and t <= end_m").select(*KEY, "ray", "t")


def fan_areas(lines: DataFrame) -> DataFrame:
    """Per leg and directions: area_m2 that ships reach, the part of it where they can anchor, and blocked, the share of the corridor that they don't reach."""
    to = F.coalesce("stop_m", "end_m")
    whole, reached = (F.sum((x - F.col("start_m")) * F.col("width_m")) for x in (F.col("end_m"), to))
    anchorable = F.sum(F.when(F.col("anchor_m").isNotNull(), (to - F.col("anchor_m")) * F.col("width_m")).otherwise(0.0))
    return lines.groupBy(*KEY).agg(reached.alias("area_m2"), anchorable.alias("anchorable_m2"), (1 - reached / whole).alias("blocked"))


def exposure(drift_deg: Column, a_x: Column, a_y: Column, b_x: Column, b_y: Column) -> Column:
    """How squarely a drift meets an edge that runs counter-clockwise: cosine to the reverse of its outer normal, 0 from behind."""
    normal = F.degrees(F.atan2(b_y - a_y, a_x - b_x))  # bearing of (b_y - a_y, a_x - b_x)
    return F.greatest(F.cos(F.radians(drift_deg - normal - 180.0)), F.lit(0.0))
