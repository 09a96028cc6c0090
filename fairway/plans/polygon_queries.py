"""Queries of merged contours, drift corridors, what they meet, and how far ships get in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairway.functions import expr as X
from fairway.operators import cascade as K
from fairway.operators import corridors as V
from fairway.operators import drifting as D
from fairway.operators import polygons as G
from fairway.operators import projection as U
from fairway.operators import repair as H

from .adapters import oracle, view
from .risk_queries import _EDGES, _ROSE, _XY, _drift_inputs, _scenario_cells

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---- merged contours --------------------------------------------------------------------------------------------

#: Boxes on a lattice of 100 m, 60 to 160 m wide, so that neighbours touch, overlap or lie apart and copies nest.
_BOXES = """SELECT CAST(p_partkey % 3 AS BIGINT) AS scenario_id, CAST(p_partkey AS BIGINT) AS obstacle_id, CAST(p_size % 6 * 3 AS DOUBLE) AS value_m, CAST(1e2 * (p_partkey % 37) AS DOUBLE) AS x0, CAST(1e2 * (p_partkey % 29) AS DOUBLE) AS y0,
    CAST(1e2 * (p_partkey % 37) + 6e1 + 2e1 * (p_partkey % 6) AS DOUBLE) AS x1, CAST(1e2 * (p_partkey % 29) + 6e1 + 2e1 * (p_partkey % 5) AS DOUBLE) AS y1 FROM {part}"""


def _box_rows(spark, sf_dir):
    corner = lambda *c: F.struct(*[F.col(v).alias(n) for v, n in zip(c, ("a_x", "a_y", "b_x", "b_y"))])
    boxes = spark.sql(_BOXES, part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    rows = boxes.select("scenario_id", "obstacle_id", "value_m", F.posexplode(F.array(corner("x0", "y0", "x1", "y0"), corner("x1", "y0", "x1", "y1"), corner("x1", "y1", "x0", "y1"), corner("x0", "y1", "x0", "y0"))).alias("edge", "e"))
    return rows.select("scenario_id", "obstacle_id", F.lit(0).alias("part"), "edge", "value_m", "e.*")


#: The same by squares of 20 m: each has the least depth that covers it; sides between covered and open squares are the contour.
_SQUARES = f"""WITH b AS ({_BOXES.format(part='part')}), s AS (SELECT scenario_id, value_m, unnest(range(CAST(x0 / 20 AS BIGINT), CAST(x1 / 20 AS BIGINT))) AS i, y0, y1 FROM b),
c AS (SELECT scenario_id, i, j, min(value_m) AS d FROM (SELECT scenario_id, value_m, i, unnest(range(CAST(y0 / 20 AS BIGINT), CAST(y1 / 20 AS BIGINT))) AS j FROM s) GROUP BY 1, 2, 3),
v AS (SELECT DISTINCT scenario_id, value_m AS boundary_m FROM b), o AS (SELECT c.*, boundary_m FROM c JOIN v ON v.scenario_id = c.scenario_id AND d <= boundary_m),
n(di, dj) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)),
f AS (SELECT scenario_id, boundary_m, sum(CASE WHEN coalesce(e.d, 1e9) > boundary_m THEN 1 ELSE 0 END) AS sides FROM (SELECT o.scenario_id, o.boundary_m, o.i + di AS i, o.j + dj AS j FROM o CROSS JOIN n) q LEFT JOIN c e USING (scenario_id, i, j) GROUP BY 1, 2)
SELECT scenario_id, boundary_m, CAST(count(*) * 400 AS DOUBLE) AS area_m2, CAST(any_value(sides) * 20 AS DOUBLE) AS length_m FROM o JOIN f USING (scenario_id, boundary_m) GROUP BY 1, 2"""


@query("drf_merged_contours", _SQUARES)
def merged_contours(spark, sf_dir):
    table = G.contour_table(G.merged_contours(_box_rows(spark, sf_dir), 200.0))
    return table.select("scenario_id", "boundary_m", F.round("area_m2", 3).alias("area_m2"), F.round("length_m", 3).alias("length_m"))


# ---- bands and what they meet -----------------------------------------------------------------------------------

#: Reach by repair time, as all legs are long against it.
REACH = D.reach_m(100_000.0)
_SHIFTED = lambda shift: (("ax", shift[0], "a_x"), ("ay", shift[1], "a_y"), ("bx", shift[0], "b_x"), ("bby", shift[1], "b_y"))
_AS_THEY_ARE = lambda shift: ", ".join(f"{c} + {X.num(m)} AS {n}" for c, m, n in _SHIFTED(shift))
#: Corners of depths snapped as those of merged contours are.
_SNAPPED = lambda shift: ", ".join(f"CASE WHEN kind = 'depth' THEN round({c} + {X.num(m)}, {G.DECIMALS}) ELSE {c} + {X.num(m)} END AS {n}" for c, m, n in _SHIFTED(shift))
_MOVED = lambda spread, least, shift=(0.0, 0.0), eg=_AS_THEY_ARE: f"""WITH {_EDGES}, pr AS (SELECT leg_id, {_XY('lon1', 'lat1')[0]} AS o_x, {_XY('lon1', 'lat1')[1]} AS o_y, {_XY('lon2', 'lat2')[0]} AS f_x, {_XY('lon2', 'lat2')[1]} AS f_y FROM legs),
un AS (SELECT *, sqrt(pow(f_x - o_x, 2e0) + pow(f_y - o_y, 2e0)) AS len FROM pr), ul AS (SELECT *, (f_x - o_x) / len AS l_x, (f_y - o_y) / len AS l_y FROM un),
bd AS (SELECT *, sin(radians(direction * 45e0)) AS h_x, cos(radians(direction * 45e0)) AS h_y, {X.num(REACH)} AS reach_m, greatest({X.num(least)}, {X.num(spread)} * std_m) AS radius_m,
  o_x - mean_m * l_y AS s_x, o_y + mean_m * l_x AS s_y, f_x - mean_m * l_y AS e_x, f_y + mean_m * l_x AS e_y FROM ul JOIN leg_lateral USING (leg_id) CROSS JOIN (SELECT CAST(range AS INTEGER) AS direction FROM range(8))),
bg AS (SELECT *, reach_m * h_x AS g_x, reach_m * h_y AS g_y FROM bd),
bp AS (SELECT *, [{', '.join(f"{{'nx': {nx}, 'ny': {ny}, 'c': {c}}}" for nx, ny, c in V.plane_texts())}] AS planes FROM bg),
eg AS (SELECT obstacle_id, kind, value_m, {eg(shift)} FROM ed),
nb AS (SELECT bp.*, obstacle_id, kind, value_m, a_x, a_y, b_x, b_y FROM bp JOIN eg ON greatest(a_x, b_x) >= least(s_x, e_x) + least(0, g_x) - radius_m AND least(a_x, b_x) <= greatest(s_x, e_x) + greatest(0, g_x) + radius_m
  AND greatest(a_y, b_y) >= least(s_y, e_y) + least(0, g_y) - radius_m AND least(a_y, b_y) <= greatest(s_y, e_y) + greatest(0, g_y) + radius_m)"""  # noqa: E731
_IN = V.inside_texts(arrow="lambda p:", most="list_max", least="list_min", each="list_transform")
_HELD = """ov AS (SELECT leg_id, dir_idx, direction, obstacle_id, sum(inside_m) AS inside_m FROM (SELECT leg_id, dir_idx, direction, obstacle_id, (t1 - t0) * sqrt(pow(b_x - a_x, 2e0) + pow(b_y - a_y, 2e0)) AS inside_m FROM (SELECT *, {t0} AS t0, {t1} AS t1 FROM nb) WHERE t0 < t1
  UNION ALL SELECT leg_id, dir_idx, direction, obstacle_id, 0e0 FROM (SELECT leg_id, dir_idx, direction, obstacle_id, s_x, s_y, min(a_x) AS x0, max(a_x) AS x1, min(a_y) AS y0, max(a_y) AS y1 FROM bg CROSS JOIN eg GROUP BY ALL) WHERE s_x > x0 AND s_x < x1 AND s_y > y0 AND s_y < y1) GROUP BY 1, 2, 3, 4)""".format(t0=_IN[0], t1=_IN[1])
_VIEWS = ("legs", "leg_lateral", "obstacles")


def _bands(spark, sf_dir, spread=V.BAND_SPREAD, least=0.0):
    legs, lateral, edges, reach = _drift_inputs(spark, sf_dir)
    return V.bands(legs, lateral, reach.withColumn("reach_m", F.lit(REACH)), spread, least), edges


_SUPPORT = lambda v: f"radius_m * abs(cos(atan2({v}_x, {v}_y) - round(atan2({v}_x, {v}_y) / {X.num(0.19634954084936207)}) * {X.num(0.19634954084936207)}))"


@query("drf_bands", oracle(_MOVED(V.BAND_SPREAD, 0.0) + f" SELECT leg_id, dir_idx, direction, round((len * reach_m * abs(l_x * h_y - l_y * h_x) + 16e0 * radius_m * radius_m * sin({X.num(0.19634954084936207)}) + 2e0 * len * {_SUPPORT('l')} + 2e0 * reach_m * {_SUPPORT('h')}) / 1e6, 5) AS area_km2 FROM bg", *_VIEWS))
def band_areas(spark, sf_dir):
    """Area of each swept band, from its corners; the SQL has it as that of a parallelogram and a disc's polygon together."""
    at, _ = _bands(spark, sf_dir)
    corners = V.corners_of(at).groupBy(*V.KEY).agg(F.sort_array(F.collect_list(F.struct("place", "x", "y"))).alias("ps"))
    cross = "aggregate(transform(ps, (p, i) -> struct(p, ps[(i + 1) % size(ps)] AS q)), 0e0, (s, e) -> s + ((e.p.x - ps[0].x) * (e.q.y - ps[0].y) - (e.q.x - ps[0].x) * (e.p.y - ps[0].y)) / 2e0)"
    return corners.select("leg_id", "dir_idx", "direction", F.round(F.expr(cross) / 1e6, 5).alias("area_km2"))


@query("drf_overlaps", oracle(_MOVED(V.BAND_SPREAD, 0.0) + f", {_HELD} SELECT leg_id, dir_idx, direction, obstacle_id, round(inside_m, 2) AS inside_m FROM ov", *_VIEWS))
def overlap_rows(spark, sf_dir):
    return V.overlaps(*_bands(spark, sf_dir)).select("leg_id", "dir_idx", "direction", "obstacle_id", F.round("inside_m", 2).alias("inside_m"))


_SHIPS = "SELECT DISTINCT CAST(0 AS BIGINT) AS scenario_id, CAST(ship_type AS BIGINT) AS ship_id, CAST(2 + ship_type % 7 AS DOUBLE) AS draught_m, 15e-1 AS anchor_draughts, CASE WHEN ship_type % 3 > 0 THEN CAST(5 + ship_type AS DOUBLE) END AS height_m FROM traffic_cells"


@query("drf_target_hits", oracle(_MOVED(V.ENGINE_SPREAD, 1.0) + f""", {_HELD}, sh AS ({_SHIPS}),
cr AS (SELECT leg_id, dir_idx, direction, obstacle_id, kind, value_m, inside_m, min({V.distance_text('a_x', 'a_y')}) AS distance_m, any_value({V.WIDTH}) AS width_m FROM ov JOIN bg USING (leg_id, dir_idx, direction) JOIN eg USING (obstacle_id) GROUP BY 1, 2, 3, 4, 5, 6, 7),
ro AS (SELECT *, unnest([CASE WHEN kind = 'depth' AND value_m < draught_m THEN 'grounding' END, CASE WHEN kind = 'depth' AND value_m < draught_m * anchor_draughts THEN 'anchoring' END, CASE WHEN kind <> 'depth' AND (height_m IS NULL OR value_m <= height_m) THEN 'structure' END]) AS role FROM cr CROSS JOIN sh WHERE distance_m IS NOT NULL)
SELECT leg_id, direction, ship_id, role, count(*) AS targets, round(min(distance_m), 2) AS nearest_m, round(sum(least(1e2, inside_m / width_m * 1e2)), 3) AS coverage_percent FROM ro WHERE role IS NOT NULL GROUP BY 1, 2, 3, 4""", *_VIEWS, "traffic_cells"))
def target_rows(spark, sf_dir):
    """Targets of each ship by leg and direction: how many, the nearest and their coverage together."""
    legs, lateral, edges, reach = _drift_inputs(spark, sf_dir)
    ships = spark.sql(_SHIPS.replace("traffic_cells", "{cells}"), cells=view(spark, sf_dir, "traffic_cells"))
    own, copies = G.shapes(edges, "kind", "value_m")
    alike = copies.groupBy("scenario_id", "obstacle_id").agg(F.count("*").alias("n"))
    hits = V.target_hits(legs, lateral, reach.withColumn("reach_m", F.lit(REACH)), own, ships).join(alike, ["scenario_id", "obstacle_id"])
    return hits.groupBy("leg_id", "direction", "ship_id", "role").agg(F.sum("n").alias("targets"), F.round(F.min("distance_m"), 2).alias("nearest_m"), F.round(F.sum(F.col("coverage_percent") * F.col("n")), 3).alias("coverage_percent"))


_SHARE = V.rectangle_texts()[1]


@query("drf_corridor_lengths", oracle(_MOVED(5.0, 0.0) + f""", uw AS (SELECT *, g_x * l_x + g_y * l_y AS du, l_x * g_y - l_y * g_x AS dw, (a_x - s_x) * l_x + (a_y - s_y) * l_y AS ua, l_x * (a_y - s_y) - l_y * (a_x - s_x) AS wa, (b_x - s_x) * l_x + (b_y - s_y) * l_y AS ub, l_x * (b_y - s_y) - l_y * (b_x - s_x) AS wb FROM nb)
SELECT leg_id, dir_idx, direction, obstacle_id, round(sum(inside_m), 2) AS inside_m FROM (SELECT *, {_SHARE} * sqrt(pow(b_x - a_x, 2e0) + pow(b_y - a_y, 2e0)) AS inside_m FROM uw) WHERE inside_m > 0 GROUP BY 1, 2, 3, 4""", *_VIEWS))
def corridor_rows(spark, sf_dir):
    at, edges = _bands(spark, sf_dir, 5.0)
    own, copies = G.shapes(edges)
    found = V.corridor_lengths(at, own).groupBy(*V.KEY, "obstacle_id").agg(F.round(F.sum("inside_m"), 2).alias("inside_m"))
    return G.with_copies(found, copies).drop("scenario_id")


_MIXTURE = "SELECT CAST(0 AS BIGINT) AS scenario_id, leg_id, dir_idx, k.kind, CASE WHEN k.kind = 'normal' THEN mean_m ELSE 0e0 END AS p1, CASE WHEN k.kind = 'normal' THEN std_m ELSE 4e3 END AS p2, k.weight FROM leg_lateral CROSS JOIN (SELECT 'normal' AS kind, 3e0 AS weight UNION ALL SELECT 'uniform', 1e0) k"
#: Both are convex here, so the overlap's corners in order of their angle around its middle are its outline.
_COVERED = f""", {_HELD}, mi AS ({_MIXTURE}),
pk AS (SELECT leg_id, dir_idx, direction, list_sort(list_transform(planes, lambda p: {{'a': atan2(p.ny, p.nx), 'nx': p.nx, 'ny': p.ny, 'c': p.c}})) AS ps FROM bp),
pq AS (SELECT leg_id, dir_idx, direction, ps[i] AS p, ps[i % len(ps) + 1] AS q FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM pk)),
cn AS (SELECT leg_id, dir_idx, direction, (p.c * q.ny - q.c * p.ny) / (p.nx * q.ny - p.ny * q.nx) AS x, (p.nx * q.c - q.nx * p.c) / (p.nx * q.ny - p.ny * q.nx) AS y FROM pq WHERE abs(p.nx * q.ny - p.ny * q.nx) > 1e-9),
bx AS (SELECT obstacle_id, min(a_x) AS x0, max(a_x) AS x1, min(a_y) AS y0, max(a_y) AS y1 FROM eg GROUP BY 1),
ic AS (SELECT *, {_IN[0]} AS t0, {_IN[1]} AS t1 FROM nb),
vx AS (SELECT leg_id, dir_idx, direction, obstacle_id, a_x + t0 * (b_x - a_x) AS x, a_y + t0 * (b_y - a_y) AS y FROM ic WHERE t0 < t1 UNION ALL SELECT leg_id, dir_idx, direction, obstacle_id, a_x + t1 * (b_x - a_x), a_y + t1 * (b_y - a_y) FROM ic WHERE t0 < t1
  UNION ALL SELECT leg_id, dir_idx, direction, obstacle_id, x, y FROM cn JOIN ov USING (leg_id, dir_idx, direction) JOIN bx USING (obstacle_id) WHERE x > x0 AND x < x1 AND y > y0 AND y < y1),
ux AS (SELECT leg_id, dir_idx, direction, obstacle_id, round(x, 5) AS x, round(y, 5) AS y FROM vx GROUP BY ALL),
mx AS (SELECT *, avg(x) OVER w AS gx, avg(y) OVER w AS gy FROM ux WINDOW w AS (PARTITION BY leg_id, dir_idx, direction, obstacle_id)),
ag AS (SELECT *, x - gx AS dx, y - gy AS dy, row_number() OVER (PARTITION BY leg_id, dir_idx, direction, obstacle_id ORDER BY atan2(y - gy, x - gx)) AS k, count(*) OVER (PARTITION BY leg_id, dir_idx, direction, obstacle_id) AS n FROM mx),
ar AS (SELECT leg_id, dir_idx, direction, obstacle_id, any_value(p.gx) AS gx, any_value(p.gy) AS gy, sum(p.dx * q.dy - q.dx * p.dy) / 2 AS area, sum((p.dx + q.dx) * (p.dx * q.dy - q.dx * p.dy)) / 6 AS sx, sum((p.dy + q.dy) * (p.dx * q.dy - q.dx * p.dy)) / 6 AS sy
  FROM ag p JOIN ag q USING (leg_id, dir_idx, direction, obstacle_id) WHERE q.k = p.k % p.n + 1 GROUP BY 1, 2, 3, 4),
ct AS (SELECT leg_id, dir_idx, direction, obstacle_id, gx + sx / area AS center_x, gy + sy / area AS center_y FROM ar WHERE area > 1e-9),
al AS (SELECT ct.*, (s_x + e_x) / 2 + h_x * greatest(0, least(reach_m, (center_x - (s_x + e_x) / 2) * h_x + (center_y - (s_y + e_y) / 2) * h_y)) AS px, (s_y + e_y) / 2 + h_y * greatest(0, least(reach_m, (center_x - (s_x + e_x) / 2) * h_x + (center_y - (s_y + e_y) / 2) * h_y)) AS py FROM ct JOIN bg USING (leg_id, dir_idx, direction)),
ds AS (SELECT leg_id, dir_idx, direction, obstacle_id, sqrt(pow(x - px, 2e0) + pow(y - py, 2e0)) AS d FROM ux JOIN al USING (leg_id, dir_idx, direction, obstacle_id))
SELECT leg_id, dir_idx, direction, obstacle_id, round(sum(weight / 4e0 * CASE WHEN mi.kind = 'uniform' THEN CASE WHEN d BETWEEN p1 AND p2 THEN 1e0 / (p2 - p1) ELSE 0e0 END ELSE exp(-pow((d - p1) / p2, 2e0) / 2e0) / (p2 * 25066282746310002e-16) END) * 1e2, 5) AS coverage, round(min(d), 1) AS nearest_m, CAST(count(*) / 2 AS BIGINT) AS corners
FROM ds JOIN mi USING (leg_id, dir_idx) GROUP BY 1, 2, 3, 4"""


@query("drf_weighted_coverage", oracle(_MOVED(V.BAND_SPREAD, 0.0) + _COVERED, *_VIEWS))
def covered_rows(spark, sf_dir):
    at, edges = _bands(spark, sf_dir)
    mixture = spark.sql(_MIXTURE.replace("leg_lateral", "{lateral}"), lateral=view(spark, sf_dir, "leg_lateral"))
    found = V.weighted_coverage(at, edges, mixture)
    return found.select("leg_id", "dir_idx", "direction", "obstacle_id", F.round("coverage", 5).alias("coverage"), F.round("nearest_m", 1).alias("nearest_m"), "corners")


# ---- fans -------------------------------------------------------------------------------------------------------

GROUND_M, ANCHOR_M, RAYS = 10.0, 20.0, 64
#: Off the lattice of the legs, so that no line runs along a side or starts on one.
SHIFT = (7.3, 11.1)
_FANS = f""", ln AS (SELECT *, (f_x - o_x) * h_x + (f_y - o_y) * h_y AS x1, h_x * (f_y - o_y) - h_y * (f_x - o_x) AS c1, -l_y * h_x + l_x * h_y AS xw, h_x * l_x + h_y * l_y AS cw FROM bg),
lh AS (SELECT *, (abs(c1) + abs(cw) * 2 * radius_m) / {RAYS} AS width_m, c1 / 2 + cw * mean_m - (abs(c1) + abs(cw) * 2 * radius_m) / 2 AS c0 FROM ln),
lr AS (SELECT *, c0 + (ray + 5e-1) * width_m AS c FROM lh CROSS JOIN (SELECT range AS ray FROM range({RAYS}))),
lq AS (SELECT *, unnest([{{'x': 0, 'w': mean_m - radius_m}}, {{'x': 0, 'w': mean_m + radius_m}}, {{'x': 1, 'w': mean_m + radius_m}}, {{'x': 1, 'w': mean_m - radius_m}}]) AS p, unnest([{{'x': 0, 'w': mean_m + radius_m}}, {{'x': 1, 'w': mean_m + radius_m}}, {{'x': 1, 'w': mean_m - radius_m}}, {{'x': 0, 'w': mean_m - radius_m}}]) AS q FROM lr),
lk AS (SELECT *, p.x * c1 + p.w * cw AS pc, p.x * x1 + p.w * xw AS px, q.x * c1 + q.w * cw AS qc, q.x * x1 + q.w * xw AS qx FROM lq),
st AS (SELECT leg_id, dir_idx, direction, ray, c, width_m, min(px + (c - pc) / (qc - pc) * (qx - px)) AS start_m, max(px + (c - pc) / (qc - pc) * (qx - px)) + {X.num(REACH)} AS end_m FROM lk WHERE least(pc, qc) <= c AND greatest(pc, qc) > c GROUP BY 1, 2, 3, 4, 5, 6),
le AS (SELECT leg_id, dir_idx, direction, kind, value_m, (a_x - o_x) * h_x + (a_y - o_y) * h_y AS xa, h_x * (a_y - o_y) - h_y * (a_x - o_x) AS ca, (b_x - o_x) * h_x + (b_y - o_y) * h_y AS xb, h_x * (b_y - o_y) - h_y * (b_x - o_x) AS cb FROM bg CROSS JOIN eg WHERE kind = 'object' OR value_m <= {X.num(ANCHOR_M)}),
ht AS (SELECT st.*, kind, value_m, xa + (c - ca) / (cb - ca) * (xb - xa) AS t FROM st JOIN le USING (leg_id, dir_idx, direction) WHERE least(ca, cb) <= c AND greatest(ca, cb) > c),
op AS (SELECT leg_id, dir_idx, direction, ray, min(CASE WHEN kind = 'object' OR value_m <= {X.num(GROUND_M)} THEN greatest(lo, start_m) END) AS stop_m, min(CASE WHEN kind = 'depth' THEN greatest(lo, start_m) END) AS anchor_m
  FROM (SELECT leg_id, dir_idx, direction, ray, start_m, end_m, kind, value_m, CASE WHEN t >= start_m THEN t END AS lo FROM ht WHERE t >= start_m AND t <= end_m) GROUP BY 1, 2, 3, 4),
ins AS (SELECT leg_id, dir_idx, direction, ray, max(CASE WHEN kind = 'object' OR value_m <= {X.num(GROUND_M)} THEN 1 END) AS s, max(CASE WHEN kind = 'depth' THEN 1 END) AS a
  FROM (SELECT leg_id, dir_idx, direction, ray, kind, value_m, o_x + start_m * h_x - c * h_y AS x, o_y + start_m * h_y + c * h_x AS y, x0, xx1, y0, y1 FROM st JOIN bg USING (leg_id, dir_idx, direction) CROSS JOIN (SELECT obstacle_id, kind, value_m, min(a_x) AS x0, max(a_x) AS xx1, min(a_y) AS y0, max(a_y) AS y1 FROM eg WHERE kind = 'object' OR value_m <= {X.num(ANCHOR_M)} GROUP BY 1, 2, 3)) WHERE x > x0 AND x < xx1 AND y > y0 AND y < y1 GROUP BY 1, 2, 3, 4),
al AS (SELECT st.*, CASE WHEN s = 1 THEN start_m ELSE stop_m END AS stop_m, CASE WHEN a = 1 THEN start_m ELSE anchor_m END AS anchor_m FROM st LEFT JOIN op USING (leg_id, dir_idx, direction, ray) LEFT JOIN ins USING (leg_id, dir_idx, direction, ray)),
rc AS (SELECT *, coalesce(least(stop_m, end_m), end_m) AS upto FROM al)
SELECT leg_id, dir_idx, direction, round(sum((upto - start_m) * width_m) / 1e6, 4) AS area_km2, round(sum(CASE WHEN anchor_m < upto THEN (upto - anchor_m) * width_m ELSE 0 END) / 1e6, 4) AS anchorable_km2, round(1 - sum((upto - start_m) * width_m) / sum((end_m - start_m) * width_m), 6) AS blocked FROM rc GROUP BY 1, 2, 3"""


@query("drf_fans", oracle(_MOVED(2.5758293035489004, 0.0, SHIFT, _SNAPPED) + _FANS, *_VIEWS))
def fan_rows(spark, sf_dir):
    """Reach of a ship of GROUND_M draught that anchors in ANCHOR_M, over merged contours; the SQL takes obstacles one by one."""
    at, edges = _bands(spark, sf_dir, 2.5758293035489004)  # 99 of 100 ships
    edges = edges.withColumns({c: F.col(c) + SHIFT[c.endswith("y")] for c in G.ENDS})
    depths = G.contour_pieces(edges.where("kind = 'depth'"), 5_000.0)
    # The contour of a threshold: pieces that begin at or before it and are not covered up to it.
    upto = lambda m: depths.where((F.col("from_m") <= m) & (F.col("until_m").isNull() | (F.col("until_m") > m))).select("scenario_id", F.lit(-1).cast("long").alias("obstacle_id"), F.lit("depth").alias("kind"), F.lit(m).alias("value_m"), F.xxhash64(*G.ENDS).alias("edge"), *G.ENDS)
    objects = G.shapes(edges.where("kind = 'object'"))[0].select("scenario_id", "obstacle_id", "kind", "value_m", F.col("edge").cast("long").alias("edge"), *G.ENDS)
    areas = V.fan_areas(V.fans(at, objects.unionByName(upto(GROUND_M)), upto(ANCHOR_M), RAYS))
    return areas.select("leg_id", "dir_idx", "direction", F.round(F.col("area_m2") / 1e6, 4).alias("area_km2"), F.round(F.col("anchorable_m2") / 1e6, 4).alias("anchorable_km2"), F.round("blocked", 6).alias("blocked"))


# ---- the cascade ------------------------------------------------------------------------------------------------

LOW, STEP = "(mean_m - 5e0 * std_m)", f"(1e1 * std_m / {X.num(K.RAYS)})"
#: Traffic of each year and a rose for it over one geometry, on a chart with a contour each 5 m; ids of merged contours count down from the shallowest in use.
_CASCADE = f"""WITH {_EDGES}, eg AS (SELECT obstacle_id, kind, CASE WHEN kind = 'depth' THEN 5e0 * ceil(value_m / 5e0) ELSE value_m END AS value_m, {_SNAPPED(SHIFT)} FROM ed),
lm AS (SELECT leg_id, {X.haversine('lon1', 'lat1', 'lon2', 'lat2', X.EARTH_ROUTE_M)} AS length_m FROM legs),
db AS (SELECT DISTINCT value_m AS v FROM eg WHERE kind = 'depth'),
ex AS (SELECT scenario_id, leg_id, dir_idx, ship_type, size_bin, length_m / (speed_kn * 1852e0) * freq * CASE WHEN ship_type BETWEEN 8 AND 11 THEN 1e-1 ELSE 1e0 END / 8760e0 AS base,
  (SELECT max(v) FROM db WHERE v < round(draught_m, 2)) AS ground_m, (SELECT max(v) FROM db WHERE v < round(7e0 * round(draught_m, 2), 2)) AS anchor_m FROM scenario_cells JOIN lm USING (leg_id) WHERE speed_kn > 0),
bk AS (SELECT DISTINCT leg_id, dir_idx, ground_m, anchor_m FROM ex),
rk AS (SELECT v, -dense_rank() OVER (ORDER BY v) AS cid FROM (SELECT ground_m AS v FROM bk UNION SELECT anchor_m FROM bk) WHERE v IS NOT NULL),
pr AS (SELECT leg_id, {_XY('lon1', 'lat1')[0]} AS s_x, {_XY('lon1', 'lat1')[1]} AS s_y, {_XY('lon2', 'lat2')[0]} AS e_x, {_XY('lon2', 'lat2')[1]} AS e_y FROM legs),
fr AS (SELECT *, sqrt(pow(e_x - s_x, 2e0) + pow(e_y - s_y, 2e0)) AS len, sin(radians(direction * 45e0)) AS gx, cos(radians(direction * 45e0)) AS gy FROM pr JOIN leg_lateral USING (leg_id) CROSS JOIN (SELECT CAST(range AS INTEGER) AS direction FROM range(8))),
fs AS (SELECT leg_id, dir_idx, direction, mean_m, std_m, s_x, s_y, gx, gy, gx * ((e_x - s_x) / len) - gy * (-(e_y - s_y) / len) AS spread, gx * (-(e_y - s_y) / len) + gy * ((e_x - s_x) / len) AS along, (e_x - s_x) * gx + (e_y - s_y) * gy AS x1, gx * (e_y - s_y) - gy * (e_x - s_x) AS c1 FROM fr),
fc AS (SELECT fs.*, obstacle_id, kind, value_m, a_x, a_y, b_x, b_y, (a_x - s_x) * gx + (a_y - s_y) * gy AS xa, gx * (a_y - s_y) - gy * (a_x - s_x) AS ca, (b_x - s_x) * gx + (b_y - s_y) * gy AS xb, gx * (b_y - s_y) - gy * (b_x - s_x) AS cb
  FROM fs JOIN eg ON greatest(gx * (a_y - s_y) - gy * (a_x - s_x), gx * (b_y - s_y) - gy * (b_x - s_x)) >= least(0e0, c1) - (abs(mean_m) + 5e0 * std_m) AND least(gx * (a_y - s_y) - gy * (a_x - s_x), gx * (b_y - s_y) - gy * (b_x - s_x)) <= greatest(0e0, c1) + abs(mean_m) + 5e0 * std_m
    AND greatest((a_x - s_x) * gx + (a_y - s_y) * gy, (b_x - s_x) * gx + (b_y - s_y) * gy) >= least(0e0, x1) - (abs(mean_m) + 5e0 * std_m) AND least((a_x - s_x) * gx + (a_y - s_y) * gy, (b_x - s_x) * gx + (b_y - s_y) * gy) <= greatest(0e0, x1) + abs(mean_m) + 5e0 * std_m + {X.num(REACH)}),
sl AS (SELECT *, ca - f * c1 AS ya, cb - f * c1 AS yb, {LOW} AS low, {STEP} AS step FROM (SELECT *, (slice + 5e-1) / {X.num(K.SLICES)} AS f FROM fc CROSS JOIN (SELECT range AS slice FROM range({K.SLICES})))),
ry AS (SELECT *, unnest(CASE WHEN abs(spread) < 1e-6 THEN CASE WHEN least(ya, yb) <= 0 AND greatest(ya, yb) > 0 THEN range({K.RAYS}) ELSE [] END
  ELSE range(greatest(0, CAST(floor((least(ya / spread, yb / spread) - low) / step) AS BIGINT) - 1), least({K.RAYS - 1}, CAST(ceil((greatest(ya / spread, yb / spread) - low) / step) AS BIGINT) + 1) + 1) END) AS ray FROM sl WHERE ya <> yb),
rw AS (SELECT *, low + (ray + 5e-1) * step AS w FROM ry), rc AS (SELECT *, CASE WHEN abs(spread) < 1e-6 THEN 0e0 ELSE w * spread END AS c FROM rw),
rt AS (SELECT *, xa + (c - ya) / (yb - ya) * (xb - xa) - f * x1 - w * along AS t FROM rc WHERE least(ya, yb) <= c AND greatest(ya, yb) > c),
th AS (SELECT leg_id, dir_idx, direction, slice, ray, obstacle_id, kind, value_m, t, ({X.phi('(low + (ray + 1e0) * step - mean_m) / std_m')} - {X.phi('(low + (ray + 0e0) * step - mean_m) / std_m')}) / {X.num(K.SLICES)} AS mass FROM rt WHERE t >= 0 AND t <= {X.num(REACH)}),
ht AS (SELECT leg_id, dir_idx, direction, slice, ray, obstacle_id, kind, NULL AS value_m, any_value(mass) AS mass, min(t) AS enter_m, max(t) AS exit_m FROM th WHERE kind = 'object' GROUP BY 1, 2, 3, 4, 5, 6, 7
  UNION ALL SELECT leg_id, dir_idx, direction, slice, ray, cid, kind, v, any_value(mass), min(t), max(t) FROM th JOIN rk ON value_m <= v WHERE kind = 'depth' GROUP BY 1, 2, 3, 4, 5, 6, 7, 8),
fa AS (SELECT leg_id, dir_idx, direction, obstacle_id, sum(mass) AS hole, min(enter_m) AS distance_m FROM ht GROUP BY 1, 2, 3, 4),
hf AS (SELECT * FROM ht JOIN fa USING (leg_id, dir_idx, direction, obstacle_id)),
rb AS (SELECT hf.*, ground_m, anchor_m, 0 AS place, 'allision' AS accident FROM hf JOIN bk USING (leg_id, dir_idx) WHERE kind = 'object' UNION ALL SELECT hf.*, ground_m, anchor_m, 1, 'anchoring' FROM hf JOIN bk ON hf.leg_id = bk.leg_id AND hf.dir_idx = bk.dir_idx AND value_m = anchor_m WHERE kind = 'depth'
  UNION ALL SELECT hf.*, ground_m, anchor_m, 2, 'grounding' FROM hf JOIN bk ON hf.leg_id = bk.leg_id AND hf.dir_idx = bk.dir_idx AND value_m = ground_m WHERE kind = 'depth'),
wb AS (SELECT *, coalesce(min(CASE WHEN place <> 1 THEN enter_m END) OVER w, 1e308) AS blocked_m, coalesce(min(CASE WHEN place = 1 THEN enter_m END) OVER w, 1e308) AS anchors_m FROM rb
  WINDOW w AS (PARTITION BY leg_id, dir_idx, direction, ground_m, anchor_m, slice, ray ORDER BY distance_m, least(place, 1), obstacle_id, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
re AS (SELECT leg_id, dir_idx, direction, ground_m, anchor_m, obstacle_id, accident, distance_m, sum(CASE WHEN enter_m < blocked_m THEN mass ELSE 0 END) AS h_reach,
  sum(CASE WHEN enter_m < blocked_m AND place <> 1 AND anchors_m <= least(exit_m, blocked_m) THEN mass ELSE 0 END) AS h_in_anchor FROM wb GROUP BY 1, 2, 3, 4, 5, 6, 7, 8),
fe AS (SELECT DISTINCT leg_id, dir_idx, direction, CASE WHEN kind = 'object' THEN obstacle_id ELSE cid END AS obstacle_id, a_x, a_y, b_x, b_y, spread, mean_m, std_m, x1, c1, xa, ca, xb, cb FROM fc LEFT JOIN rk ON kind = 'depth' AND value_m <= v WHERE kind = 'object' OR cid IS NOT NULL),
fl AS (SELECT *, sqrt(pow(xb - xa, 2e0) + pow(cb - ca, 2e0)) AS long, least(0e0, c1) + least(spread * (mean_m - 5e0 * std_m), spread * (mean_m + 5e0 * std_m)) AS low, greatest(0e0, c1) + greatest(spread * (mean_m - 5e0 * std_m), spread * (mean_m + 5e0 * std_m)) AS high,
  xa - CASE WHEN abs(c1) > 1e-6 THEN x1 * greatest(0e0, least(1e0, ca / c1)) ELSE greatest(0e0, x1) END AS da, xb - CASE WHEN abs(c1) > 1e-6 THEN x1 * greatest(0e0, least(1e0, cb / c1)) ELSE greatest(0e0, x1) END AS db FROM fe),
fm AS (SELECT leg_id, dir_idx, direction, obstacle_id, greatest(least(greatest(ca, cb), high) - greatest(least(ca, cb), low), 0e0) / abs(cb - ca) * long AS inside_m, coalesce((CASE WHEN da >= 0 THEN da END + CASE WHEN db >= 0 THEN db END) / 2, CASE WHEN da >= 0 THEN da END, CASE WHEN db >= 0 THEN db END) AS edge_m FROM fl WHERE (cb - ca) / long <= -{X.num(K.FACING)}),
sr AS (SELECT *, inside_m / sum(inside_m) OVER (PARTITION BY leg_id, dir_idx, direction, obstacle_id) AS share FROM fm WHERE inside_m > 0 AND edge_m <= {X.num(REACH)}),
pa AS (SELECT re.* EXCLUDE (distance_m), coalesce(share, 1e0) AS share, coalesce(edge_m, re.distance_m) AS distance_m FROM re LEFT JOIN sr USING (leg_id, dir_idx, direction, obstacle_id)),
pn AS (SELECT *, {X.not_repaired('lognormal', f"(distance_m) / {X.num(D.DRIFT_KN * X.KNOT_MS * 3600.0)}", 0.95, 0.2, 0.85)} AS p FROM pa),
rs AS (SELECT direction, value / sum(value) OVER () AS rp FROM (SELECT direction, sum(value) AS value FROM ({_ROSE.format(customer='customer')}) GROUP BY 1) WHERE value > 0),
ch AS (SELECT pn.*, rp * CASE WHEN accident = 'anchoring' THEN h_reach ELSE greatest(0e0, h_reach - 7e-1 * h_in_anchor) END * share * CASE WHEN accident = 'anchoring' THEN 7e-1 ELSE p END AS chance FROM pn JOIN rs USING (direction)),
ca AS (SELECT leg_id, dir_idx, direction, ground_m, anchor_m, obstacle_id, accident, sum(chance) AS chance, sum(chance * p) AS chance_p, min(distance_m) AS distance_m FROM ch WHERE chance > 0 GROUP BY 1, 2, 3, 4, 5, 6, 7),
"""


def _cascade_sql(keys: str, by: str) -> str:
    """Sums up the side that the report does not ask for before cells meet places, as contributions() does."""
    cells, places = ("ship_type, size_bin, ", "") if by == "cells" else ("", "obstacle_id, direction, ")
    named = ", ".join(f"xp.{k}" if k in ("leg_id", "dir_idx") else k for k in keys.split(", "))
    return oracle(
        _CASCADE
        + f"""cp AS (SELECT leg_id, dir_idx, ground_m, anchor_m, accident, {places}sum(chance) AS chance, sum(chance_p) AS chance_p, min(distance_m) AS distance_m FROM ca GROUP BY ALL),
xp AS (SELECT scenario_id, leg_id, dir_idx, ground_m, anchor_m, {cells}sum(base) AS base FROM ex GROUP BY ALL)
SELECT scenario_id, accident, {named}, round(sum(base * chance) * 1e6, 4) AS frequency_e6, round(sum(base * chance_p) / sum(base * chance), 5) AS p_not_repaired, round(min(distance_m), 2) AS distance_m
FROM xp JOIN cp ON xp.leg_id = cp.leg_id AND xp.dir_idx = cp.dir_idx AND xp.ground_m IS NOT DISTINCT FROM cp.ground_m AND xp.anchor_m IS NOT DISTINCT FROM cp.anchor_m GROUP BY ALL""",
        "legs", "leg_lateral", "scenario_cells", "obstacles",
    )


def cascade_facts(spark, sf_dir, detail):
    """The drifting cascade of each year's traffic over one geometry, with merged contours."""
    cells, years = _scenario_cells(spark, sf_dir)
    legs, lateral, edges, reach = (t.drop("scenario_id") for t in _drift_inputs(spark, sf_dir))
    edges = edges.withColumns({c: F.col(c) + SHIFT[c.endswith("y")] for c in G.ENDS})
    edges = edges.withColumn("value_m", F.when(F.col("kind") == "depth", 5.0 * F.ceil(F.col("value_m") / 5.0)).otherwise(F.col("value_m")))
    rates = spark.range(8, 12).select(F.col("id").cast("int").alias("ship_type"), F.lit(0.1).alias("rate"))
    rose = spark.sql(_ROSE, customer=spark.read.parquet(f"{sf_dir}/customer.parquet")).groupBy("direction").agg(F.sum("value").alias("value"))
    rose = D.normalized_rose(rose.join(years)).select("scenario_id", F.col("direction").cast("int").alias("direction"), "rp")
    return K.cascade(cells, legs, lateral, edges, rose, rates, reach.withColumn("reach_m", F.lit(REACH)), detail=detail, merged=True)


def _per(spark, sf_dir, *keys):
    out = K.rolled_up(cascade_facts(spark, sf_dir, "cells" if "ship_type" in keys else "places"), *keys)
    return out.select("scenario_id", "accident", *keys, F.round(F.col("frequency") * 1e6, 4).alias("frequency_e6"), F.round("p_not_repaired", 5).alias("p_not_repaired"), F.round("distance_m", 2).alias("distance_m"))


@query("drf_cascade_objects", _cascade_sql("obstacle_id", "places"))
def cascade_objects(spark, sf_dir):
    return _per(spark, sf_dir, "obstacle_id")


@query("drf_cascade_legs", _cascade_sql("leg_id, dir_idx, direction", "places"))
def cascade_legs(spark, sf_dir):
    return _per(spark, sf_dir, "leg_id", "dir_idx", "direction")


@query("drf_cascade_cells", _cascade_sql("ship_type, size_bin", "cells"))
def cascade_cells(spark, sf_dir):
    return _per(spark, sf_dir, "ship_type", "size_bin")


@query("drf_cascade_edges", _cascade_sql("leg_id, dir_idx, direction, obstacle_id", "places"))
def cascade_edges(spark, sf_dir):
    """By leg, directions and obstacle, over the obstacle's edges that share it."""
    return _per(spark, sf_dir, "leg_id", "dir_idx", "direction", "obstacle_id")


# ---- projection and repair formulas -----------------------------------------------------------------------------

_PLACES = "SELECT CAST(c_nationkey AS BIGINT) AS scenario_id, CAST(c_custkey AS BIGINT) AS place_id, c_nationkey * 14e0 - 170e0 + c_custkey % 50 * 5e-2 AS lon, c_nationkey % 7 * 22e0 - 66e0 + c_custkey % 31 * 1e-1 AS lat FROM {customer}"


@query("drf_utm", f"""WITH p AS ({_PLACES.format(customer='customer')}), z AS (SELECT scenario_id, CAST(floor((avg(lon) + 180) / 6) + 1 AS INTEGER) AS zone, avg(lat) < 0 AS south FROM p GROUP BY 1)
SELECT scenario_id, place_id, zone, round({U.forward('lon', 'lat', 'zone', 'south')[0]}, 3) AS x, round({U.forward('lon', 'lat', 'zone', 'south')[1]}, 3) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM p JOIN z USING (scenario_id)""")
def utm_rows(spark, sf_dir):
    """Places of many scenarios in the zone of each; lon and lat have been there and back (the SQL has the given ones)."""
    places = spark.sql(_PLACES, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    zones = U.zones(places)
    there = U.to_metres(places, zones, p=("lon", "lat")).drop("lon", "lat")
    back = U.to_degrees(there, zones, q=("p_x", "p_y")).join(zones, "scenario_id")
    return back.select("scenario_id", "place_id", "zone", F.round("p_x", 3).alias("x"), F.round("p_y", 3).alias("y"), F.round("q_lon", 6).alias("lon"), F.round("q_lat", 6).alias("lat"))


_TEXTS = """SELECT CAST(c_custkey AS BIGINT) AS scenario_id, c_custkey % 40 / 4e0 AS hours, CASE c_custkey % 5 WHEN 0 THEN concat('1 - exp(-', CAST(1 + c_custkey % 9 AS STRING), ' * x ** 0.9 / 10)') WHEN 1 THEN concat('norm.cdf((x - ', CAST(c_custkey % 7 AS STRING), ') / 2)')
    WHEN 2 THEN concat('(x > ', CAST(c_custkey % 6 AS STRING), ') * 1') WHEN 3 THEN concat('x / (x + ', CAST(1 + c_custkey % 3 AS STRING), ')') ELSE '__import__(x)' END AS repair_text FROM {customer}"""


@query("drf_repair_texts", f"""SELECT CAST(c_custkey AS BIGINT) AS scenario_id, c_custkey % 40 / 4e0 AS hours, round(CASE c_custkey % 5 WHEN 0 THEN 1 - exp(-(1 + c_custkey % 9) * pow(c_custkey % 40 / 4e0, 9e-1) / 1e1) WHEN 1 THEN {X.phi('((c_custkey % 40 / 4e0 - c_custkey % 7) / 2e0)')}
    WHEN 2 THEN CASE WHEN c_custkey % 40 / 4e0 > c_custkey % 6 THEN 1e0 ELSE 0e0 END WHEN 3 THEN (c_custkey % 40 / 4e0) / (c_custkey % 40 / 4e0 + 1 + c_custkey % 3) END, 9) AS p_repaired, CASE WHEN c_custkey % 5 = 4 THEN 'not allowed: Call' END AS refused FROM customer""")
def repair_rows(spark, sf_dir):
    """Each scenario's own formula, and why one is refused."""
    rows = spark.sql(_TEXTS, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    refused = H.findings(rows).select("scenario_id", F.col("detail").alias("refused"))
    return H.repaired(rows).join(refused, "scenario_id", "left").select("scenario_id", "hours", F.round("p_repaired", 9).alias("p_repaired"), "refused")
