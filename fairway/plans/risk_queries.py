"""Queries of collisions, powered and drifting accidents, consequences and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairway.functions import expr as X
from fairway.operators import cascade as K
from fairway.operators import collision as C
from fairway.operators import consequence as O
from fairway.operators import drifting as D
from fairway.operators import network as N
from fairway.operators import passages as P
from fairway.operators import polygons as G
from fairway.operators import powered as W
from fairway.operators import reports as R

from .adapters import oracle, view
from .network_queries import _ENDS, _GEOMETRIC

QUERIES, ORACLE_SQL = {}, {}
LON0, LAT0 = 14.0, 55.0


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _inputs(spark, sf_dir):
    legs = N.with_length(view(spark, sf_dir, "legs"))
    return view(spark, sf_dir, "traffic_cells"), C.lateral_mixture(view(spark, sf_dir, "leg_lateral")), legs


_SHIPS = f"""WITH l AS (SELECT *, {X.haversine('lon1', 'lat1', 'lon2', 'lat2', X.EARTH_ROUTE_M)} AS length_m FROM legs),
s AS (SELECT leg_id, dir_idx, ship_type, size_bin, freq AS q, CASE WHEN speed_kn > 0 THEN speed_kn ELSE 1e1 END * {X.num(X.KNOT_MS)} AS v, (size_bin + 5e-1) * 25e0 AS loa, CASE WHEN beam_m > 0 THEN beam_m ELSE (size_bin + 5e-1) * 25e0 / 65e-1 END AS b FROM traffic_cells),
c AS (SELECT s.*, mean_m AS mu, std_m AS sigma FROM s JOIN leg_lateral USING (leg_id, dir_idx))"""
_HEAD_ON = f"""{_SHIPS}, h AS (SELECT leg_id, x.ship_type AS t1, x.size_bin AS z1, y.ship_type AS t2, y.size_bin AS z2, x.q / x.v * y.q / y.v * (x.v + y.v) * {X.overlap('x.mu - y.mu', 'sqrt(x.sigma * x.sigma + y.sigma * y.sigma)', '(x.b + y.b) / 2e0')} * length_m / {X.num(X.YEAR_S)} AS n
  FROM c x JOIN c y USING (leg_id) JOIN l USING (leg_id) WHERE x.dir_idx = 0 AND y.dir_idx = 1)"""


@query("col_head_on", oracle(_HEAD_ON + "SELECT leg_id, count(*) AS pairs, round(sum(n) * 1e6, 4) AS n FROM h GROUP BY 1", "legs", "leg_lateral", "traffic_cells"))
def head_on(spark, sf_dir):
    return C.head_on(*_inputs(spark, sf_dir)).groupBy("leg_id").agg(F.count("*").alias("pairs"), F.round(F.sum("n") * 1e6, 4).alias("n"))


@query("col_head_on_by_cell", oracle(_HEAD_ON + """SELECT ship_type, size_bin, round(sum(n) * 1e6, 4) AS n FROM (SELECT t1 AS ship_type, z1 AS size_bin, n / 2 AS n FROM h UNION ALL SELECT t2, z2, n / 2 FROM h) GROUP BY 1, 2""", "legs", "leg_lateral", "traffic_cells"))
def head_on_by_cell(spark, sf_dir):
    return C.by_cell(C.head_on(*_inputs(spark, sf_dir))).select("ship_type", "size_bin", F.round(F.col("n") * 1e6, 4).alias("n"))


@query("col_overtaking", oracle(f"""{_SHIPS}, h AS (SELECT leg_id, x.q / x.v * y.q / y.v * (x.v - y.v) * {X.overlap('0e0', 'sqrt(x.sigma * x.sigma + y.sigma * y.sigma)', '(x.b + y.b) / 2e0')} * length_m / {X.num(X.YEAR_S)} AS n
  FROM c x JOIN c y USING (leg_id, dir_idx) JOIN l USING (leg_id) WHERE x.v > y.v) SELECT leg_id, count(*) AS pairs, round(sum(n) * 1e6, 4) AS n FROM h GROUP BY 1""", "legs", "leg_lateral", "traffic_cells"))
def overtaking(spark, sf_dir):
    return C.overtaking(*_inputs(spark, sf_dir)).groupBy("leg_id").agg(F.count("*").alias("pairs"), F.round(F.sum("n") * 1e6, 4).alias("n"))


_STAR = _GEOMETRIC.replace("FROM legs", "FROM star_legs")
_CROSSING = f"""{_STAR}, s AS (SELECT leg_id, ship_type, size_bin, freq AS q, speed_kn * {X.num(X.KNOT_MS)} AS v, (size_bin + 5e-1) * 25e0 AS loa, beam_m AS b FROM star_cells),
m AS (SELECT leg_id, sum(q / v) AS s, sum(q / v * loa) AS sl, sum(q / v * b) AS sb FROM s GROUP BY 1),
x AS (SELECT a.junction_id, a.leg_id AS leg_a, b.leg_id AS leg_b, {X.turn('a.bearing', 'b.bearing')} AS turn FROM j a JOIN j b ON a.junction_id = b.junction_id AND a.leg_id < b.leg_id),
y AS (SELECT *, least(turn, 180e0 - turn) AS angle FROM x WHERE radians(least(turn, 180e0 - turn)) >= 1e-1),
xk AS (SELECT y.*, 1e0 - coalesce(p.share, 0) * coalesce(r.share, 0) AS factor FROM y LEFT JOIN g p ON p.junction_id = y.junction_id AND p.in_leg = leg_a AND p.out_leg = leg_b LEFT JOIN g r ON r.junction_id = y.junction_id AND r.in_leg = leg_b AND r.out_leg = leg_a),
n AS (SELECT CASE WHEN angle <= 30 THEN 'merging' ELSE 'crossing' END AS kind, xk.junction_id, leg_a, leg_b,
  factor * ((u.sl * w.s + u.s * w.sl) * sin(radians(angle)) + (u.sb * w.s + u.s * w.sb) * abs(cos(radians(angle)))) / (sin(radians(angle)) * {X.num(X.YEAR_S)}) AS n
  FROM xk JOIN m u ON u.leg_id = leg_a JOIN m w ON w.leg_id = leg_b WHERE factor > 0)"""
_BEND = f"""{_STAR}, f AS (SELECT leg_id, sum(freq) AS q, avg((size_bin + 5e-1) * 25e0) AS loa FROM star_cells GROUP BY 1),
d AS (SELECT g.junction_id, in_leg AS leg_a, out_leg AS leg_b, q * share AS q, loa, abs(sin(radians(deflection))) AS s, abs(cos(radians(deflection))) AS c FROM g JOIN f ON f.leg_id = in_leg JOIN j ON j.junction_id = g.junction_id AND j.leg_id = in_leg AND j.side = 'end' WHERE deflection > 5),
n AS (SELECT junction_id, leg_a, leg_b, 1e-2 * q * (1e0 - 1e-2) * q * (2e0 * loa * s + 2e0 * loa / 65e-1 * c) / (s * {X.num(X.YEAR_S)}) AS n FROM d WHERE s > 1e-9)"""


def _star(spark, sf_dir):
    cells, legs = view(spark, sf_dir, "star_cells"), N.with_length(view(spark, sf_dir, "star_legs"))
    ends = N.junctions(legs)
    return cells, ends, N.geometric_shares(ends)


def _crossings(spark, sf_dir):
    cells, ends, shares = _star(spark, sf_dir)
    return C.crossing(cells, C.crossing_geometry(ends), shares)


def _bends(spark, sf_dir):
    cells, ends, shares = _star(spark, sf_dir)
    return C.bend(cells, shares, ends)


@query("col_crossing", oracle(_CROSSING + "SELECT kind, junction_id, leg_a, leg_b, round(n, 6) AS n, round(n * 13e-5 * 1e6, 4) AS frequency_e6 FROM n", "star_legs", "star_cells"))
def crossing(spark, sf_dir):
    out = C.frequencies(_crossings(spark, sf_dir))
    return out.select("kind", "junction_id", "leg_a", "leg_b", F.round("n", 6).alias("n"), F.round(F.col("frequency") * 1e6, 4).alias("frequency_e6"))


@query("col_crossing_by_cell", oracle(_CROSSING.rsplit(",\nn AS (", 1)[0] + f""", h AS (SELECT CASE WHEN angle <= 30 THEN 'merging' ELSE 'crossing' END AS kind, o.ship_type, o.size_bin,
  factor * o.q / o.v * ((o.loa * w.s + w.sl) * sin(radians(angle)) + (o.b * w.s + w.sb) * abs(cos(radians(angle)))) / (sin(radians(angle)) * {X.num(X.YEAR_S)}) / 2e0 AS n
  FROM (SELECT junction_id, leg_a, leg_b, angle, factor FROM xk UNION ALL SELECT junction_id, leg_b, leg_a, angle, factor FROM xk) z JOIN s o ON o.leg_id = z.leg_a JOIN m w ON w.leg_id = z.leg_b WHERE factor > 0)
SELECT kind, ship_type, size_bin, round(sum(n), 4) AS n FROM h GROUP BY 1, 2, 3""", "star_legs", "star_cells"))
def crossing_by_cell(spark, sf_dir):
    cells, ends, shares = _star(spark, sf_dir)
    return C.crossing_by_cell(cells, C.crossing_geometry(ends), shares).withColumn("n", F.round("n", 4))


@query("col_waypoints", oracle(_CROSSING + "SELECT kind, junction_id, round(sum(n), 5) AS n FROM n GROUP BY 1, 2", "star_legs", "star_cells"))
def waypoints(spark, sf_dir):
    return C.by_waypoint(_crossings(spark, sf_dir)).withColumn("n", F.round("n", 5))


@query("col_leg_pairs", oracle(_BEND + "SELECT 'bend' AS kind, least(leg_a, leg_b) AS leg_1, greatest(leg_a, leg_b) AS leg_2, round(sum(n), 5) AS n FROM n GROUP BY 2, 3", "star_legs", "star_cells"))
def leg_pairs(spark, sf_dir):
    return C.by_leg_pair(_bends(spark, sf_dir)).withColumn("n", F.round("n", 5))


@query("col_bend", oracle(_BEND + "SELECT junction_id, leg_a, leg_b, round(n, 6) AS n FROM n", "star_legs", "star_cells"))
def bend(spark, sf_dir):
    return _bends(spark, sf_dir).select("junction_id", "leg_a", "leg_b", F.round("n", 6).alias("n"))


@query("col_bend_by_cell", oracle(_BEND + """, w AS (SELECT leg_a AS leg_id, sum(n) AS n FROM n GROUP BY 1), lc AS (SELECT leg_id, ship_type, size_bin, sum(freq) AS q FROM star_cells GROUP BY 1, 2, 3), t AS (SELECT leg_id, sum(q) AS total FROM lc GROUP BY 1)
SELECT 'bend' AS kind, ship_type, size_bin, round(sum(n * q / total), 5) AS n FROM w JOIN lc USING (leg_id) JOIN t USING (leg_id) GROUP BY 2, 3""", "star_legs", "star_cells"))
def bend_by_cell(spark, sf_dir):
    return C.bend_by_cell(_bends(spark, sf_dir), view(spark, sf_dir, "star_cells")).withColumn("n", F.round("n", 5))


@query("col_static_bends", oracle(f"""{_ENDS}, b AS (SELECT leg_id, CAST(leg_id % 40 AS DOUBLE) AS t FROM legs), f AS (SELECT leg_id, sum(freq) AS q, avg((size_bin + 5e-1) * 25e0) AS loa FROM traffic_cells GROUP BY 1)
SELECT leg_id, round(1e-2 * q * (1e0 - 1e-2) * q * (2e0 * loa * abs(sin(radians(t))) + 2e0 * loa / 65e-1 * abs(cos(radians(t)))) / (abs(sin(radians(t))) * {X.num(X.YEAR_S)}), 6) AS n
FROM b JOIN f USING (leg_id) WHERE t > 5 AND leg_id NOT IN (SELECT leg_id FROM j WHERE side = 'end')""", "legs", "traffic_cells"))
def static_bends(spark, sf_dir):
    legs = view(spark, sf_dir, "legs").withColumn("bend_angle", (F.col("leg_id") % 40).cast("double"))
    return C.static_bend(view(spark, sf_dir, "traffic_cells"), legs, N.junctions(legs)).select(F.col("leg_a").alias("leg_id"), F.round("n", 6).alias("n"))


@query("col_scenarios", oracle(_HEAD_ON.replace("FROM traffic_cells", "FROM scenario_cells").replace("s AS (SELECT leg_id", "s AS (SELECT scenario_id, leg_id").replace("h AS (SELECT leg_id", "h AS (SELECT scenario_id, leg_id").replace("JOIN c y USING (leg_id)", "JOIN c y USING (scenario_id, leg_id)")
    + "SELECT scenario_id, leg_id, count(*) AS pairs, round(sum(n) * 1e6, 4) AS n FROM h GROUP BY 1, 2", "legs", "leg_lateral", "scenario_cells"))
def scenarios(spark, sf_dir):
    cells, years = _scenario_cells(spark, sf_dir)
    legs = N.with_length(view(spark, sf_dir, "legs")).join(years)
    out = C.head_on(cells, C.lateral_mixture(view(spark, sf_dir, "leg_lateral").join(years)), legs)
    return out.groupBy("scenario_id", "leg_id").agg(F.count("*").alias("pairs"), F.round(F.sum("n") * 1e6, 4).alias("n"))


def _scenario_cells(spark, sf_dir):
    """Traffic by year, and the years: a scenario each, small dimension tables are repeated for."""
    cells = view(spark, sf_dir, "scenario_cells")
    return cells, F.broadcast(cells.select("scenario_id").distinct())  # one row for each year


_K = f"(cos(radians({X.num(LAT0)})) * {X.num(W.LON_M)})"
_XY = lambda lon, lat: (f"(({lon}) - {X.num(LON0)}) * {_K}", f"(({lat}) - {X.num(LAT0)}) * {X.num(W.LAT_M)}")
_EDGES = "ed AS (" + " UNION ALL ".join(
    f"SELECT obstacle_id, kind, value_m, {_XY(a, b)[0]} AS ax, {_XY(a, b)[1]} AS ay, {_XY(c, d)[0]} AS bx, {_XY(c, d)[1]} AS bby FROM obstacles"
    for a, b, c, d in (("x0", "y0", "x1", "y0"), ("x1", "y0", "x1", "y1"), ("x1", "y1", "x0", "y1"), ("x0", "y1", "x0", "y0"))
) + ")"
_POWERED = f"""WITH {_EDGES}, v AS (SELECT leg_id, dir_idx, sum(freq * speed_kn) / sum(freq) AS speed_kn FROM traffic_cells GROUP BY 1, 2),
pr AS (SELECT leg_id, {_XY('lon1', 'lat1')[0]} AS sx, {_XY('lon1', 'lat1')[1]} AS sy, {_XY('lon2', 'lat2')[0]} AS ex, {_XY('lon2', 'lat2')[1]} AS ey FROM legs),
un AS (SELECT *, (ex - sx) / sqrt(pow(ex - sx, 2e0) + pow(ey - sy, 2e0)) AS ux, (ey - sy) / sqrt(pow(ex - sx, 2e0) + pow(ey - sy, 2e0)) AS uy FROM pr),
tp AS (SELECT leg_id, 0 AS dir_idx, ex AS tx, ey AS ty, ux AS dx, uy AS dy, -uy AS nx, ux AS ny FROM un UNION ALL SELECT leg_id, 1, sx, sy, -ux, -uy, -uy, ux FROM un),
pt AS (SELECT tp.*, mean_m, std_m, speed_kn, mean_m - 4e0 * std_m AS low, 8e0 * std_m / 499 AS step FROM tp JOIN leg_lateral USING (leg_id, dir_idx) JOIN v USING (leg_id, dir_idx)),
lc AS (SELECT pt.*, ed.*, (ax - tx) * dx + (ay - ty) * dy AS xa, (ax - tx) * nx + (ay - ty) * ny AS ya, (bx - tx) * dx + (bby - ty) * dy AS xb, (bx - tx) * nx + (bby - ty) * ny AS yb FROM pt CROSS JOIN ed),
rn AS (SELECT *, unnest(range(greatest(0, CAST(ceil((least(ya, yb) - low) / step) AS BIGINT) - 1), least(499, CAST(floor((greatest(ya, yb) - low) / step) AS BIGINT) + 1) + 1)) AS ray FROM lc WHERE ya <> yb AND greatest(xa, xb) > 0 AND least(ya, yb) < low + 500 * step AND greatest(ya, yb) > low - step),
ry AS (SELECT *, low + ray * step AS o FROM rn WHERE low + ray * step >= least(ya, yb) AND low + ray * step < greatest(ya, yb)),
al AS (SELECT *, xa + (o - ya) / (yb - ya) * (xb - xa) AS along, exp(-((o - mean_m) * (o - mean_m)) / (2 * (std_m * std_m))) / (std_m * 25066282746310002e-16) * step AS mass FROM ry),
nr AS (SELECT leg_id, dir_idx, ray, obstacle_id, kind, value_m, speed_kn, any_value(mass) AS mass, min(along) AS along FROM al WHERE along > 0 AND along < 5e4 GROUP BY 1, 2, 3, 4, 5, 6, 7),
hi AS (SELECT *, row_number() OVER (PARTITION BY leg_id, dir_idx, ray ORDER BY along, obstacle_id) AS n FROM nr),
sm AS (SELECT leg_id, dir_idx, obstacle_id, kind, value_m, sum(mass) AS mass, sum(mass * along) / sum(mass) AS mean_d, sum(mass * exp(-along / (180e0 * speed_kn * {X.num(X.KNOT_MS)}))) AS p_integral, count(*) AS n_rays, any_value(speed_kn) AS speed_kn FROM hi WHERE n = 1 GROUP BY 1, 2, 3, 4, 5)"""


def _powered_hits(spark, sf_dir, obstacles):
    cells, legs = view(spark, sf_dir, "traffic_cells"), view(spark, sf_dir, "legs")
    points = W.turning_points(legs, view(spark, sf_dir, "leg_lateral").drop("weight"), P.mean_speed(cells), LON0, LAT0)
    edges = W.projected(W.box_edges(obstacles), LON0, LAT0, a=("a_lon", "a_lat"), b=("b_lon", "b_lat"))
    return cells, W.ray_hits(points, edges), points


def _powered(spark, sf_dir):
    cells, hits, points = _powered_hits(spark, sf_dir, W.foremost(view(spark, sf_dir, "obstacles")))
    return cells, W.summaries(W.first_hits(hits), points)


@query("pow_summaries", oracle(_POWERED + f"SELECT leg_id, dir_idx, obstacle_id, round(mass, 5) AS mass, round(mean_d, 1) AS mean_m, round(p_integral, 5) AS p_integral, round(mass * exp(-mean_d / (180e0 * speed_kn * {X.num(X.KNOT_MS)})), 5) AS p_approx, n_rays FROM sm", "legs", "leg_lateral", "traffic_cells", "obstacles"))
def powered_summaries(spark, sf_dir):
    return _rounded(_powered(spark, sf_dir)[1])


def _rounded(s):
    return s.select("leg_id", "dir_idx", "obstacle_id", F.round("mass", 5).alias("mass"), F.round("mean_m", 1).alias("mean_m"), F.round("p_integral", 5).alias("p_integral"), F.round("p_approx", 5).alias("p_approx"), "n_rays")


_BINS = """, db AS (SELECT DISTINCT value_m AS bin_m FROM obstacles WHERE kind = 'depth'),
sh AS (SELECT *, row_number() OVER (PARTITION BY leg_id, dir_idx, ray, bin_m ORDER BY along, obstacle_id) AS k FROM nr JOIN db ON value_m <= bin_m WHERE kind = 'depth'),
ob AS (SELECT *, row_number() OVER (PARTITION BY leg_id, dir_idx, ray ORDER BY along, obstacle_id) AS k FROM nr WHERE kind = 'object'),
gs AS (SELECT leg_id, dir_idx, bin_m, obstacle_id, sum(mass) AS mass, sum(mass * along) / sum(mass) AS mean_d FROM sh WHERE k = 1 GROUP BY 1, 2, 3, 4),
os AS (SELECT leg_id, dir_idx, obstacle_id, value_m, sum(mass) AS mass, sum(mass * along) / sum(mass) AS mean_d FROM ob WHERE k = 1 GROUP BY 1, 2, 3, 4),
tc AS (SELECT *, (SELECT max(bin_m) FROM db WHERE bin_m <= draught_m) AS bin_m FROM traffic_cells WHERE speed_kn > 0),"""
_ACCIDENT = f"freq * mass * exp(-mean_d / (180e0 * speed_kn * {X.num(X.KNOT_MS)}))"
_POW_ACCIDENTS = _POWERED + _BINS + f"""
ac AS (SELECT 'grounding' AS accident, leg_id, ship_type, size_bin, obstacle_id, 16e-5 * {_ACCIDENT} AS f FROM tc JOIN gs USING (leg_id, dir_idx, bin_m)
  UNION ALL SELECT 'allision', leg_id, ship_type, size_bin, obstacle_id, 19e-5 * {_ACCIDENT} FROM tc JOIN os USING (leg_id, dir_idx) WHERE height_m >= value_m)"""


def _powered_accidents(spark, sf_dir):
    obstacles = view(spark, sf_dir, "obstacles")
    cells, hits, points = _powered_hits(spark, sf_dir, W.foremost_by_depth(obstacles))
    return W.accidents(cells.where("speed_kn > 0"), hits, points, obstacles.where("kind = 'depth'"), C.CAUSATION)


_POW_VIEWS = ("legs", "leg_lateral", "traffic_cells", "obstacles")


@query("pow_accidents", oracle(_POW_ACCIDENTS + "SELECT accident, obstacle_id, count(*) AS cells, round(sum(f) * 1e6, 3) AS frequency_e6 FROM ac GROUP BY 1, 2", *_POW_VIEWS))
def powered_accidents(spark, sf_dir):
    return _powered_accidents(spark, sf_dir).groupBy("accident", "obstacle_id").agg(F.count("*").alias("cells"), F.round(F.sum("frequency") * 1e6, 3).alias("frequency_e6"))


_POW_SCENARIOS = _POW_ACCIDENTS.replace("FROM traffic_cells WHERE speed_kn > 0)", "FROM scenario_cells WHERE speed_kn > 0)").replace("leg_id, ship_type, size_bin, obstacle_id, 16e-5", "scenario_id, leg_id, ship_type, size_bin, obstacle_id, 16e-5").replace("leg_id, ship_type, size_bin, obstacle_id, 19e-5", "scenario_id, leg_id, ship_type, size_bin, obstacle_id, 19e-5")


@query("pow_scenarios", oracle(_POW_SCENARIOS + "SELECT scenario_id, accident, obstacle_id, count(*) AS cells, round(sum(f) * 1e6, 3) AS frequency_e6 FROM ac GROUP BY 1, 2, 3", "legs", "leg_lateral", "traffic_cells", "scenario_cells", "obstacles"))
def powered_scenarios(spark, sf_dir):
    """The traffic of every year on one network and chart, whose rays are cast once."""
    obstacles = view(spark, sf_dir, "obstacles")
    _, hits, points = _powered_hits(spark, sf_dir, W.foremost_by_depth(obstacles))
    found = W.accidents(view(spark, sf_dir, "scenario_cells").where("speed_kn > 0"), hits, points, obstacles.where("kind = 'depth'"), C.CAUSATION)
    return found.groupBy("scenario_id", "accident", "obstacle_id").agg(F.count("*").alias("cells"), F.round(F.sum("frequency") * 1e6, 3).alias("frequency_e6"))


@query("pow_by_cell", oracle(_POW_ACCIDENTS + "SELECT accident, ship_type, size_bin, round(sum(f) * 1e6, 3) AS frequency_e6 FROM ac GROUP BY 1, 2, 3", *_POW_VIEWS))
def powered_by_cell(spark, sf_dir):
    return _powered_accidents(spark, sf_dir).groupBy("accident", "ship_type", "size_bin").agg(F.round(F.sum("frequency") * 1e6, 3).alias("frequency_e6"))


@query("pow_by_leg", oracle(_POW_ACCIDENTS + "SELECT accident, leg_id, obstacle_id, round(sum(f) * 1e6, 3) AS frequency_e6 FROM ac GROUP BY 1, 2, 3", *_POW_VIEWS))
def powered_by_leg(spark, sf_dir):
    return _powered_accidents(spark, sf_dir).groupBy("accident", "leg_id", "obstacle_id").agg(F.round(F.sum("frequency") * 1e6, 3).alias("frequency_e6"))


_BLACKOUT = f"""WITH l AS (SELECT leg_id, {X.haversine('lon1', 'lat1', 'lon2', 'lat2', X.EARTH_ROUTE_M)} AS m FROM legs),
b AS (SELECT leg_id, dir_idx, ship_type, size_bin, m / (speed_kn * 1852e0) * freq * (CASE WHEN ship_type BETWEEN 8 AND 11 THEN 1e-1 ELSE 1e0 END) / 8760e0 AS base FROM traffic_cells JOIN l USING (leg_id) WHERE speed_kn > 0)"""


def _blackouts(spark, sf_dir):
    rates = spark.range(8, 12).select(F.col("id").cast("int").alias("ship_type"), F.lit(0.1).alias("rate"))
    return D.blackout_exposure(view(spark, sf_dir, "traffic_cells"), N.with_length(view(spark, sf_dir, "legs")), rates)


@query("drf_blackouts", oracle(_BLACKOUT + "SELECT leg_id, dir_idx, round(sum(base), 8) AS base FROM b GROUP BY 1, 2", "legs", "traffic_cells"))
def blackouts(spark, sf_dir):
    return _blackouts(spark, sf_dir).groupBy("leg_id", "dir_idx").agg(F.round(F.sum("base"), 8).alias("base"))


_TAU = f"distance_m / {X.num(D.DRIFT_KN * X.KNOT_MS * 3600.0)}"


@query("drf_not_repaired", "WITH d AS (SELECT p_partkey, CAST(p_size AS DOUBLE) * 100e0 AS distance_m FROM part) SELECT p_partkey, " + ", ".join(f"round({X.not_repaired(k, _TAU, 0.95, 0.2, 0.85)}, 9) AS {k}" for k in ("lognormal", "normal", "weibull")) + " FROM d")
def not_repaired(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_size").cast("double") * 100.0).alias("distance_m"))
    for k in ("lognormal", "normal", "weibull"):
        d = D.not_repaired(d, "distance_m", k, kind=k)
    return d.select("p_partkey", *[F.round(k, 9).alias(k) for k in ("lognormal", "normal", "weibull")])


_ROSE = "SELECT CAST(c_nationkey AS BIGINT) AS scenario_id, c_custkey % 8 AS direction, sum(CASE WHEN c_acctbal > 0 THEN CAST(c_acctbal AS DOUBLE) ELSE 0e0 END) AS value FROM {customer} GROUP BY 1, 2"


@query("drf_rose", f"WITH r AS ({_ROSE.format(customer='customer')}) SELECT scenario_id, direction, round(value / sum(value) OVER (PARTITION BY scenario_id), 9) AS rp FROM r WHERE value > 0")
def rose(spark, sf_dir):
    r = spark.sql(_ROSE, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    return D.normalized_rose(r).select("scenario_id", "direction", F.round("rp", 9).alias("rp"))


SLICES, REACH = 10, 30000.0
_HOLES = f"""WITH {_EDGES}, pr AS (SELECT leg_id, {_XY('lon1', 'lat1')[0]} AS sx, {_XY('lon1', 'lat1')[1]} AS sy, {_XY('lon2', 'lat2')[0]} AS ex, {_XY('lon2', 'lat2')[1]} AS ey FROM legs),
un AS (SELECT *, sqrt(pow(ex - sx, 2e0) + pow(ey - sy, 2e0)) AS len FROM pr),
fr AS (SELECT leg_id, dir_idx, direction, mean_m, std_m, sx, sy, sin(radians(direction * 45e0)) AS gx, cos(radians(direction * 45e0)) AS gy, -(ey - sy) / len AS nx, (ex - sx) / len AS ny, ex - sx AS lx, ey - sy AS ly
  FROM un JOIN leg_lateral USING (leg_id) CROSS JOIN (SELECT CAST(range AS INTEGER) AS direction FROM range(8))),
fs AS (SELECT *, gx * ny - gy * nx AS spread, gx * nx + gy * ny AS along, lx * gx + ly * gy AS x1, gx * ly - gy * lx AS c1 FROM fr),
bo AS (SELECT leg_id, dir_idx, direction, obstacle_id, mean_m, std_m, spread, along, x1, c1, (ax - sx) * gx + (ay - sy) * gy AS xa, gx * (ay - sy) - gy * (ax - sx) AS ca, (bx - sx) * gx + (bby - sy) * gy AS xb, gx * (bby - sy) - gy * (bx - sx) AS cb FROM fs CROSS JOIN ed
  WHERE least(gx * (ay - sy) - gy * (ax - sx), gx * (bby - sy) - gy * (bx - sx)) < greatest(0e0, c1) + abs(spread) * (abs(mean_m) + 5 * std_m) + 1
    AND greatest(gx * (ay - sy) - gy * (ax - sx), gx * (bby - sy) - gy * (bx - sx)) > least(0e0, c1) - abs(spread) * (abs(mean_m) + 5 * std_m) - 1),
sl AS (SELECT *, xa - f * x1 AS ua, ca - f * c1 AS ya, xb - f * x1 AS ub, cb - f * c1 AS yb FROM (SELECT *, (slice + 5e-1) / {SLICES} AS f FROM bo CROSS JOIN (SELECT CAST(range AS INTEGER) AS slice FROM range({SLICES})))),
mt AS (SELECT *, CASE WHEN abs(spread) < 1e-6 THEN (ua - ya / (yb - ya) * (ub - ua)) / along END AS stop FROM sl WHERE greatest(ua, ub) > 0 AND least(ua, ub) < {X.num(REACH)} AND ya <> yb AND (abs(spread) >= 1e-6 OR (least(ya, yb) <= 0 AND greatest(ya, yb) > 0))),
iv AS (SELECT leg_id, dir_idx, direction, slice, obstacle_id, mean_m, std_m,
  greatest(CASE WHEN abs(spread) >= 1e-6 THEN least(ya / spread, yb / spread) WHEN along > 0 THEN mean_m - 5 * std_m ELSE stop END, mean_m - 5 * std_m) AS lo,
  least(CASE WHEN abs(spread) >= 1e-6 THEN greatest(ya / spread, yb / spread) WHEN along > 0 THEN stop ELSE mean_m + 5 * std_m END, mean_m + 5 * std_m) AS hi FROM mt),
sw AS (SELECT *, max(hi) OVER (PARTITION BY leg_id, dir_idx, direction, obstacle_id, slice ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM iv WHERE lo < hi),
cv AS (SELECT *, greatest(lo, coalesce(upto, lo)) AS a FROM sw)
SELECT leg_id, dir_idx, direction, obstacle_id, round(sum(CASE WHEN hi > a THEN {X.phi('(hi - mean_m) / std_m')} - {X.phi('(a - mean_m) / std_m')} ELSE 0e0 END) / {SLICES}, 6) AS hole FROM cv GROUP BY 1, 2, 3, 4"""


def _drift_inputs(spark, sf_dir, years=None):
    """Projected legs, lateral spread and obstacle edges, for one scenario or for each of the years."""
    years = F.broadcast(spark.range(1).select(F.col("id").alias("scenario_id"))) if years is None else years
    legs = W.projected(N.with_length(view(spark, sf_dir, "legs")), LON0, LAT0, s=("lon1", "lat1"), e=("lon2", "lat2")).select("leg_id", "s_x", "s_y", "e_x", "e_y", "length_m")
    edges = W.projected(W.box_edges(view(spark, sf_dir, "obstacles")), LON0, LAT0, a=("a_lon", "a_lat"), b=("b_lon", "b_lat")).select("obstacle_id", "kind", "value_m", "edge", "a_x", "a_y", "b_x", "b_y")
    return legs.join(years), view(spark, sf_dir, "leg_lateral").drop("weight").join(years), edges.join(years), years.withColumn("reach_m", F.lit(REACH))


@query("drf_holes", oracle(_HOLES, "legs", "leg_lateral", "obstacles"))
def hole_rows(spark, sf_dir):
    legs, lateral, edges, reach = _drift_inputs(spark, sf_dir)
    own, copies = G.shapes(edges)
    found = D.holes(D.edge_intervals(K.facing_edges(K.frames(legs, lateral).join(reach, "scenario_id"), own), SLICES), SLICES)
    return G.with_copies(found, copies).select("leg_id", "dir_idx", "direction", "obstacle_id", F.round("hole", 6).alias("hole"))


#: Each ship type's traffic stands for one kind of accident, so that all eight occur.
_ACCIDENTS = f"SELECT CASE ship_type % 8 {' '.join(f'WHEN {i} THEN {chr(39)}{k}{chr(39)}' for i, k in enumerate(O.KINDS))} END AS kind, ship_type, size_bin, sum(freq) * 1e-4 AS frequency FROM {{cells}} GROUP BY 1, 2, 3"
_SPILLS = f"""WITH a AS ({_ACCIDENTS.format(cells='traffic_cells')}), p AS (SELECT * FROM (VALUES (TRUE, 0, 98e-2), (TRUE, 1, 2e-2), (FALSE, 0, 97e-2), (FALSE, 1, 1e-2), (FALSE, 2, 1e-2), (FALSE, 3, 1e-2)) t(drift, level, p)),
f AS (SELECT * FROM (VALUES (0, 0e0), (1, 1e-1), (2, 3e-1), (3, 1e0)) t(level, f)),
s AS (SELECT kind, ship_type, size_bin, level, frequency * p AS frequency, (CASE WHEN ship_type = 19 THEN 80e0 * (size_bin * 25 + 125e-1) ELSE 100e0 END) * f AS volume_m3 FROM a JOIN p ON drift = starts_with(kind, 'drifting') JOIN f USING (level))"""


def _spilled(spark, sf_dir):
    cells = view(spark, sf_dir, "traffic_cells")
    oil = O.default_oil(cells.select("ship_type", "size_bin").distinct(), F.col("ship_type") == 19)
    return O.spills(spark.sql(_ACCIDENTS, cells=cells), oil, O.default_matrix(spark))


@query("con_spills", oracle(_SPILLS + "SELECT kind, ship_type, size_bin, CAST(level AS INTEGER) AS level, round(frequency, 9) AS frequency, round(volume_m3, 4) AS volume_m3 FROM s", "traffic_cells"))
def spills(spark, sf_dir):
    return _spilled(spark, sf_dir).withColumn("frequency", F.round("frequency", 9)).withColumn("volume_m3", F.round("volume_m3", 4))


@query("con_exceedance", oracle(_SPILLS + "SELECT CAST(i AS INTEGER) AS level, name, q AS quantity_m3, round(coalesce((SELECT sum(frequency) FROM s WHERE volume_m3 > q), 0), 7) AS frequency FROM (VALUES (0, 'Minor', 50e0), (1, 'Major', 500e0), (2, 'Catastrophic', 5000e0)) t(i, name, q)", "traffic_cells"))
def exceedance(spark, sf_dir):
    return O.exceedance(_spilled(spark, sf_dir)).withColumn("frequency", F.round("frequency", 7))


@query("con_totals", oracle(_SPILLS + "SELECT kind, round(sum(CASE WHEN volume_m3 > 0 THEN frequency ELSE 0 END), 7) AS spill_frequency, round(sum(frequency * volume_m3), 5) AS volume_m3_per_year FROM s GROUP BY 1", "traffic_cells"))
def totals(spark, sf_dir):
    return O.totals(_spilled(spark, sf_dir)).select("kind", F.round("spill_frequency", 7).alias("spill_frequency"), F.round("volume_m3_per_year", 5).alias("volume_m3_per_year"))


@query("con_routed", oracle(_POW_ACCIDENTS + f""", xs AS (SELECT leg_id, ship_type, size_bin, freq AS q FROM traffic_cells)
SELECT 'powered_' || accident AS kind, ship_type, size_bin, round(sum(f) * 1e6, 5) AS frequency_e6 FROM ac GROUP BY 1, 2, 3
UNION ALL SELECT 'merging', ship_type, size_bin, round(sum(q) * 1e-4, 5) FROM xs GROUP BY 2, 3""", *_POW_VIEWS))
def routed(spark, sf_dir):
    bends = view(spark, sf_dir, "traffic_cells").select(F.lit("bend").alias("kind"), "ship_type", "size_bin", (F.col("freq") * 1e-10).alias("frequency"))
    found = O.routed(bends, _powered_accidents(spark, sf_dir))
    return found.select("kind", "ship_type", "size_bin", F.round(F.col("frequency") * 1e6, 5).alias("frequency_e6"))


@query("con_reshaped_oil", oracle("""WITH d AS (SELECT DISTINCT ship_type, size_bin, CASE WHEN ship_type = 19 THEN 80e0 * (size_bin * 25 + 125e-1) ELSE 100e0 END AS m FROM traffic_cells),
u AS (SELECT DISTINCT c_nationkey % 21 AS ship_type, c_custkey % 15 AS size_bin, TRY_CAST(CASE WHEN c_custkey % 15 = 3 THEN 'none' ELSE CAST(c_nationkey % 21 * 10 AS VARCHAR) END AS DOUBLE) AS own FROM customer)
SELECT d.ship_type, d.size_bin, coalesce(own, m) AS oil_m3 FROM d LEFT JOIN u ON u.ship_type = d.ship_type AND u.size_bin = d.size_bin""", "traffic_cells"))
def reshaped_oil(spark, sf_dir):
    defaults = O.default_oil(view(spark, sf_dir, "traffic_cells").select("ship_type", "size_bin").distinct(), F.col("ship_type") == 19)
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    text = F.when(F.col("c_custkey") % 15 == 3, "none").otherwise((F.col("c_nationkey") % 21 * 10).cast("string"))
    user = c.select((F.col("c_nationkey") % 21).cast("int").alias("ship_type"), (F.col("c_custkey") % 15).cast("int").alias("size_bin"), text.alias("oil")).distinct()
    return O.reshaped_oil(defaults, user)


@query("rep_top_contributor", oracle("""WITH g AS (SELECT leg_id, ship_type, sum(freq) AS v FROM traffic_cells GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY leg_id ORDER BY v DESC, ship_type) AS n, sum(v) OVER (PARTITION BY leg_id) AS total FROM g)
SELECT leg_id, total, ship_type AS top, v AS top_value FROM r WHERE n = 1""", "traffic_cells"))
def top(spark, sf_dir):
    return R.top_contributor(view(spark, sf_dir, "traffic_cells"), ["leg_id"], "ship_type", "freq")


@query("rep_pivot", oracle("SELECT ship_type, " + ", ".join(f'sum(freq) FILTER (WHERE leg_id = {i}) AS leg_{i}' for i in range(1, 26)) + " FROM traffic_cells GROUP BY 1", "traffic_cells"))
def pivot(spark, sf_dir):
    p = R.pivoted(view(spark, sf_dir, "traffic_cells"), ["ship_type"], "leg_id", list(range(1, 26)), "freq")
    return p.select("ship_type", *[F.col(str(i)).alias(f"leg_{i}") for i in range(1, 26)])


@query("rep_classes", oracle("WITH g AS (SELECT leg_id, ship_type, sum(freq) AS v FROM traffic_cells GROUP BY 1, 2), m AS (SELECT min(v) AS lo, max(v) AS hi FROM g WHERE v > 0) SELECT leg_id, ship_type, v, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / 5)), 4) END AS INTEGER) AS class FROM g, m WHERE v > 0", "traffic_cells"))
def class_rows(spark, sf_dir):
    return R.classes(view(spark, sf_dir, "traffic_cells").groupBy("leg_id", "ship_type").agg(F.sum("freq").alias("v")), "v")


@query("rep_compare", oracle("""WITH a AS (SELECT project_id, sum(total_freq) * 1e9 AS a FROM runs WHERE run_id % 2 = 0 GROUP BY 1), b AS (SELECT project_id, sum(total_freq) * 1e9 AS b FROM runs WHERE run_id % 3 = 0 GROUP BY 1)
SELECT project_id, round(a, 2) AS a, round(b, 2) AS b, round(b - a, 2) AS delta, round(CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a <> 0 THEN (b - a) / a * 100 ELSE 0 END, 6) AS delta_pct FROM a FULL JOIN b USING (project_id)""", "runs"))
def compare(spark, sf_dir):
    runs = view(spark, sf_dir, "runs")
    part = lambda k: runs.where(F.col("run_id") % k == 0).groupBy("project_id").agg((F.sum("total_freq") * 1e9).alias("v"))
    c = R.compared(part(2), part(3), "project_id", "v")
    return c.select("project_id", *[F.round(n, 2).alias(n) for n in ("a", "b", "delta")], F.round("delta_pct", 6).alias("delta_pct"))


@query("rep_against_first", oracle("SELECT run_id, project_id, round((total_freq - first_value(total_freq) OVER w) / first_value(total_freq) OVER w * 100, 6) AS delta_pct FROM runs WINDOW w AS (PARTITION BY project_id ORDER BY run_id)", "runs"))
def against_first(spark, sf_dir):
    return R.against_first(view(spark, sf_dir, "runs"), "project_id", "run_id", "total_freq").select("run_id", "project_id", F.round("delta_pct", 6).alias("delta_pct"))


@query("rep_differences", oracle("""WITH a AS (SELECT run_id, total_freq * 1e9 AS a FROM runs WHERE run_id % 5 <> 0), b AS (SELECT run_id, total_freq * 1e9 + CASE WHEN run_id % 4 = 0 THEN 1e0 ELSE 0e0 END AS b FROM runs WHERE run_id % 7 <> 0)
SELECT run_id, round(a, 3) AS a, round(b, 3) AS b FROM a FULL JOIN b USING (run_id) WHERE a IS NULL OR b IS NULL OR run_id % 4 = 0""", "runs"))
def difference_rows(spark, sf_dir):
    runs = view(spark, sf_dir, "runs").select("run_id", (F.col("total_freq") * 1e9).alias("v"))
    changed = runs.withColumn("v", F.col("v") + F.when(F.col("run_id") % 4 == 0, 1.0).otherwise(0.0))
    d = R.differences(runs.where("run_id % 5 <> 0"), changed.where("run_id % 7 <> 0"), ["run_id"], "v")
    return d.select("run_id", F.round("a", 3).alias("a"), F.round("b", 3).alias("b"))


_BLOCK = "CASE " + " ".join(f"WHEN ship_type = {i} THEN {X.num(b)}" for i, b in enumerate(D.BLOCKS)) + f" ELSE {X.num(D.BLOCK)} END"


@query("drf_squat", oracle(f"SELECT leg_id, dir_idx, ship_type, size_bin, round(CASE WHEN speed_kn > 0 THEN {_BLOCK} * speed_kn * speed_kn / 100e0 ELSE 0e0 END + 1e-9, 5) AS squat_m FROM traffic_cells", "traffic_cells"))
def squat_rows(spark, sf_dir):
    cells = view(spark, sf_dir, "traffic_cells")
    return cells.select("leg_id", "dir_idx", "ship_type", "size_bin", F.round(D.squat_m(F.col("speed_kn"), D.block_coefficient(F.col("ship_type"))) + 1e-9, 5).alias("squat_m"))
