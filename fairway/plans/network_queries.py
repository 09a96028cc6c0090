"""Queries of legs, waypoints and junctions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairway.functions import expr as X
from fairway.operators import network as N

from .adapters import oracle, view

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _legs(spark, sf_dir):
    return view(spark, sf_dir, "legs")


#: Legs that cross the lattice, so that there is something to find.
_DIAGONAL = "SELECT leg_id + 100 AS leg_id, lon1 - 3e-2 AS lon1, lat1 - 4e-2 AS lat1, lon1 + 6e-2 AS lon2, lat1 + 5e-2 AS lat2, width_m FROM {legs}"


def _crossed(spark, sf_dir):
    legs = _legs(spark, sf_dir)
    return legs.unionByName(spark.sql(_DIAGONAL, legs=legs))


_ENDS = f"""WITH e AS (SELECT leg_id, 'start' AS side, lon1 AS lon, lat1 AS lat, lon2 AS fl, lat2 AS ft FROM legs UNION ALL SELECT leg_id, 'end', lon2, lat2, lon1, lat1 FROM legs),
k AS (SELECT *, 'j_' || printf('%.6f', round(lon, 6)) || '_' || printf('%.6f', round(lat, 6)) AS junction_id, {X.outward('lon', 'lat', 'fl', 'ft')} AS bearing FROM e),
c AS (SELECT junction_id, count(DISTINCT leg_id) AS n_legs FROM k GROUP BY 1 HAVING count(DISTINCT leg_id) >= 2),
j AS (SELECT k.*, n_legs FROM k JOIN c USING (junction_id))
"""
_GEOMETRIC = f"""{_ENDS}, p AS (SELECT a.junction_id, a.leg_id AS in_leg, b.leg_id AS out_leg, 180e0 - {X.turn('a.bearing', 'b.bearing')} AS deflection FROM j a JOIN j b ON a.junction_id = b.junction_id AND a.leg_id <> b.leg_id),
g AS (SELECT *, exp(-deflection / 3e1) / sum(exp(-deflection / 3e1)) OVER (PARTITION BY junction_id, in_leg) AS share FROM p)
"""


@query("net_lengths", oracle(f"SELECT leg_id, round({X.haversine('lon1', 'lat1', 'lon2', 'lat2', X.EARTH_ROUTE_M)}, 3) AS length_m, CASE WHEN b >= 315 OR b < 45 THEN 'North' WHEN b < 135 THEN 'East' WHEN b < 225 THEN 'South' ELSE 'West' END AS heading, printf('%.6f %.6f', lon1, lat1) AS start_point FROM (SELECT *, {X.bearing('lon1', 'lat1', 'lon2', 'lat2')} AS b FROM legs)", "legs"))
def lengths(spark, sf_dir):
    legs = N.with_length(_legs(spark, sf_dir))
    return legs.select("leg_id", F.round("length_m", 3).alias("length_m"), N.compass(F.expr(X.bearing("lon1", "lat1", "lon2", "lat2"))).alias("heading"), N.format_point(F.col("lon1"), F.col("lat1")).alias("start_point"))


@query("net_junctions", oracle(_ENDS + "SELECT junction_id, leg_id, side, round(bearing, 6) AS bearing, n_legs FROM j", "legs"))
def junction_rows(spark, sf_dir):
    return N.junctions(_legs(spark, sf_dir)).withColumn("bearing", F.round("bearing", 6))


@query("net_geometric_shares", oracle(_GEOMETRIC + "SELECT junction_id, in_leg, out_leg, round(deflection, 4) AS deflection, round(share, 6) AS share FROM g", "legs"))
def geometric(spark, sf_dir):
    g = N.geometric_shares(N.junctions(_legs(spark, sf_dir)))
    return g.select("junction_id", "in_leg", "out_leg", F.round("deflection", 4).alias("deflection"), F.round("share", 6).alias("share"))


@query("net_chosen_shares", oracle(_GEOMETRIC + """, u AS (SELECT junction_id, in_leg, out_leg, 5e-1 AS share FROM g WHERE in_leg % 3 = 0), m AS (SELECT junction_id, in_leg, out_leg, share FROM g WHERE in_leg % 2 = 0)
SELECT junction_id, in_leg, out_leg, round(CASE WHEN in_leg % 3 = 0 THEN 5e-1 ELSE share END, 6) AS share, CASE WHEN in_leg % 3 = 0 THEN 'user' WHEN in_leg % 2 = 0 THEN 'ais' ELSE 'geometry' END AS source FROM g""", "legs"))
def chosen(spark, sf_dir):
    g = N.geometric_shares(N.junctions(_legs(spark, sf_dir)))
    user = g.where("in_leg % 3 = 0").withColumn("share", F.lit(0.5))
    return N.chosen_shares(g, g.where("in_leg % 2 = 0"), user).withColumn("share", F.round("share", 6))


@query("net_share_findings", oracle(_GEOMETRIC + """, s AS (SELECT junction_id, in_leg, CASE WHEN out_leg % 7 = 0 THEN out_leg + 1000 ELSE out_leg END AS out_leg, CASE WHEN in_leg % 4 = 0 THEN share / 2 ELSE share END AS share FROM g WHERE in_leg % 5 <> 0)
SELECT junction_id, in_leg, 'row_sum' AS "check" FROM s GROUP BY 1, 2 HAVING abs(sum(share) - 1) > 1e-6
UNION ALL SELECT DISTINCT junction_id, leg_id, 'missing_row' FROM j WHERE (junction_id, leg_id) NOT IN (SELECT (junction_id, in_leg) FROM s)
UNION ALL SELECT DISTINCT junction_id, out_leg, 'unknown_leg' FROM s WHERE (junction_id, out_leg) NOT IN (SELECT (junction_id, leg_id) FROM j)""", "legs"))
def findings(spark, sf_dir):
    ends = N.junctions(_legs(spark, sf_dir))
    g = N.geometric_shares(ends).where("in_leg % 5 <> 0")
    g = g.withColumn("out_leg", F.when(F.col("out_leg") % 7 == 0, F.col("out_leg") + 1000).otherwise(F.col("out_leg"))).withColumn("share", F.when(F.col("in_leg") % 4 == 0, F.col("share") / 2).otherwise(F.col("share")))
    return N.share_findings(g, ends)


_X = f"""WITH l AS (SELECT * FROM legs UNION ALL {_DIAGONAL.format(legs='legs')}),
p AS (SELECT a.leg_id AS leg_a, b.leg_id AS leg_b, a.lon1 AS x, a.lat1 AS y, a.lon2 - a.lon1 AS dx, a.lat2 - a.lat1 AS dy, b.lon1 AS bx, b.lat1 AS "by", b.lon2 - b.lon1 AS ex, b.lat2 - b.lat1 AS ey FROM l a JOIN l b ON a.leg_id < b.leg_id),
q AS (SELECT *, nullif(dx * ey - dy * ex, 0) AS det FROM p), r AS (SELECT *, ((bx - x) * ey - ("by" - y) * ex) / det AS t, ((bx - x) * dy - ("by" - y) * dx) / det AS u FROM q),
i AS (SELECT * FROM r WHERE t BETWEEN 1e-9 AND 1 - 1e-9 AND u BETWEEN 1e-9 AND 1 - 1e-9)
"""


@query("net_intersections", oracle(_X + "SELECT leg_a, leg_b, round(t, 6) AS t, round(u, 6) AS u, round(x + t * dx, 6) AS lon, round(y + t * dy, 6) AS lat FROM i", "legs"))
def crossing_rows(spark, sf_dir):
    c = N.intersections(_crossed(spark, sf_dir))
    return c.select("leg_a", "leg_b", *[F.round(n, 6).alias(n) for n in ("t", "u", "lon", "lat")])


@query("net_split_legs", oracle(_X + """, c AS (SELECT leg_a AS leg_id, t FROM i UNION SELECT leg_b, u FROM i UNION SELECT leg_id, 0e0 FROM l), n AS (SELECT *, lead(t, 1, 1e0) OVER (PARTITION BY leg_id ORDER BY t) AS t2, row_number() OVER (PARTITION BY leg_id ORDER BY t) - 1 AS part FROM c)
SELECT n.leg_id AS parent_id, CAST(part AS INTEGER) AS part, round(lon1 + t * (lon2 - lon1), 6) AS a_lon, round(lat1 + t * (lat2 - lat1), 6) AS a_lat, round(lon1 + t2 * (lon2 - lon1), 6) AS b_lon, round(lat1 + t2 * (lat2 - lat1), 6) AS b_lat FROM n JOIN l USING (leg_id)""", "legs"))
def split_rows(spark, sf_dir):
    legs = _crossed(spark, sf_dir)
    s = N.split_legs(legs, N.intersections(legs))
    return s.select("parent_id", "part", *[F.round(n, 6).alias(n) for n in ("a_lon", "a_lat", "b_lon", "b_lat")])


@query("net_bounding_box", oracle("WITH b AS (SELECT min(least(lon1, lon2)) AS w, min(least(lat1, lat2)) AS s, max(greatest(lon1, lon2)) AS e, max(greatest(lat1, lat2)) AS n FROM legs) SELECT round(w - (e - w) * 1e-1, 6) AS west, round(s - (n - s) * 1e-1, 6) AS south, round(e + (e - w) * 1e-1, 6) AS east, round(n + (n - s) * 1e-1, 6) AS north FROM b", "legs"))
def box(spark, sf_dir):
    b = N.bounding_box(_legs(spark, sf_dir), 10.0)
    return b.select(*[F.round(c, 6).alias(c) for c in b.columns])


@query("net_close_waypoints", oracle(f"""WITH l AS (SELECT * FROM legs UNION ALL SELECT leg_id + 200, lon1 + 2e-3, lat1 + 1e-3, lon2 + 3e-2, lat2 + 3e-2, width_m FROM legs), e AS (SELECT *, {X.haversine('lon1', 'lat1', 'lon2', 'lat2', X.EARTH_ROUTE_M)} AS m FROM l),
p AS (SELECT round(lon, 6) AS lon, round(lat, 6) AS lat, min(m) AS m FROM (SELECT lon1 AS lon, lat1 AS lat, m FROM e UNION ALL SELECT lon2, lat2, m FROM e) GROUP BY 1, 2), k AS (SELECT *, printf('%.6f %.6f', lon, lat) AS k FROM p),
d AS (SELECT a.k AS a, b.k AS b, least(a.m, b.m) AS m, {X.haversine('a.lon', 'a.lat', 'b.lon', 'b.lat', X.EARTH_ROUTE_M)} AS d FROM k a JOIN k b ON a.k < b.k) SELECT a, b, round(d, 3) AS distance_m FROM d WHERE d < 5e-2 * m""", "legs"))
def close(spark, sf_dir):
    legs = _legs(spark, sf_dir)
    moved = spark.sql("SELECT leg_id + 200 AS leg_id, lon1 + 2e-3 AS lon1, lat1 + 1e-3 AS lat1, lon2 + 3e-2 AS lon2, lat2 + 3e-2 AS lat2, width_m FROM {legs}", legs=legs)
    return N.close_waypoints(legs.unionByName(moved)).withColumn("distance_m", F.round("distance_m", 3))
