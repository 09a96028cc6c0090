"""Further queries of networks, depth bins, sources and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairway.functions import expr as X
from fairway.operators import network as N
from fairway.operators import powered as W
from fairway.operators import reports as R
from fairway.sources import tables

from .adapters import oracle, view

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("net_next_legs", oracle(f"""WITH a AS (SELECT leg_id, round(lon2, 6) AS x, round(lat2, 6) AS y, {X.outward('lon1', 'lat1', 'lon2', 'lat2')} AS b FROM legs), s AS (SELECT leg_id, round(lon1, 6) AS x, round(lat1, 6) AS y, {X.outward('lon1', 'lat1', 'lon2', 'lat2')} AS b FROM legs),
j AS (SELECT a.leg_id, s.leg_id AS next_leg, {X.turn('a.b', 's.b')} AS bend, row_number() OVER (PARTITION BY a.leg_id ORDER BY s.leg_id) AS n FROM a JOIN s ON a.x = s.x AND a.y = s.y AND a.leg_id <> s.leg_id) SELECT leg_id, next_leg, round(bend, 6) AS bend_deg FROM j WHERE n = 1""", "legs"))
def next_legs(spark, sf_dir):
    return N.next_legs(view(spark, sf_dir, "legs")).withColumn("bend_deg", F.round("bend_deg", 6))


@query("net_merged_waypoints", oracle(f"""WITH m AS (SELECT DISTINCT printf('%.6f %.6f', lon1, lat1) AS k, lon1 + 1e-3 AS lon, lat1 - 1e-3 AS lat FROM legs WHERE leg_id % 4 = 0), l AS (SELECT leg_id, coalesce(a.lon, lon1) AS lon1, coalesce(a.lat, lat1) AS lat1, coalesce(b.lon, lon2) AS lon2, coalesce(b.lat, lat2) AS lat2
FROM legs LEFT JOIN m a ON a.k = printf('%.6f %.6f', lon1, lat1) LEFT JOIN m b ON b.k = printf('%.6f %.6f', lon2, lat2)) SELECT leg_id, round({X.haversine('lon1', 'lat1', 'lon2', 'lat2', X.EARTH_ROUTE_M)}, 3) AS length_m FROM l""", "legs"))
def merged(spark, sf_dir):
    legs = view(spark, sf_dir, "legs")
    merges = legs.where("leg_id % 4 = 0").select(N.format_point(F.col("lon1"), F.col("lat1")).alias("key"), F.expr("lon1 + 1e-3").alias("lon"), F.expr("lat1 - 1e-3").alias("lat")).distinct()
    return N.with_length(N.merge_waypoints(legs, merges)).select("leg_id", F.round("length_m", 3).alias("length_m"))


@query("pow_depth_bins", oracle("SELECT leg_id, dir_idx, ship_type, size_bin, (SELECT max(value_m) FROM obstacles WHERE kind = 'depth' AND value_m <= draught_m) AS bin_m FROM traffic_cells", "traffic_cells", "obstacles"))
def depth_bins(spark, sf_dir):
    depths = view(spark, sf_dir, "obstacles").where("kind = 'depth'").select("value_m")
    return W.depth_bins(view(spark, sf_dir, "traffic_cells"), depths).select("leg_id", "dir_idx", "ship_type", "size_bin", "bin_m")


@query("pow_closed_form", oracle(f"SELECT leg_id, dir_idx, ship_type, size_bin, round(16e-5 * freq * 1e-1 * exp(-2e3 / (180e0 * speed_kn * {X.num(X.KNOT_MS)})) * 1e6, 6) AS frequency_e6, round(180e0 * speed_kn * {X.num(X.KNOT_MS)}, 4) AS recovery_m FROM traffic_cells WHERE speed_kn > 0", "traffic_cells"))
def closed_form(spark, sf_dir):
    cells = view(spark, sf_dir, "traffic_cells").where("speed_kn > 0")
    value = W.closed_form(F.col("freq"), F.lit(0.1), F.lit(2000.0), F.col("speed_kn"), 1.6e-4) * 1e6
    return cells.select("leg_id", "dir_idx", "ship_type", "size_bin", F.round(value, 6).alias("frequency_e6"), F.round(W.recovery_m(F.col("speed_kn")), 4).alias("recovery_m"))


@query("rep_drill_down", oracle("SELECT leg_id, ship_type, v FROM (SELECT leg_id, ship_type, sum(freq) AS v FROM traffic_cells GROUP BY 1, 2) ORDER BY v DESC, leg_id, ship_type LIMIT 20", "traffic_cells"))
def drill_down(spark, sf_dir):
    return R.drill_down(view(spark, sf_dir, "traffic_cells").groupBy("leg_id", "ship_type").agg(F.sum("freq").alias("v")), "v", 20)


@query("rep_run_totals", oracle("SELECT leg_id AS scenario_id, coalesce(sum(freq) FILTER (WHERE dir_idx = 0), 0e0) AS grounding, coalesce(sum(freq) FILTER (WHERE dir_idx = 1), 0e0) AS allision, 0e0 AS bend FROM traffic_cells GROUP BY 1", "traffic_cells"))
def run_totals(spark, sf_dir):
    facts = view(spark, sf_dir, "traffic_cells").select(F.col("leg_id").alias("scenario_id"), F.when(F.col("dir_idx") == 0, "grounding").otherwise("allision").alias("kind"), F.col("freq").alias("frequency"))
    return R.run_totals(facts, ["grounding", "allision", "bend"])


@query("rep_leg_lengths", oracle(f"WITH a AS (SELECT leg_id, {X.haversine('lon1', 'lat1', 'lon2', 'lat2', X.EARTH_ROUTE_M)} AS m FROM legs) SELECT leg_id, round(a.m, 3) AS a_m, round(b.m, 3) AS b_m, round(b.m - a.m, 3) AS delta_m FROM (SELECT * FROM a WHERE leg_id % 5 <> 0) a FULL JOIN (SELECT leg_id, m * 101e-2 AS m FROM a WHERE leg_id % 7 <> 0) b USING (leg_id)", "legs"))
def leg_lengths(spark, sf_dir):
    legs = N.with_length(view(spark, sf_dir, "legs"))
    out = R.leg_lengths(legs.where("leg_id % 5 <> 0"), legs.where("leg_id % 7 <> 0").withColumn("length_m", F.col("length_m") * 1.01))
    return out.select("leg_id", *[F.round(c, 3).alias(c) for c in ("a_m", "b_m", "delta_m")])


@query("rep_moved_ends", oracle(f"WITH e AS (SELECT leg_id, 'start' AS side, lon1 AS lon, lat1 AS lat FROM legs UNION ALL SELECT leg_id, 'end', lon2, lat2 FROM legs), m AS (SELECT leg_id, side, {X.haversine('lon', 'lat', 'lon + 1e-4 * (leg_id % 9)', 'lat', X.EARTH_ROUTE_M)} AS d FROM e) SELECT leg_id, side, round(d, 3) AS moved_m FROM m WHERE d >= 25", "legs"))
def moved_ends(spark, sf_dir):
    ends = N.leg_ends(view(spark, sf_dir, "legs")).select("leg_id", "side", "lon", "lat")
    now = ends.withColumn("lon", F.expr("lon + 1e-4 * (leg_id % 9)"))
    return R.moved_ends(now, ends).withColumn("moved_m", F.round("moved_m", 3))


@query("rep_by_direction", oracle("SELECT ship_type, sum(freq) AS freq, round(sum(freq * speed_kn) / sum(freq), 6) AS speed_kn, round(sum(freq * draught_m) / sum(freq), 6) AS draught_m FROM traffic_cells GROUP BY 1", "traffic_cells"))
def by_direction(spark, sf_dir):
    out = R.by_direction(view(spark, sf_dir, "traffic_cells"), "ship_type", "freq", ["speed_kn", "draught_m"])
    return out.select("ship_type", "freq", F.round("speed_kn", 6).alias("speed_kn"), F.round("draught_m", 6).alias("draught_m"))


@query("src_depth_bands", "SELECT p_partkey, -p_size / 2e0 AS z, CASE WHEN p_size / 2e0 > 0 AND p_size / 2e0 <= 3 THEN 3e0 WHEN p_size / 2e0 <= 6 THEN 6e0 WHEN p_size / 2e0 <= 10 THEN 1e1 WHEN p_size / 2e0 <= 20 THEN 2e1 END AS band_m FROM part WHERE p_size > 0 AND p_size / 2e0 <= 20")
def depth_bands(spark, sf_dir):
    cells = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (-F.col("p_size").cast("double") / 2).alias("z"))
    return tables.depth_bands(cells, [0, 3, 6, 10, 20])


@query("src_matrix_cells", oracle("SELECT leg_id, dir_idx, ship_type, size_bin, freq, speed_kn FROM (SELECT leg_id, dir_idx, ship_type, size_bin, CASE WHEN ship_type % 5 = 1 THEN 0e0 ELSE freq END AS freq, round(speed_kn, 3) AS speed_kn FROM traffic_cells) WHERE freq > 0", "traffic_cells"))
def matrix_cells(spark, sf_dir):
    cells = view(spark, sf_dir, "traffic_cells").withColumn("freq", F.when(F.col("ship_type") % 5 == 1, 0.0).otherwise(F.col("freq"))).withColumn("speed_kn", F.round("speed_kn", 3))
    # At most 21 types of 15 sizes in a matrix.
    rows = cells.groupBy("leg_id", "dir_idx").agg(F.map_from_entries(F.collect_list(F.struct(F.col("ship_type") * 15 + F.col("size_bin"), F.struct("freq", "speed_kn")))).alias("m"))
    matrix = lambda n: F.transform(F.sequence(F.lit(0), F.lit(20)), lambda t: F.transform(F.sequence(F.lit(0), F.lit(14)), lambda s: F.coalesce(F.try_element_at("m", t * 15 + s)[n].cast("string"), F.lit(""))))
    return tables.matrix_cells(rows.select("leg_id", "dir_idx", matrix("freq").alias("freq"), matrix("speed_kn").alias("speed_kn")), ["freq", "speed_kn"])


@query("src_registry", "SELECT c_custkey AS mmsi, CAST(c_acctbal AS DOUBLE) AS loa_m, CAST(NULL AS DOUBLE) AS beam_m, CAST(c_nationkey AS INTEGER) AS ship_type, CAST(NULL AS DOUBLE) AS air_draught_m FROM customer")
def registry(spark, sf_dir):
    return tables.mapped_registry(spark.read.parquet(f"{sf_dir}/customer.parquet"), {"mmsi": "c_custkey", "loa_m": "c_acctbal", "ship_type": "c_nationkey", "beam_m": None})


@query("src_defaults", oracle("WITH s AS (SELECT DISTINCT leg_id AS scenario_id FROM traffic_cells), v AS (SELECT leg_id AS scenario_id, CASE WHEN leg_id % 2 = 0 THEN 'anchor_p' ELSE 'speed' END AS name, CASE WHEN leg_id % 3 = 0 THEN NULL ELSE max(speed_kn) END AS value FROM traffic_cells GROUP BY 1, 2, leg_id % 3) SELECT s.scenario_id, d.name, round(coalesce(value, d), 6) AS value FROM s CROSS JOIN (VALUES ('anchor_p', 7e-1), ('anchor_d', 7e0), ('speed', 1e0)) d(name, d) LEFT JOIN v ON v.scenario_id = s.scenario_id AND v.name = d.name", "traffic_cells"))
def defaults(spark, sf_dir):
    v = view(spark, sf_dir, "traffic_cells").groupBy(F.col("leg_id").alias("scenario_id")).agg(F.max("speed_kn").alias("value"))
    v = v.select("scenario_id", F.when(F.col("scenario_id") % 2 == 0, "anchor_p").otherwise("speed").alias("name"), F.when(F.col("scenario_id") % 3 != 0, F.col("value")).alias("value"))
    return tables.with_defaults(v, {"anchor_p": 0.7, "anchor_d": 7.0, "speed": 1.0}).withColumn("value", F.round("value", 6))
