"""Queries of passages and traffic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairway.functions import expr as X
from fairway.operators import passages as P
from fairway.operators import tracks as T

from .adapters import oracle, view
from .track_queries import _SEGMENTS, GAP

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_MID = "(lon1 + lon2) / 2e0", "(lat1 + lat2) / 2e0"
_BEARING = X.bearing("lon1", "lat1", "lon2", "lat2")
_ENDS = ", ".join(
    f"{X.destination_lon('ml', 'mt', s, 'width_m / 2e0')} AS plon{k}, {X.destination_lat('mt', s, 'width_m / 2e0')} AS plat{k}" for k, s in ((1, "b - 90e0"), (2, "b + 90e0"))
)
_LINES = f"lb AS (SELECT *, {_BEARING} AS b, {_MID[0]} AS ml, {_MID[1]} AS mt FROM legs), pl AS (SELECT leg_id, b, width_m, {_ENDS} FROM lb)"
_CROSSED = f"""{_SEGMENTS}, {_LINES}, cx AS (SELECT h.*, pl.*, lon2 - lon1 AS dx, lat2 - lat1 AS dy, plon2 - plon1 AS px, plat2 - plat1 AS py FROM h, pl
  WHERE least(lon1, lon2) <= greatest(plon1, plon2) AND least(plon1, plon2) <= greatest(lon1, lon2) AND least(lat1, lat2) <= greatest(plat1, plat2) AND least(plat1, plat2) <= greatest(lat1, lat2)),
cy AS (SELECT *, dx * py - dy * px AS det FROM cx), cz AS (SELECT *, ((plon1 - lon1) * py - (plat1 - lat1) * px) / det AS w, ((plon1 - lon1) * dy - (plat1 - lat1) * dx) / det AS u FROM cy WHERE det <> 0),
pass AS (SELECT *, (u - 5e-1) * width_m AS offset_m, {X.turn('cog', 'b')} AS along FROM cz WHERE w BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1),
dirs AS (SELECT *, CASE WHEN along < 60e0 THEN 0 WHEN 180e0 - along < 60e0 THEN 1 END AS dir_idx FROM pass)"""


def _crossed(spark, sf_dir):
    pings = T.one_per_time(view(spark, sf_dir, "pings"))
    s = T.segments(T.long_enough(T.split(pings, max_gap_s=GAP)))
    return P.lateral_offset(P.crossings(s, view(spark, sf_dir, "legs")))


@query("pas_lines", oracle(f"WITH {_LINES} SELECT leg_id, round(b, 6) AS bearing, round(plon1, 7) AS pl_lon1, round(plat1, 7) AS pl_lat1, round(plon2, 7) AS pl_lon2, round(plat2, 7) AS pl_lat2 FROM pl", "legs"))
def lines(spark, sf_dir):
    p = P.passage_lines(view(spark, sf_dir, "legs"))
    return p.select("leg_id", F.round("bearing", 6).alias("bearing"), *[F.round(c, 7).alias(c) for c in ("pl_lon1", "pl_lat1", "pl_lon2", "pl_lat2")])


@query("pas_crossings", oracle(_CROSSED + "SELECT leg_id, mmsi, t1, round(u, 6) AS u, round(w, 6) AS w, round(offset_m, 2) AS offset_m FROM pass", "pings", "legs"))
def crossed(spark, sf_dir):
    return _crossed(spark, sf_dir).select("leg_id", "mmsi", "t1", F.round("u", 6).alias("u"), F.round("w", 6).alias("w"), F.round("offset_m", 2).alias("offset_m"))


@query("pas_lateral", oracle(_CROSSED + """SELECT leg_id, dir_idx, count(*) AS n, round(avg(offset_m), 3) AS mean_m, round(stddev_pop(offset_m), 3) AS std_m, round(min(offset_m), 3) AS min_m, round(max(offset_m), 3) AS max_m
FROM dirs WHERE dir_idx IS NOT NULL GROUP BY 1, 2""", "pings", "legs"))
def lateral(spark, sf_dir):
    fit = P.lateral_fit(P.direction(_crossed(spark, sf_dir), 60.0))
    return fit.select("leg_id", "dir_idx", "n", *[F.round(c, 3).alias(c) for c in ("mean_m", "std_m", "min_m", "max_m")])


_BIN = "CASE WHEN CAST(ceil(CAST(trunc(coalesce({0}, 100)) AS INT) / 25e0) AS INT) - 1 BETWEEN 0 AND 14 THEN CAST(ceil(CAST(trunc(coalesce({0}, 100)) AS INT) / 25e0) AS INT) - 1 ELSE 14 END"


@query("pas_traffic", oracle(_CROSSED + f"""SELECT leg_id, dir_idx, coalesce(ship_type, 20) AS ship_type, {_BIN.format('loa_m')} AS size_bin, 2e0 * count(*) AS freq, round(avg(sog), 7) AS speed_kn, round(avg(beam_m), 7) AS beam_m, round(avg(air_draught_m), 7) AS height_m
FROM dirs LEFT JOIN registry USING (mmsi) WHERE dir_idx IS NOT NULL GROUP BY 1, 2, 3, 4""", "pings", "legs", "registry"))
def traffic_table(spark, sf_dir):
    ships = P.direction(_crossed(spark, sf_dir), 60.0).join(view(spark, sf_dir, "registry"), "mmsi", "left")
    ships = ships.withColumn("size_bin", P.length_bin(F.col("loa_m"))).withColumn("ship_type", F.coalesce("ship_type", F.lit(P.OTHER_TYPE))).withColumnRenamed("sog", "speed_kn").withColumnRenamed("air_draught_m", "height_m")
    t = P.traffic(ships, 2.0)
    return t.select("leg_id", "dir_idx", "ship_type", "size_bin", "freq", *[F.round(c, 7).alias(c) for c in ("speed_kn", "beam_m", "height_m")])


@query("pas_coverage", oracle("""WITH g AS (SELECT t_s, t_s - lag(t_s) OVER (ORDER BY t_s) AS gap FROM pings), s AS (SELECT max(t_s) - min(t_s) AS span_s, sum(CASE WHEN gap > 600e0 THEN gap ELSE 0e0 END) AS gaps_s FROM g)
SELECT round(span_s, 3) AS span_s, round(gaps_s, 3) AS gaps_s, round(span_s - gaps_s, 3) AS covered_s, round(CASE WHEN span_s > gaps_s THEN 365e0 * 86400e0 / (span_s - gaps_s) END, 6) AS multiplier FROM s""", "pings"))
def coverage_row(spark, sf_dir):
    c = P.coverage(view(spark, sf_dir, "pings"), max_gap_s=600.0)
    return c.select(*[F.round(n, 3).alias(n) for n in ("span_s", "gaps_s", "covered_s")], F.round("multiplier", 6).alias("multiplier"))


@query("pas_dense", oracle("""SELECT g.leg_id, CAST(d AS INTEGER) AS dir_idx, CAST(t AS INTEGER) AS ship_type, CAST(s AS INTEGER) AS size_bin, coalesce(x.freq, 0e0) AS freq, 100e0 AS scaling
FROM (SELECT leg_id, d, t, s FROM legs CROSS JOIN range(2) a(d) CROSS JOIN range(21) b(t) CROSS JOIN range(15) c(s)) g
LEFT JOIN traffic_cells x ON x.leg_id = g.leg_id AND x.dir_idx = g.d AND x.ship_type = g.t AND x.size_bin = g.s""", "legs", "traffic_cells"))
def dense_table(spark, sf_dir):
    return P.dense(view(spark, sf_dir, "traffic_cells"), view(spark, sf_dir, "legs")).select("leg_id", "dir_idx", "ship_type", "size_bin", "freq", "scaling")


@query("pas_scaled", oracle("SELECT leg_id, dir_idx, ship_type, size_bin, freq * (CASE WHEN ship_type % 2 = 0 THEN 80e0 ELSE 100e0 + size_bin END) / 100e0 AS freq FROM traffic_cells", "traffic_cells"))
def scaled_table(spark, sf_dir):
    scale = P.follow_global((100 + F.col("size_bin")).cast("double"), F.col("ship_type") % 2 == 0, F.lit(80.0))
    return P.scaled(view(spark, sf_dir, "traffic_cells"), scale).select("leg_id", "dir_idx", "ship_type", "size_bin", "freq")


@query("pas_exposure", oracle(f"""WITH l AS (SELECT leg_id, {X.haversine('lon1', 'lat1', 'lon2', 'lat2')} AS m FROM legs)
SELECT leg_id, dir_idx, round(sum(freq * m / (speed_kn * {X.num(X.KNOT_MS)})), 2) AS ship_s, round(sum(freq * speed_kn) / sum(freq), 6) AS speed_kn FROM traffic_cells JOIN l USING (leg_id) WHERE speed_kn > 0 AND freq > 0 GROUP BY 1, 2""", "legs", "traffic_cells"))
def exposure(spark, sf_dir):
    cells, legs = view(spark, sf_dir, "traffic_cells"), view(spark, sf_dir, "legs")
    return P.ship_seconds(cells, legs).join(P.mean_speed(cells), ["leg_id", "dir_idx"]).select("leg_id", "dir_idx", F.round("ship_s", 2).alias("ship_s"), F.round("speed_kn", 6).alias("speed_kn"))


_RATIOS = "SELECT ship_type, size_bin, avg(beam_m) AS ref_beam_m, avg(draught_m) AS ref_draught_m FROM {0} WHERE size_bin % 2 = 0 GROUP BY 1, 2"


@query("pas_imputed", oracle(f"""WITH q AS ({_RATIOS.format('traffic_cells')}), z AS (SELECT leg_id, dir_idx, ship_type, size_bin, CASE WHEN leg_id % 3 = 0 THEN 0e0 ELSE beam_m END AS beam_m, CASE WHEN leg_id % 2 = 0 THEN NULL ELSE draught_m END AS draught_m FROM traffic_cells)
SELECT leg_id, dir_idx, z.ship_type, z.size_bin, round(coalesce(nullif(beam_m, 0e0), round(ref_beam_m, 2)), 3) AS beam_m, round(coalesce(nullif(draught_m, 0e0), round(ref_draught_m, 2), (z.size_bin * 25 + 125e-1) / 12), 3) AS draught_m
FROM z LEFT JOIN q ON q.ship_type = z.ship_type AND q.size_bin = z.size_bin""", "traffic_cells"))
def imputed_table(spark, sf_dir):
    cells = view(spark, sf_dir, "traffic_cells")
    ratios = spark.sql(_RATIOS.format("{cells}"), cells=cells)
    holes = cells.select("leg_id", "dir_idx", "ship_type", "size_bin", F.when(F.col("leg_id") % 3 == 0, 0.0).otherwise(F.col("beam_m")).alias("beam_m"), F.when(F.col("leg_id") % 2 != 0, F.col("draught_m")).alias("draught_m"))
    out = P.imputed(holes, ratios)
    return out.select("leg_id", "dir_idx", "ship_type", "size_bin", F.round("beam_m", 3).alias("beam_m"), F.round("draught_m", 3).alias("draught_m"))


_VISITS = "SELECT CAST(user_id % 10 AS BIGINT) AS junction_id, user_id AS mmsi, CAST(event_id % 4 AS BIGINT) AS leg_id, {us} / 1e6 AS t_s FROM {events}"


@query("pas_transitions", f"""WITH v AS ({_VISITS.format(us='CAST(epoch_us(ts) AS DOUBLE)', events='events')}),
f AS (SELECT junction_id, mmsi, leg_id, min(t_s) AS t_s FROM v GROUP BY 1, 2, 3), o AS (SELECT *, lag(t_s) OVER w AS t0, lag(leg_id) OVER w AS leg0 FROM f WINDOW w AS (PARTITION BY junction_id, mmsi ORDER BY t_s, leg_id)),
c AS (SELECT junction_id, leg0 AS in_leg, leg_id AS out_leg, count(*) AS n FROM o WHERE t_s - t0 <= 8e5 AND leg0 <> leg_id GROUP BY 1, 2, 3)
SELECT *, round(n / sum(n) OVER (PARTITION BY junction_id, in_leg), 6) AS share FROM c""")
def transition_shares(spark, sf_dir):
    visits = spark.sql(_VISITS.format(us="CAST(unix_micros(CAST(ts AS TIMESTAMP)) AS DOUBLE)", events="{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return P.shares(P.transitions(visits, 8e5, consecutive=True)).withColumn("share", F.round("share", 6))


_CATEGORY = "CASE " + " ".join(f"WHEN p_size + 25 BETWEEN {a} AND {b} THEN {i}" for i, (a, b) in enumerate(P.CATEGORIES.values())) + " ELSE 20 END"


@query("pas_ship_types", f"SELECT p_partkey, CAST({_CATEGORY} AS INTEGER) AS ship_type, CASE WHEN p_size + p_partkey % 600 < 2 OR p_size > 510 OR p_partkey % 600 > 510 THEN 100 ELSE CAST(p_size + p_partkey % 600 AS BIGINT) END AS loa_m FROM part")
def ship_types(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    loa = P.plausible(F.col("p_size").cast("long"), F.col("p_partkey") % 600, F.lit(100).cast("long"), 2, 510)
    return part.select("p_partkey", P.ship_category(F.col("p_size") + 25).alias("ship_type"), loa.alias("loa_m"))
