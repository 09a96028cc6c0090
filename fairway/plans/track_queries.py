"""Queries of position reports, tracks, segments and vessel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairway.functions import expr as X
from fairway.operators import tracks as T

from .adapters import oracle, view

QUERIES, ORACLE_SQL = {}, {}
GAP = 43200.0


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


#: pings with gap and speed breaks, in the oracle's SQL.
_SPLIT = f"""
WITH o AS (SELECT *, lag(t_s) OVER w AS t0, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0, lag(sog) OVER w AS sog0 FROM (
      SELECT *, row_number() OVER (PARTITION BY mmsi, t_s ORDER BY seq) AS n FROM pings) WHERE n = 1 WINDOW w AS (PARTITION BY mmsi ORDER BY t_s, seq)),
d AS (SELECT *, t_s - t0 AS dt_s, {X.haversine('lon0', 'lat0', 'lon', 'lat')} AS dist_m FROM o),
i AS (SELECT *, CASE WHEN dt_s > 0 THEN dist_m / dt_s * {X.num(X.MS_KNOT_AIS)} ELSE 0e0 END AS implied_kn FROM d),
b AS (SELECT *, CASE WHEN dt_s > {X.num(GAP)} OR implied_kn > (sog + sog0) / 2e0 * (1e0 + 3e-1) + 1e0 THEN 1 ELSE 0 END AS is_break FROM i),
s AS (SELECT *, CAST(sum(is_break) OVER (PARTITION BY mmsi ORDER BY t_s, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sub_id FROM b),
k AS (SELECT *, count(*) OVER (PARTITION BY mmsi, sub_id) AS c FROM s)
"""


def _split(spark, sf_dir):
    return T.split(T.one_per_time(view(spark, sf_dir, "pings")), max_gap_s=GAP)


@query("trk_subtracks", oracle(_SPLIT + "SELECT mmsi, sub_id, count(*) AS n_pings, min(t_s) AS t_first, max(t_s) AS t_last, round(coalesce(sum(CASE WHEN is_break = 0 THEN dist_m END), 0), 3) AS length_m FROM k WHERE c >= 2 GROUP BY mmsi, sub_id", "pings"))
def subtracks(spark, sf_dir):
    return T.summary(T.long_enough(_split(spark, sf_dir))).withColumn("length_m", F.round(F.coalesce("length_m", F.lit(0.0)), 3))


@query("trk_breaks", oracle(_SPLIT + "SELECT mmsi, seq, round(dt_s, 3) AS dt_s, round(dist_m, 3) AS dist_m, round(implied_kn, 4) AS implied_kn, is_break, sub_id FROM k", "pings"))
def breaks(spark, sf_dir):
    return _split(spark, sf_dir).select("mmsi", "seq", F.round("dt_s", 3).alias("dt_s"), F.round("dist_m", 3).alias("dist_m"), F.round("implied_kn", 4).alias("implied_kn"), "is_break", "sub_id")


_SEGMENTS = f"""{_SPLIT}, g AS (SELECT mmsi, sub_id, t_s AS t1, lead(t_s) OVER w AS t2, lon AS lon1, lat AS lat1, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2,
  (sog + lead(sog) OVER w) / 2e0 AS sog, radians(cog) AS c1, radians(lead(cog) OVER w) AS c2 FROM k WHERE c >= 2 WINDOW w AS (PARTITION BY mmsi, sub_id ORDER BY t_s, seq)),
h AS (SELECT mmsi, sub_id, t1, t2, lon1, lat1, lon2, lat2, sog, {X.modulo('degrees(atan2(sin(c1) + sin(c2), cos(c1) + cos(c2))) + 360e0', 360)} AS cog FROM g WHERE t2 IS NOT NULL)
"""


@query("trk_segments", oracle(_SEGMENTS + "SELECT mmsi, sub_id, t1, t2, round(lon1, 6) AS lon1, round(lat1, 6) AS lat1, round(lon2, 6) AS lon2, round(lat2, 6) AS lat2, round(sog, 4) AS sog, round(cos(radians(cog)), 4) + 0e0 AS north FROM h", "pings"))
def segment_rows(spark, sf_dir):
    s = T.segments(T.long_enough(_split(spark, sf_dir)))
    return s.select("mmsi", "sub_id", "t1", "t2", *[F.round(c, 6).alias(c) for c in ("lon1", "lat1", "lon2", "lat2")], F.round("sog", 4).alias("sog"), (F.round(F.cos(F.radians("cog")), 4) + 0.0).alias("north"))


@query("trk_metrics", oracle(_SPLIT + """, p AS (SELECT mmsi, sub_id, count(*) AS n FROM k GROUP BY 1, 2)
SELECT count(DISTINCT mmsi) AS tracks, count(*) AS sub_tracks, count(*) - count(DISTINCT mmsi) AS splits, CAST(coalesce(sum(CASE WHEN n >= 2 THEN n - 1 END), 0) AS BIGINT) AS segments, count(*) FILTER (WHERE n < 2) AS too_short FROM p""", "pings"))
def ingest_metrics(spark, sf_dir):
    return T.metrics(_split(spark, sf_dir))


@query("trk_compressed")
def compressed(spark, sf_dir):
    return T.compress(T.long_enough(_split(spark, sf_dir)))


_MARKS = "WITH m AS (SELECT mmsi, min(t_s) + 2e5 AS last_t_s FROM pings WHERE mmsi % 3 <> 0 GROUP BY mmsi)"


def _marks(pings):
    return pings.where("mmsi % 3 <> 0").groupBy("mmsi").agg((F.min("t_s") + 2e5).alias("last_t_s"))


@query("trk_incremental", oracle(_MARKS + "SELECT p.mmsi, count(*) AS n, min(p.t_s) AS t_first, max(p.t_s) AS t_last FROM pings p LEFT JOIN m USING (mmsi) WHERE m.last_t_s IS NULL OR p.t_s > m.last_t_s GROUP BY 1", "pings"))
def incremental(spark, sf_dir):
    pings = view(spark, sf_dir, "pings")
    return T.after_watermark(pings, _marks(pings)).groupBy("mmsi").agg(F.count("*").alias("n"), F.min("t_s").alias("t_first"), F.max("t_s").alias("t_last"))


@query("trk_watermarks", oracle(_MARKS + """, n AS (SELECT mmsi, last_t_s, 1 AS n_segments FROM m UNION ALL SELECT mmsi, max(t_s), count(*) - 1 FROM pings GROUP BY mmsi)
SELECT mmsi, max(last_t_s) AS last_t_s, CAST(sum(n_segments) AS BIGINT) AS n_segments FROM n GROUP BY 1""", "pings"))
def watermark_rows(spark, sf_dir):
    pings = view(spark, sf_dir, "pings")
    new = pings.groupBy("mmsi").agg(F.max("t_s").alias("last_t_s"), (F.count("*") - 1).alias("n_segments"))
    return T.watermarks(_marks(pings).withColumn("n_segments", F.lit(1).cast("long")), new)


@query("trk_year_counts", "SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, count(*) AS n, count(DISTINCT user_id) AS vessels FROM events GROUP BY 1, 2")
def year_counts(spark, sf_dir):
    t = view(spark, sf_dir, "pings")
    return t.groupBy(F.year("t").alias("year"), F.month("t").alias("month")).agg(F.count("*").alias("n"), F.count_distinct("mmsi").alias("vessels"))


@query("trk_first_year", oracle("SELECT mmsi, count(*) AS n FROM pings WHERE t >= TIMESTAMP '2024-01-01' AND t < TIMESTAMP '2025-01-01' GROUP BY 1", "pings"))
def first_year(spark, sf_dir):
    return T.within_year(view(spark, sf_dir, "pings"), 2024).groupBy("mmsi").agg(F.count("*").alias("n"))


_STATE = "SELECT user_id AS mmsi, event_id AS seq, {us} / 1e6 AS t_s, event_type AS destination, CAST(floor(value / 50e0) AS BIGINT) AS draught FROM {events}"


@query("trk_state_changes", f"""WITH r AS ({_STATE.format(us='CAST(epoch_us(ts) AS DOUBLE)', events='events')}),
x AS (SELECT *, row_number() OVER w AS n, lag(destination) OVER w AS d0, lag(draught) OVER w AS g0 FROM r WINDOW w AS (PARTITION BY mmsi ORDER BY t_s, seq)),
y AS (SELECT * FROM x WHERE n = 1 OR destination IS DISTINCT FROM d0 OR draught IS DISTINCT FROM g0)
SELECT mmsi, seq, t_s, destination, draught, lead(t_s) OVER (PARTITION BY mmsi ORDER BY t_s, seq) AS valid_to FROM y""")
def state_changes(spark, sf_dir):
    rows = spark.sql(_STATE.format(us="CAST(unix_micros(CAST(ts AS TIMESTAMP)) AS DOUBLE)", events="{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return T.changes(rows, "mmsi", ["t_s", "seq"], ["destination", "draught"]).drop("row_id")


@query("trk_latest_static", f"""WITH r AS ({_STATE.format(us='CAST(epoch_us(ts) AS DOUBLE)', events='events')})
SELECT mmsi, seq, t_s, destination, draught FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY t_s DESC, seq DESC) AS n FROM r) WHERE n = 1""")
def latest_static(spark, sf_dir):
    rows = spark.sql(_STATE.format(us="CAST(unix_micros(CAST(ts AS TIMESTAMP)) AS DOUBLE)", events="{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return T.latest(rows, "mmsi", ["t_s", "seq"])


@query("trk_eta", """WITH p AS (SELECT event_id AS seq, CAST(event_id % 14 AS INTEGER) AS mo, CAST(event_id % 33 AS INTEGER) AS d, CAST(event_id % 26 AS INTEGER) AS h, CAST(event_id % 62 AS INTEGER) AS mi, event_id * 7 - 40000 AS x FROM events)
SELECT seq, TRY_CAST(printf('2024-%02d-%02d %02d:%02d:00', mo, d, CASE WHEN h > 23 THEN 99 ELSE h END, mi) AS TIMESTAMP) AS eta, CASE WHEN x BETWEEN -32768 AND 32767 THEN CAST(x AS SMALLINT) END AS small FROM p""")
def eta_rows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    part = lambda m: (F.col("event_id") % m).cast("int")
    return e.select(F.col("event_id").alias("seq"), T.eta(F.lit(2024), part(14), part(33), part(26), part(62)).cast("timestamp_ntz").alias("eta"), T.small(F.col("event_id") * 7 - 40000).alias("small"))


@query("trk_segment_vessels", oracle(_SEGMENTS + "SELECT h.mmsi, sub_id, t1, r.loa_m, r.ship_type, r.air_draught_m FROM h JOIN registry r ON r.mmsi = h.mmsi", "pings", "registry"))
def segment_vessels(spark, sf_dir):
    s = T.segments(T.long_enough(_split(spark, sf_dir)))
    return s.join(view(spark, sf_dir, "registry"), "mmsi").select("mmsi", "sub_id", "t1", "loa_m", "ship_type", "air_draught_m")
