"""Queries of identity and voyage versions, segments as of their time, and transitions between legs that were crossed."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairway.functions.shared import written
from fairway.operators import passages as P
from fairway.operators import tracks as T
from fairway.operators import voyages as V

from .adapters import oracle, view
from .track_queries import _SEGMENTS, _split
from .traffic_queries import _BIN, _CROSSED, _VISITS, _crossed

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _versions(name: str, source: str, state: list[str]) -> str:
    """The changes among a source's rows, found over whole vessels."""
    row = "{" + ", ".join(f"'{c}': {c}" for c in state) + "}"
    none = "{" + ", ".join(f"'{c}': NULL" for c in state) + "}"
    shown = ", ".join(f"CASE WHEN told THEN {c} END AS {c}" for c in state)
    return f"""{name}_r AS (SELECT *, CASE WHEN told THEN {row} END AS now FROM {source} WHERE mmsi IS NOT NULL AND t_s IS NOT NULL),
{name}_w AS (SELECT *, last_value(now IGNORE NULLS) OVER (PARTITION BY mmsi ORDER BY t_s, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was, row_number() OVER (PARTITION BY mmsi ORDER BY t_s, seq) AS n FROM {name}_r),
{name} AS (SELECT mmsi, seq, t_s, {shown}, md5(concat_ws('|', mmsi, CAST(round(t_s * 1e6) AS BIGINT), seq)) AS version_id FROM {name}_w
  WHERE n = 1 OR (now IS NOT NULL AND now IS DISTINCT FROM coalesce(was, {none})))"""


_DATED = "dm AS (SELECT m.* REPLACE (coalesce(m.t_s, f.first) AS t_s, substring(trim(m.destination), 1, 20) AS destination) FROM messages m LEFT JOIN (SELECT mmsi, min(t_s) AS first FROM pings GROUP BY 1) f USING (mmsi))"
_STATICS = f"{_DATED}, {_versions('si', 'dm', V.IDENTITY)}"
_LAST = lambda source, t: f"(SELECT mmsi, t_s AS v_t, {source}_c.* EXCLUDE (mmsi, t_s, n) FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, t_s ORDER BY seq DESC) AS n FROM {t}) {source}_c WHERE n = 1)"
_STATES = f"""{_STATICS}, lsi AS {_LAST('a', 'si')}, dv AS (SELECT dm.*, lsi.version_id AS static_id FROM dm ASOF LEFT JOIN lsi ON dm.mmsi = lsi.mmsi AND dm.t_s >= lsi.v_t),
{_versions('st', 'dv', ['draught_m', 'ship_code', 'destination', 'static_id'])}"""


def _messages(spark, sf_dir):
    return V.dated(view(spark, sf_dir, "messages"), view(spark, sf_dir, "pings"))


def _tables(spark, sf_dir):
    messages = _messages(spark, sf_dir)
    known = written(V.statics(messages, F.col("told")), "statics")  # both tables are read more than once
    return known, written(V.states(messages, known, F.col("told")), "states")


@query("trk_static_versions", oracle(f"WITH {_STATICS} SELECT mmsi, seq, t_s, version_id, {', '.join(V.IDENTITY)} FROM si", "pings", "messages"))
def static_versions(spark, sf_dir):
    return V.statics(_messages(spark, sf_dir), F.col("told")).select("mmsi", "seq", "t_s", "version_id", *V.IDENTITY)


@query("trk_state_versions", oracle(f"WITH {_STATES} SELECT mmsi, seq, t_s, version_id AS state_id, static_id, draught_m, ship_code, destination FROM st", "pings", "messages"))
def state_versions(spark, sf_dir):
    return _tables(spark, sf_dir)[1].select("mmsi", "seq", "t_s", "state_id", "static_id", "draught_m", "ship_code", "destination")


@query("trk_segment_states", oracle(_SEGMENTS + f""", {_STATES}, lst AS {_LAST('b', 'st')}
SELECT h.mmsi, h.sub_id, h.t1, x.version_id AS state_id, x.draught_m, x.ship_code, x.destination, x.static_id, si.dim_a, si.dim_b, si.dim_c, si.dim_d, si.imo
FROM h ASOF JOIN lst x ON h.mmsi = x.mmsi AND h.t1 >= x.v_t JOIN si ON si.version_id = x.static_id""", "pings", "messages"))
def segment_states(spark, sf_dir):
    known, voyages = _tables(spark, sf_dir)
    s = V.with_ship(T.segments(T.long_enough(_split(spark, sf_dir))), voyages, known)
    return s.select("mmsi", "sub_id", "t1", "state_id", "draught_m", "ship_code", "destination", "static_id", *V.IDENTITY)


_TYPE = "CAST(CASE " + " ".join(f"WHEN ship_code BETWEEN {a} AND {b} THEN {i}" for i, (a, b) in enumerate(P.CATEGORIES.values())) + f" ELSE {P.OTHER_TYPE} END AS INTEGER)"
_YEAR = """cv AS (SELECT 365e0 * 86400e0 / (max(t_s) - min(t_s) - coalesce(sum(CASE WHEN gap > 432e2 THEN gap END), 0e0)) AS multiplier FROM (SELECT t_s, t_s - lag(t_s) OVER (ORDER BY t_s) AS gap FROM pings))"""


@query("pas_traffic_matrix", oracle(_CROSSED + f""", {_STATES}, lst AS {_LAST('b', 'st')}, {_YEAR},
sh AS (SELECT d.*, x.draught_m, {_TYPE} AS ship_type, si.dim_a + si.dim_b AS loa_m, si.dim_c + si.dim_d AS beam_m, r.air_draught_m
  FROM dirs d ASOF JOIN lst x ON d.mmsi = x.mmsi AND d.t1 >= x.v_t JOIN si ON si.version_id = x.static_id LEFT JOIN registry r ON r.mmsi = d.mmsi WHERE d.dir_idx IS NOT NULL)
SELECT leg_id, dir_idx, ship_type, {_BIN.format('loa_m')} AS size_bin, round(count(*) * any_value(multiplier) + 1e-9, 5) AS freq, round(avg(sog) + 1e-9, 5) AS speed_kn, round(avg(beam_m) + 1e-9, 5) AS beam_m, round(avg(air_draught_m) + 1e-9, 5) AS height_m, round(avg(draught_m) + 1e-9, 5) AS draught_m
FROM sh, cv GROUP BY 1, 2, 3, 4""", "pings", "legs", "messages", "registry"))
def traffic_matrix(spark, sf_dir):
    """Traffic of a year from crossings, with the ships as they were at the time: counts times the coverage's multiplier.

    Values are shifted by 1e-9 before they are rounded, so that halves fall the same way everywhere.
    """
    known, voyages = _tables(spark, sf_dir)
    ships = V.with_ship(P.direction(_crossed(spark, sf_dir), 60.0), voyages, known).join(view(spark, sf_dir, "registry").select("mmsi", F.col("air_draught_m").alias("height_m")), "mmsi", "left")
    ships = ships.withColumn("size_bin", P.length_bin(F.col("dim_a") + F.col("dim_b"))).withColumn("ship_type", P.ship_category(F.col("ship_code"))).withColumn("beam_m", F.col("dim_c") + F.col("dim_d")).withColumn("speed_kn", F.col("sog"))
    year = P.coverage(view(spark, sf_dir, "pings")).select("multiplier")  # one row
    t = P.traffic(ships).join(F.broadcast(year)).withColumn("freq", F.col("freq") * F.col("multiplier"))
    return t.select("leg_id", "dir_idx", "ship_type", "size_bin", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("freq", "speed_kn", "beam_m", "height_m", "draught_m")])


#: Junctions and their legs: those of one row of the network.
_JUNCTIONS = "SELECT CAST(floor(n_nationkey / 5e0) AS BIGINT) AS junction_id, CAST(n_nationkey + 1 AS BIGINT) AS leg_id FROM {nation}"


def _anchored(visits: str, window_s: str) -> str:
    """Pairs of in and out legs under the anchored rule, one step per first visit of a leg."""
    return f"""vf AS (SELECT junction_id, mmsi, leg_id, min(t_s) AS t_s FROM {visits} GROUP BY 1, 2, 3), vo AS (SELECT *, row_number() OVER (PARTITION BY junction_id, mmsi ORDER BY t_s, leg_id) AS n FROM vf),
vs AS (SELECT junction_id, mmsi, n, t_s, leg_id, CAST(NULL AS BIGINT) AS in_leg, CAST(NULL AS BIGINT) AS out_leg FROM vo WHERE n = 1
  UNION ALL SELECT o.junction_id, o.mmsi, o.n, CASE WHEN o.t_s - s.t_s <= {window_s} THEN s.t_s ELSE o.t_s END, CASE WHEN o.t_s - s.t_s <= {window_s} THEN s.leg_id ELSE o.leg_id END,
  CASE WHEN o.t_s - s.t_s <= {window_s} THEN s.leg_id END, CASE WHEN o.t_s - s.t_s <= {window_s} THEN o.leg_id END FROM vs s JOIN vo o ON o.junction_id = s.junction_id AND o.mmsi = s.mmsi AND o.n = s.n + 1)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


@query("pas_leg_passages", oracle(_CROSSED + "SELECT DISTINCT leg_id, mmsi, t1 AS t_s FROM pass", "pings", "legs"))
def leg_passages(spark, sf_dir):
    return P.leg_passages(_crossed(spark, sf_dir))


_COUNTED = "SELECT junction_id, in_leg, out_leg, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY junction_id, in_leg), 6) AS share FROM vs WHERE in_leg <> out_leg GROUP BY 1, 2, 3"


@query("pas_crossed_transitions", _recursive(oracle(f"{_CROSSED}, jl AS ({_JUNCTIONS.format(nation='nation')}), v AS (SELECT DISTINCT junction_id, mmsi, leg_id, t1 AS t_s FROM pass JOIN jl USING (leg_id)), {_anchored('v', '864e3')} {_COUNTED}", "pings", "legs")))
def crossed_transitions(spark, sf_dir):
    junctions = spark.sql(_JUNCTIONS, nation=spark.read.parquet(f"{sf_dir}/nation.parquet"))
    visits = P.junction_visits(P.leg_passages(_crossed(spark, sf_dir)), junctions)
    return P.shares(P.transitions(visits, 864000.0)).withColumn("share", F.round("share", 6))


@query("pas_transitions_timed", f"WITH RECURSIVE v AS ({_VISITS.format(us='CAST(epoch_us(ts) AS DOUBLE)', events='events')}), {_anchored('v', '8e5')} {_COUNTED}")
def timed_transitions(spark, sf_dir):
    """The default rule over all reports: a vessel's first leg at a junction stays its in-leg until it times out."""
    visits = spark.sql(_VISITS.format(us="CAST(unix_micros(CAST(ts AS TIMESTAMP)) AS DOUBLE)", events="{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return P.shares(P.transitions(visits, 8e5)).withColumn("share", F.round("share", 6))
