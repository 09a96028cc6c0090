"""Domain tables made from the driver's tables, as one SQL text for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Microseconds since the epoch as a double.
SPARK_US, DUCK_US = "CAST(unix_micros(CAST(ts AS TIMESTAMP)) AS DOUBLE)", "CAST(epoch_us(ts) AS DOUBLE)"

VIEWS = {
    "pings": """SELECT user_id AS mmsi, event_id AS seq, ts AS t, {US} / 1e6 AS t_s,
        14e0 + 2e-3 * (({US} / 6e7 - 28401120e0) % 1440e0) AS lon, 55e0 + 1e-2 * (user_id % 20) AS lat,
        value / 10e0 AS sog, CAST((event_id * 37) % 360 AS DOUBLE) AS cog FROM {events}""",
    "legs": """SELECT CAST(n_nationkey + 1 AS BIGINT) AS leg_id, 14e0 + 1e-1 * (n_nationkey % 5) AS lon1, 55e0 + 1e-1 * floor(n_nationkey / 5e0) AS lat1,
        14e0 + 1e-1 * (n_nationkey % 5) + CASE WHEN n_nationkey % 2 = 0 THEN 1e-1 ELSE 0e0 END AS lon2,
        55e0 + 1e-1 * floor(n_nationkey / 5e0) + CASE WHEN n_nationkey % 2 = 0 THEN 0e0 ELSE 1e-1 END AS lat2, 5e3 AS width_m FROM {nation}""",
    "leg_lateral": """SELECT CAST(n_nationkey + 1 AS BIGINT) AS leg_id, d.dir_idx, 50e0 * (n_nationkey % 7) * (1 - 2 * d.dir_idx) AS mean_m,
        200e0 + 10e0 * n_nationkey AS std_m, 100e0 AS weight FROM {nation} CROSS JOIN (SELECT 0 AS dir_idx UNION ALL SELECT 1 AS dir_idx) d""",
    "traffic_cells": """SELECT CAST((l_suppkey % 25) + 1 AS BIGINT) AS leg_id, CAST(l_linenumber % 2 AS INT) AS dir_idx, CAST(l_partkey % 21 AS INT) AS ship_type,
        CAST(l_orderkey % 15 AS INT) AS size_bin, CAST(count(*) AS DOUBLE) AS freq, CAST(avg(l_quantity) AS DOUBLE) / 2e0 AS speed_kn,
        3e0 + 100e0 * CAST(avg(l_discount) AS DOUBLE) AS draught_m, 10e0 + 200e0 * CAST(avg(l_tax) AS DOUBLE) AS height_m,
        5e0 + CAST(avg(l_quantity) AS DOUBLE) / 2e0 AS beam_m FROM {lineitem} GROUP BY 1, 2, 3, 4""",
    "obstacles": """SELECT CAST(p_partkey AS BIGINT) AS obstacle_id, CASE WHEN p_partkey % 2 = 0 THEN 'depth' ELSE 'object' END AS kind, CAST(p_size AS DOUBLE) / 2e0 AS value_m,
        14e0 + 137e-4 * (p_partkey % 37) AS x0, 55e0 + 171e-4 * (p_partkey % 29) AS y0, 14e0 + 137e-4 * (p_partkey % 37) + 4e-3 AS x1,
        55e0 + 171e-4 * (p_partkey % 29) + 3e-3 AS y1 FROM {part}""",
    "registry": """SELECT c_custkey AS mmsi, 20e0 + (c_custkey % 300) AS loa_m, 5e0 + (c_custkey % 40) AS beam_m, CAST(c_nationkey % 21 AS INT) AS ship_type,
        CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE abs(CAST(c_acctbal AS DOUBLE)) / 500e0 END AS air_draught_m FROM {customer}""",
    "runs": """SELECT o_orderkey AS run_id, o_custkey AS project_id, o_orderpriority AS name, o_orderdate AS run_ts, CAST(o_totalprice AS DOUBLE) * 1e-9 AS total_freq FROM {orders}""",
}
#: Identity and voyage reports: errors tell nothing, a sign-up has no time of its own, and ships are refitted or change their voyage.
VIEWS["messages"] = """SELECT user_id AS mmsi, event_id AS seq, CASE WHEN event_type = 'signup' THEN NULL ELSE {US} / 1e6 END AS t_s, event_type <> 'error' AS told,
    9000000 + user_id AS imo, user_id % 90 + 10 + CASE WHEN value > 300e0 THEN 5 ELSE 0 END AS dim_a, user_id % 30 AS dim_b, user_id % 11 + 2 AS dim_c, CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id % 13 END AS dim_d,
    CAST(floor(value / 100e0) AS DOUBLE) AS draught_m, CAST(user_id % 60 + 30 AS INT) AS ship_code, concat('  ', event_type, ' by the northern strait ') AS destination FROM {events}"""
#: Traffic of each year as a scenario of its own, and a network in which three legs and more meet.
VIEWS["scenario_cells"] = VIEWS["traffic_cells"].replace("SELECT ", "SELECT CAST(year(l_shipdate) AS BIGINT) AS scenario_id, ", 1).replace("GROUP BY 1, 2, 3, 4", "GROUP BY 1, 2, 3, 4, 5")
_STAR = """ UNION ALL SELECT CAST(n_nationkey + 101 AS BIGINT), 14e0 + 1e-1 * (n_nationkey % 5), 55e0 + 1e-1 * floor(n_nationkey / 5e0),
    141e-1 + 1e-1 * (n_nationkey % 5), 551e-1 + 1e-1 * floor(n_nationkey / 5e0), 5e3 FROM {nation}"""
VIEWS["star_legs"] = VIEWS["legs"] + _STAR
VIEWS["star_cells"] = f"WITH c AS ({VIEWS['traffic_cells']}) SELECT * FROM c UNION ALL SELECT leg_id + 100, dir_idx, ship_type, size_bin, freq, speed_kn, draught_m, height_m, beam_m FROM c"
_BASE = {
    "pings": "events", "messages": "events", "legs": "nation", "star_legs": "nation", "leg_lateral": "nation", "traffic_cells": "lineitem", "scenario_cells": "lineitem", "star_cells": "lineitem",
    "obstacles": "part", "registry": "customer", "runs": "orders",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base = _BASE[name]
    table = spark.read.parquet(f"{sf_dir.rstrip('/')}/{base}.parquet")
    return spark.sql(VIEWS[name].replace("{US}", SPARK_US), **{base: table})


def oracle(body: str, *names: str) -> str:
    """body with the named views, and what it defines itself, in front."""
    ctes = ", ".join(f"{n} AS ({VIEWS[n].replace('{US}', DUCK_US).format(**{_BASE[n]: _BASE[n]})})" for n in names)
    body = body.strip()
    return f"WITH {ctes}{',' if body[:4].upper() == 'WITH' else ''} {body[4:] if body[:4].upper() == 'WITH' else body}"
