"""Queries of audits, the junction registry, source tables and further reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairway.operators import audits as A
from fairway.operators import network as N
from fairway.operators import passages as P
from fairway.operators import reports as R
from fairway.sources import tables as S

from .adapters import oracle, view
from .network_queries import _GEOMETRIC

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_SETTINGS = """SELECT c_custkey AS scenario_id, 'speed' AS name, 1e0 + 1e-1 * (c_nationkey % 3) AS value FROM {c} UNION ALL SELECT c_custkey, 'anchor_p', CASE WHEN c_nationkey % 4 = 0 THEN 5e-1 ELSE 7e-1 END FROM {c}
UNION ALL SELECT c_custkey, 'anchor_d', 7e0 + (c_custkey % 2) FROM {c} UNION ALL SELECT c_custkey, 'colour', 1e0 FROM {c}"""


@query("aud_defaults", f"""WITH s AS ({_SETTINGS.format(c='customer')}), d AS (SELECT * FROM (VALUES ('speed', 1e0), ('anchor_p', 7e-1), ('anchor_d', 7e0), ('drift_p', 1e0)) t(name, base))
SELECT scenario_id, name, value, base AS "default", round((value - base) / base * 100, 6) AS delta_pct FROM s JOIN d USING (name) WHERE abs(value - base) > greatest(1e-3 * greatest(abs(value), abs(base)), 1e-9)""")
def defaults(spark, sf_dir):
    settings = spark.sql(_SETTINGS, c=_read(spark, sf_dir, "customer"))
    return A.against_defaults(settings, A.DRIFT_DEFAULTS).withColumn("delta_pct", F.round("delta_pct", 6))


_WIND = "SELECT CAST(c_nationkey AS BIGINT) AS scenario_id, CAST(c_custkey % 8 AS INT) AS direction, CASE WHEN c_nationkey % 3 = 0 THEN 125e-3 ELSE CAST(count(*) AS DOUBLE) / 100e0 END AS value FROM {c} GROUP BY 1, 2, c_nationkey"


@query("aud_rose_skew", f"""WITH w AS ({_WIND.format(c='customer')}), k AS (SELECT scenario_id FROM w GROUP BY 1 HAVING max(CASE WHEN abs(value - 125e-3) > greatest(1e-3 * greatest(value, 125e-3), 1e-9) THEN 1 ELSE 0 END) = 1)
SELECT scenario_id, CAST(place AS INT) AS place, direction, value FROM (SELECT w.*, row_number() OVER (PARTITION BY scenario_id ORDER BY value DESC, direction) AS place FROM w JOIN k USING (scenario_id)) WHERE place <= 2""")
def rose_skew(spark, sf_dir):
    return A.rose_skew(spark.sql(_WIND, c=_read(spark, sf_dir, "customer")))


_RATES = "SELECT CAST(c_nationkey AS BIGINT) AS scenario_id, CAST(c_custkey % 21 AS INT) AS ship_type, CASE WHEN c_custkey % 21 BETWEEN 8 AND 11 THEN 1e-1 WHEN max(c_acctbal) > 9000 THEN 2e0 ELSE 1e0 END AS rate FROM {c} GROUP BY 1, 2, c_nationkey, c_custkey % 21"


@query("aud_blackouts", f"""WITH r AS ({_RATES.format(c='customer')}) SELECT scenario_id, count(*) FILTER (WHERE abs(rate - CASE WHEN ship_type BETWEEN 8 AND 11 THEN 1e-1 ELSE 1e0 END) > 1e-3 * greatest(rate, 1e-1)) AS changed FROM r GROUP BY 1""")
def blackouts(spark, sf_dir):
    return A.changed_blackouts(spark.sql(_RATES, c=_read(spark, sf_dir, "customer")))


@query("aud_completeness", oracle(f"""{_GEOMETRIC}, b AS (SELECT DISTINCT leg_id FROM traffic_cells WHERE freq > 0), o AS (SELECT count(DISTINCT CASE WHEN kind = 'depth' THEN obstacle_id END) AS depths, count(DISTINCT CASE WHEN kind = 'object' THEN obstacle_id END) AS objects FROM obstacles)
SELECT CAST(0 AS BIGINT) AS scenario_id, (SELECT count(*) FROM legs) AS legs, (SELECT count(*) FROM b JOIN legs USING (leg_id)) AS legs_with_traffic, depths, objects, CAST(0 AS BIGINT) AS junctions_user, CAST(0 AS BIGINT) AS junctions_ais, (SELECT count(DISTINCT junction_id) FROM g) AS junctions_geometry FROM o""", "legs", "traffic_cells", "obstacles"))
def completeness(spark, sf_dir):
    one = lambda name: view(spark, sf_dir, name).withColumn("scenario_id", F.lit(0).cast("long"))
    junctions = N.geometric_shares(N.junctions(view(spark, sf_dir, "legs"))).select(F.lit(0).cast("long").alias("scenario_id"), "junction_id", F.lit("geometry").alias("source"))
    return A.completeness(one("legs"), one("obstacles"), one("traffic_cells"), junctions)


_USER = "SELECT junction_id, in_leg, out_leg, CASE WHEN out_leg % 5 = 0 THEN '-1' WHEN out_leg % 7 = 0 THEN 'none' ELSE CAST(CAST(out_leg AS DOUBLE) AS {text}) END AS share FROM {g} WHERE in_leg % 2 = 0"


@query("net_user_shares", oracle(f"""{_GEOMETRIC.replace('FROM legs', 'FROM star_legs')}, u AS (SELECT junction_id, in_leg, out_leg, greatest(TRY_CAST(share AS DOUBLE), 0e0) AS share FROM ({_USER.format(g='g', text='VARCHAR')}) WHERE TRY_CAST(share AS DOUBLE) IS NOT NULL),
n AS (SELECT junction_id, in_leg, out_leg, CASE WHEN sum(share) OVER w > 0 THEN share / sum(share) OVER w ELSE share END AS share, 'user' AS source FROM u WINDOW w AS (PARTITION BY junction_id, in_leg))
SELECT junction_id, in_leg, out_leg, round(share, 6) AS share, source FROM n UNION ALL SELECT junction_id, in_leg, out_leg, round(share, 6), 'geometry' FROM g WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.junction_id = g.junction_id AND n.in_leg = g.in_leg)""", "star_legs"))
def user_shares(spark, sf_dir):
    g = N.geometric_shares(N.junctions(view(spark, sf_dir, "star_legs"))).select("junction_id", "in_leg", "out_leg", "share", F.lit("geometry").alias("source"))
    user = spark.sql(_USER.replace("{text}", "STRING"), g=g)
    return A.upserted(g, user).withColumn("share", F.round("share", 6))


@query("net_refreshed", oracle(f"""{_GEOMETRIC.replace('FROM legs', 'FROM star_legs')}, u AS (SELECT DISTINCT junction_id FROM g WHERE in_leg IN (3, 8, 14)), bad AS (SELECT DISTINCT junction_id FROM u WHERE junction_id IN (SELECT junction_id FROM g WHERE in_leg = 8 OR out_leg = 8))
SELECT junction_id, in_leg, out_leg, round(CASE WHEN junction_id IN (SELECT junction_id FROM u) AND junction_id NOT IN (SELECT junction_id FROM bad) THEN 5e-1 ELSE share END, 6) AS share,
CASE WHEN junction_id IN (SELECT junction_id FROM u) AND junction_id NOT IN (SELECT junction_id FROM bad) THEN 'user' ELSE 'geometry' END AS source FROM g""", "star_legs"))
def refreshed(spark, sf_dir):
    ends = N.junctions(view(spark, sf_dir, "star_legs"))
    g = N.geometric_shares(ends)
    mine = g.where("in_leg IN (3, 8, 14)").select("junction_id").distinct()
    old = g.join(mine, "junction_id").select("junction_id", "in_leg", "out_leg", F.lit(0.5).alias("share"), F.lit("user").alias("source"))
    gone = old.where("in_leg = 8").select("junction_id", F.lit(999).cast("long").alias("in_leg"), "out_leg", "share", "source").distinct()  # a leg that is no more
    return A.refreshed(old.unionByName(gone), ends).withColumn("share", F.round("share", 6))


_CODES = "SELECT CAST(p_partkey AS INT) AS ship_code, CAST(p_size - 3 AS INT) AS lpp_min, CAST(p_partkey % 9 AS INT) AS n_total, 50e0 + p_size AS e_l, CAST(p_partkey % 8 AS DOUBLE) AS e_lb, 1e0 + p_partkey % 3 AS e_bd, CAST(p_partkey % 4 AS DOUBLE) AS e_dt, 10e0 + p_size % 7 AS e_v FROM {p}"


@query("src_ship_codes", f"""WITH c AS ({_CODES.format(p='part')}), b AS (SELECT *, CASE WHEN e_lb > 0 THEN e_l / e_lb ELSE 0 END AS beam FROM c WHERE lpp_min >= 0 AND n_total > 0), m AS (SELECT *, CASE WHEN e_bd > 0 THEN beam / e_bd ELSE 0 END AS moulded FROM b)
SELECT ship_code, lpp_min, e_l AS length_m, beam AS beam_m, moulded AS moulded_m, CASE WHEN e_dt > 0 THEN moulded / e_dt ELSE 0 END AS draught_m, e_v AS speed_kn FROM m""")
def ship_codes(spark, sf_dir):
    return S.ship_code_ratios(spark.sql(_CODES, p=_read(spark, sf_dir, "part")))


_NAMES = list(S.SOURCE_TYPES)
_FOREIGN = "SELECT CAST(l_suppkey % 25 AS BIGINT) AS leg_id, " + "CASE " + " ".join(f"WHEN l_partkey % 15 = {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " ELSE 'Submarine' END AS source_type, l_orderkey * 10 + l_linenumber AS seq, CAST(l_quantity AS DOUBLE) AS freq, CAST(l_tax AS DOUBLE) * 100 AS speed_kn FROM {l}"
_CATEGORY = "CASE source_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.SOURCE_TYPES.items()) + f" ELSE '{S.SOURCE_TYPES['Other ship']}' END"


@query("src_mapped_cells", f"WITH f AS ({_FOREIGN.format(l='lineitem')}) SELECT leg_id, category, freq, speed_kn FROM (SELECT *, row_number() OVER (PARTITION BY leg_id, category ORDER BY seq DESC, freq DESC, speed_kn DESC) AS k FROM (SELECT *, {_CATEGORY} AS category FROM f)) WHERE k = 1")
def mapped_cells(spark, sf_dir):
    return S.mapped_cells(spark.sql(_FOREIGN, l=_read(spark, sf_dir, "lineitem")), ["leg_id"], ["freq", "speed_kn"])


@query("src_summed_cells", f"WITH f AS ({_FOREIGN.format(l='lineitem')}) SELECT leg_id, {_CATEGORY} AS category, sum(freq) AS freq, round(sum(speed_kn * freq) / sum(freq), 6) AS speed_kn FROM f GROUP BY 1, 2")
def summed_cells(spark, sf_dir):
    cells = S.mapped_cells(spark.sql(_FOREIGN, l=_read(spark, sf_dir, "lineitem")), ["leg_id"], ["freq", "speed_kn"], add_up=True)
    return cells.withColumn("speed_kn", F.round("speed_kn", 6))


_DEPTHS = "SELECT CAST(p_partkey % 7 AS BIGINT) AS scenario_id, CASE WHEN p_partkey % 11 = 0 THEN '5-10' WHEN p_partkey % 5 = 0 THEN '-' || CAST(p_size AS {text}) ELSE CAST(p_size AS {text}) || '.5' END AS depth FROM {p}"


@query("src_depth_bins", f"""WITH d AS ({_DEPTHS.format(p='part', text='VARCHAR')}), v AS (SELECT DISTINCT scenario_id, abs(TRY_CAST(depth AS DOUBLE)) AS d FROM d WHERE TRY_CAST(depth AS DOUBLE) IS NOT NULL),
s AS (SELECT scenario_id, d, round(lead(d) OVER (PARTITION BY scenario_id ORDER BY d) - d, 1) AS step FROM v), c AS (SELECT scenario_id, step, count(*) AS n, min(d) AS first_at FROM s WHERE step IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY n DESC, first_at) AS k FROM c) SELECT k.scenario_id, greatest(coalesce(r.step, 0e0), 0e0) AS bin_m FROM (SELECT DISTINCT scenario_id FROM d) k LEFT JOIN r ON r.scenario_id = k.scenario_id AND r.k = 1""")
def depth_bin_widths(spark, sf_dir):
    return S.depth_bin_width(spark.sql(_DEPTHS.replace("{text}", "STRING"), p=_read(spark, sf_dir, "part")))


_FACTS = """SELECT CAST(1 AS BIGINT) AS scenario_id, leg_id, dir_idx, CAST(size_bin % 8 AS INT) AS direction, CASE ship_type % 3 WHEN 0 THEN 'allision' WHEN 1 THEN 'grounding' ELSE 'anchoring' END AS accident, ship_type, size_bin,
CASE ship_type % 2 WHEN 0 THEN 'headon' ELSE 'overtaking' END AS kind, freq * 1e-6 AS frequency, CAST(size_bin AS DOUBLE) / 15e0 AS p_not_repaired FROM {cells}"""


def _facts(spark, sf_dir):
    return spark.sql(_FACTS, cells=view(spark, sf_dir, "traffic_cells"))


@query("rep_leg_directions", oracle(f"""WITH f AS ({_FACTS.format(cells='traffic_cells')}) SELECT scenario_id, leg_id, dir_idx, direction, round(sum(CASE WHEN accident = 'allision' THEN frequency ELSE 0 END), 9) AS allision, round(sum(CASE WHEN accident = 'grounding' THEN frequency ELSE 0 END), 9) AS grounding,
round(sum(CASE WHEN accident = 'anchoring' THEN frequency ELSE 0 END), 9) AS anchoring, round(sum(CASE WHEN accident <> 'anchoring' THEN p_not_repaired * frequency END) / sum(CASE WHEN accident <> 'anchoring' THEN frequency END), 6) AS p_not_repaired FROM f GROUP BY 1, 2, 3, 4""", "traffic_cells"))
def leg_directions(spark, sf_dir):
    out = R.leg_directions(_facts(spark, sf_dir))
    return out.select("scenario_id", "leg_id", "dir_idx", "direction", *[F.round(c, 9).alias(c) for c in ("allision", "grounding", "anchoring")], F.round("p_not_repaired", 6).alias("p_not_repaired"))


@query("rep_ship_categories", oracle(f"""WITH f AS ({_FACTS.format(cells='traffic_cells')}) SELECT accident, CASE WHEN ship_type < 20 THEN 'type ' || ship_type ELSE CAST(ship_type AS VARCHAR) END AS type_label, CAST(size_bin * 25 AS VARCHAR) || ' m' AS size_label, round(sum(frequency), 9) AS frequency FROM f GROUP BY 1, 2, 3""", "traffic_cells"))
def ship_categories(spark, sf_dir):
    types = spark.range(20).select(F.col("id").cast("int").alias("ship_type"), F.concat(F.lit("type "), "id").alias("type_label"))
    sizes = spark.range(15).select(F.col("id").cast("int").alias("size_bin"), F.concat((F.col("id") * 25).cast("string"), F.lit(" m")).alias("size_label"))
    return R.by_ship_category(_facts(spark, sf_dir), types, sizes).withColumn("frequency", F.round("frequency", 9))


@query("rep_collision_lines", oracle(f"""WITH f AS ({_FACTS.format(cells='traffic_cells')}) SELECT leg_id, round(sum(CASE WHEN kind = 'headon' THEN frequency ELSE 0 END), 9) AS headon, round(sum(CASE WHEN kind = 'overtaking' THEN frequency ELSE 0 END), 9) AS overtaking, round(sum(frequency), 9) AS combined FROM f GROUP BY 1""", "traffic_cells"))
def collision_lines(spark, sf_dir):
    lines = R.collision_lines(_facts(spark, sf_dir).withColumnRenamed("frequency", "n"))
    return lines.select("leg_id", *[F.round(c, 9).alias(c) for c in ("headon", "overtaking", "combined")])


@query("rep_collision_points", oracle(f"""WITH f AS ({_FACTS.format(cells='traffic_cells')}), k AS (SELECT leg_id AS junction_id, CASE direction % 4 WHEN 0 THEN 'crossing' WHEN 1 THEN 'merging' WHEN 2 THEN 'bend' ELSE 'headon' END AS kind, frequency AS n FROM f)
SELECT junction_id, round(sum(CASE WHEN kind IN ('crossing', 'merging') THEN n ELSE 0 END), 9) AS crossing, round(sum(CASE WHEN kind = 'bend' THEN n ELSE 0 END), 9) AS bend, round(sum(CASE WHEN kind <> 'headon' THEN n ELSE 0 END), 9) AS combined FROM k GROUP BY 1 HAVING sum(CASE WHEN kind <> 'headon' THEN n ELSE 0 END) > 0""", "traffic_cells"))
def collision_points(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("crossing", "merging", "bend", "headon")]), F.col("direction") % 4 + 1)
    points = R.collision_points(_facts(spark, sf_dir).select(F.col("leg_id").alias("junction_id"), kind.alias("kind"), F.col("frequency").alias("n")))
    return points.select("junction_id", *[F.round(c, 9).alias(c) for c in ("crossing", "bend", "combined")])


@query("rep_summary", oracle(f"""WITH f AS ({_FACTS.format(cells='traffic_cells')}), s AS (SELECT accident AS kind, sum(frequency) AS f FROM f GROUP BY 1) SELECT kind, round(f, 9) AS frequency, round(f / sum(f) OVER (), 9) AS share, round(1 / f, 4) AS years_between FROM s""", "traffic_cells"))
def summary(spark, sf_dir):
    s = R.summary(_facts(spark, sf_dir).select(F.col("accident").alias("kind"), "frequency"))
    return s.select("kind", F.round("frequency", 9).alias("frequency"), F.round("share", 9).alias("share"), F.round("years_between", 4).alias("years_between"))


@query("rep_two_directions", oracle("SELECT leg_id, count(DISTINCT dir_idx) AS directions FROM traffic_cells WHERE ship_type = 3 AND size_bin % 4 = 1 GROUP BY 1 HAVING count(DISTINCT dir_idx) <> 2", "traffic_cells"))
def two_directions(spark, sf_dir):
    return R.project_findings(view(spark, sf_dir, "traffic_cells").where("ship_type = 3 AND size_bin % 4 = 1"))


@query("pas_transitions_anchored")
def anchored(spark, sf_dir):
    """The default rule: a vessel's first leg at a junction stays its in-leg until it times out."""
    e = _read(spark, sf_dir, "events")
    visits = e.select((F.col("user_id") % 5).cast("string").alias("junction_id"), F.col("user_id").alias("mmsi"), (F.col("event_id") % 4).alias("leg_id"), F.expr("CAST(unix_micros(CAST(ts AS TIMESTAMP)) AS DOUBLE) / 1e6").alias("t_s"))
    return P.transitions(visits)
