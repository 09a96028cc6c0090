"""Queries of whole project files, which are written from the traffic of each year: texts in, tables out."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairway.operators import collision as C
from fairway.sources import projects as J

from .adapters import oracle, view

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


#: Two directions by name; those of odd legs stand the other way round in the leg's own list.
_NAMES = {0: "East going", 1: "West going"}


def _projects(spark, sf_dir):
    """One text a year: matrices by leg and direction, as a program would save them."""
    cells = view(spark, sf_dir, "scenario_cells")
    row = lambda c: F.array(*[F.max(F.when(F.col("size_bin") == i, F.col(c))) for i in range(15)])
    rows = cells.groupBy("scenario_id", "leg_id", "dir_idx", "ship_type").agg(*[row(c).alias(c) for c in ("freq", "speed_kn", "draught_m", "height_m")])
    blank = F.array(*[F.lit(None).cast("double")] * 15)
    matrix = lambda c: F.transform(F.sequence(F.lit(0), F.lit(20)), lambda t: F.coalesce(F.try_element_at(F.col(f"{c}_by"), t), blank))
    dirs = rows.groupBy("scenario_id", "leg_id", "dir_idx").agg(*[F.map_from_entries(F.collect_list(F.struct("ship_type", c))).alias(f"{c}_by") for c in ("freq", "speed_kn", "draught_m", "height_m")])
    scale = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda t: F.transform(F.sequence(F.lit(0), F.lit(14)), lambda s: F.when(t % 2 == 0, 80.0).otherwise((100 + s).cast("double"))))
    held = F.struct(*[matrix(c).alias(n) for n, c in J.MATRICES.items() if c in ("freq", "speed_kn", "draught_m", "height_m")], F.when(F.col("leg_id") % 3 > 0, scale).alias("Scaling (%)"))
    name = F.when((F.col("dir_idx") + F.col("leg_id")) % 2 == 0, _NAMES[0]).otherwise(_NAMES[1])
    legs = dirs.select("scenario_id", "leg_id", F.struct(name.alias("n"), held.alias("m")).alias("d")).groupBy("scenario_id", "leg_id").agg(F.map_from_entries(F.sort_array(F.collect_list("d"))).alias("dirs"))
    own = F.struct(F.when(F.col("leg_id") % 2 == 0, F.array(F.lit(_NAMES[0]), F.lit(_NAMES[1]))).otherwise(F.array(F.lit(_NAMES[1]), F.lit(_NAMES[0]))).alias("Dirs"))
    entry = lambda v: F.map_from_entries(F.collect_list(F.struct(F.col("leg_id").cast("string"), v)))
    whole = legs.groupBy("scenario_id").agg(entry(F.col("dirs")).alias("traffic_data"), entry(own).alias("segment_data"))
    pc = F.struct(F.lit("2e-4").alias("bend"), F.when(F.col("scenario_id") % 2 == 0, 1e-4).alias("headon"))
    return whole.select("scenario_id", F.to_json(F.struct("traffic_data", "segment_data", pc.alias("pc"))).alias("text"))


@query("src_project_traffic", oracle("""SELECT scenario_id, CAST(leg_id AS VARCHAR) AS leg_id, dir_idx, ship_type, size_bin, freq AS own_freq,
  freq * (CASE WHEN leg_id % 3 = 0 THEN 100e0 WHEN ship_type % 2 = 0 THEN 80e0 ELSE 100e0 + size_bin END) / 100e0 AS freq, speed_kn, draught_m, height_m, 0e0 AS beam_m FROM scenario_cells""", "scenario_cells"))
def project_traffic(spark, sf_dir):
    cells = J.traffic(J.parsed(_projects(spark, sf_dir)))
    return cells.select("scenario_id", "leg_id", "dir_idx", "ship_type", "size_bin", "own_freq", "freq", "speed_kn", "draught_m", "height_m", "beam_m")


_DEFAULTS = " UNION ALL ".join(f"SELECT '{k}' AS kind, {v!r} AS v" for k, v in C.CAUSATION.items())


@query("src_project_causation", oracle(f"SELECT scenario_id, kind, CAST(1e9 * (CASE WHEN kind = 'bend' THEN 2e-4 WHEN kind = 'headon' AND scenario_id % 2 = 0 THEN 1e-4 ELSE v END) AS DOUBLE) AS factor_e9 FROM (SELECT DISTINCT scenario_id FROM scenario_cells), ({_DEFAULTS})", "scenario_cells"))
def project_causation(spark, sf_dir):
    return J.causation(J.parsed(_projects(spark, sf_dir))).select("scenario_id", "kind", (F.col("factor") * 1e9).alias("factor_e9"))
