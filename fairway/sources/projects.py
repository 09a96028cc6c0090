"""Whole project files as tables: traffic, lateral mixtures, causation, drift settings, consequences, junctions.

A corpus of projects is one table of texts (scenario_id, text); every function gives rows keyed by scenario_id.  What
older files lack or name otherwise is brought to the present form.  A text that is no JSON object gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairway.operators.collision import CAUSATION

from .tables import matrix_cells

#: A direction's matrices [ship type][size bin] as they are named in files, and here (fixed values).
MATRICES = {
    "Frequency (ships/year)": "freq",
    "Speed (knots)": "speed_kn",
    "Draught (meters)": "draught_m",
    "Ship heights (meters)": "height_m",
    "Ship Beam (meters)": "beam_m",
    "Scaling (%)": "scaling",
}
#: Keys of the mixture of normals of direction d, component k, and of the uniform part (fixed values).
COMPONENTS = (1, 2, 3)
ANCHOR_P = 0.7

_TEXT, _NUMBER = T.StringType(), T.DoubleType()
_MATRIX = T.ArrayType(T.ArrayType(_TEXT))


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_MAP = T.MapType(_TEXT, _TEXT)
_DIRECTION = T.StructType([T.StructField(n, _MATRIX) for n in MATRICES])
_SCHEMA = _struct(
    pc=_MAP,
    drift=_MAP,
    segment_data=T.MapType(_TEXT, _MAP),
    traffic_data=T.MapType(_TEXT, T.MapType(_TEXT, _DIRECTION)),
    consequence=_struct(oil_onboard=_MATRIX, spill_probability=_MATRIX, spill_fraction=_MATRIX, catastrophe_levels=T.ArrayType(_struct(name=_TEXT, quantity=_TEXT))),
    junctions=T.MapType(_TEXT, _struct(point=T.ArrayType(_NUMBER), legs=_MAP, transitions=T.MapType(_TEXT, T.MapType(_TEXT, _NUMBER)), source=_TEXT)),
)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(scenario_id, text) of project files, one row a file."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("scenario_id"), F.col("value").alias("text"))


def parsed(texts: DataFrame) -> DataFrame:
    """scenario_id and the blocks of each project; those that are missing are null."""
    return texts.select("scenario_id", F.from_json("text", _SCHEMA).alias("p")).where("p is not null").select("scenario_id", "p.*")


def _number(x: Column) -> Column:
    return x.try_cast("double")


def traffic(projects: DataFrame) -> DataFrame:
    """Cells (scenario_id, leg_id, direction, dir_idx, ship_type, size_bin) with a positive frequency, and their values.

    Directions count in the order of the leg's Dirs; those that it does not name in the order of the file.  A missing
    beam is 0 and a missing scaling 100 %; what a scaling matrix has beyond the frequencies is of no cell.  freq is
    scaled, own_freq is as it stands in the file.
    """
    legs = projects.select("scenario_id", "segment_data", F.explode("traffic_data").alias("leg_id", "dirs"))
    dirs = F.from_json(F.element_at(F.element_at("segment_data", F.col("leg_id")), F.lit("Dirs")), "array<string>")
    each = legs.select("scenario_id", "leg_id", dirs.alias("names"), F.posexplode("dirs").alias("nth", "direction", "m"))
    named = F.array_position("names", F.col("direction"))
    rows = each.select("scenario_id", "leg_id", "direction", F.when(named > 0, named - 1).otherwise(F.col("nth")).cast("int").alias("dir_idx"), *[F.coalesce(F.col(f"m.`{n}`"), F.array().cast(_MATRIX)).alias(c) for n, c in MATRICES.items()])
    cells = matrix_cells(rows, list(MATRICES.values())).withColumn("beam_m", F.coalesce("beam_m", F.lit(0.0))).withColumn("scaling", F.coalesce("scaling", F.lit(100.0)))
    return cells.withColumn("own_freq", F.col("freq")).withColumn("freq", F.col("freq") * F.col("scaling") / 100.0)


def lateral(projects: DataFrame) -> DataFrame:
    """Components (scenario_id, leg_id, dir_idx, component, mean_m, std_m, weight) of positive weight of each direction's mixture."""
    legs = projects.select("scenario_id", F.explode("segment_data").alias("leg_id", "s"))
    value = lambda name, d, k: F.coalesce(_number(F.element_at("s", F.lit(f"{name}{d}_{k}"))), F.lit(0.0))
    parts = [F.struct(F.lit(d - 1).alias("dir_idx"), F.lit(k).alias("component"), value("mean", d, k).alias("mean_m"), value("std", d, k).alias("std_m"), value("weight", d, k).alias("weight")) for d in (1, 2) for k in COMPONENTS]
    return legs.select("scenario_id", "leg_id", F.explode(F.array(*parts)).alias("c")).select("scenario_id", "leg_id", "c.*").where("weight > 0")


def causation(projects: DataFrame) -> DataFrame:
    """(scenario_id, kind, factor) of every kind of accident; the default where a project has none."""
    pairs = [F.struct(F.lit(k).alias("kind"), F.coalesce(_number(F.element_at("pc", F.lit(k))), F.lit(v)).alias("factor")) for k, v in CAUSATION.items()]
    return projects.select("scenario_id", F.explode(F.array(*pairs)).alias("c")).select("scenario_id", "c.*")


def drift_settings(projects: DataFrame) -> DataFrame:
    """One row a project: anchor_p (a share; percent values are brought to one), anchor_d, speed_kn, start_from, squat_mode and the repair time.

    A repair time told as log-normal whose text speaks of a mean and a deviation, without a lower bound, or whose type
    is normal, is a normal one.
    """
    own = projects.select("scenario_id", F.coalesce("drift", F.create_map().cast(_MAP)).alias("d")).withColumn("r", F.coalesce(F.from_json(F.element_at("d", F.lit("repair")), "map<string,string>"), F.create_map().cast(_MAP)))
    d, r = (lambda c: (lambda name: F.element_at(c, F.lit(name))))("d"), (lambda c: (lambda name: F.element_at(c, F.lit(name))))("r")
    p = F.coalesce(_number(d("anchor_p")), F.lit(ANCHOR_P))
    combi = F.coalesce(r("combi"), F.lit(""))
    told = F.coalesce(r("use_lognormal").try_cast("boolean"), F.lit(False))
    normal = told & ((F.lower(F.coalesce(r("type"), F.lit(""))) == "normal") | (combi.contains("Mean") & combi.contains("Std") & ~combi.contains("Lower")))
    mean, std = F.coalesce(_number(r("param_0")), _number(r("loc")), F.lit(0.0)), F.coalesce(_number(r("param_1")), _number(r("scale")), F.lit(1.0))
    return own.select(
        "scenario_id",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(p > 1, p / 100).otherwise(p))).alias("anchor_p"),
        F.coalesce(_number(d("anchor_d")), _number(d("anchor_depth")), F.lit(0.0)).alias("anchor_d"),
        _number(d("speed")).alias("speed_kn"),
        F.coalesce(d("start_from"), F.lit("leg_center")).alias("start_from"),
        F.coalesce(d("squat_mode"), F.lit("average_speed")).alias("squat_mode"),
        F.when(normal, "normal").when(told, "lognormal").otherwise("function").alias("repair_kind"),
        F.when(normal, mean).alias("repair_mean_h"),
        F.when(normal, F.when(std > 0, std).otherwise(1e-6)).alias("repair_std_h"),
        r("func").alias("repair_text"),
    )


def rose(projects: DataFrame) -> DataFrame:
    """(scenario_id, direction, weight) of each project's wind rose; what is no number goes."""
    own = projects.select("scenario_id", F.explode(F.from_json(F.element_at("drift", F.lit("rose")), "map<string,double>")).alias("k", "weight"))
    return own.select("scenario_id", _number(F.col("k")).alias("direction"), "weight").where("direction is not null and weight is not null")


def blackouts(projects: DataFrame) -> DataFrame:
    """(scenario_id, ship_type, per_year) where a project has rates of its own; keys and rates that are no numbers go."""
    own = projects.select("scenario_id", F.explode(F.from_json(F.element_at("drift", F.lit("blackout_by_ship_type")), "map<string,string>")).alias("k", "v"))
    return own.select("scenario_id", F.col("k").try_cast("int").alias("ship_type"), _number(F.col("v")).alias("per_year")).where("ship_type is not null and per_year is not null")


def oil_onboard(projects: DataFrame) -> DataFrame:
    """(scenario_id, ship_type, size_bin, oil_m3) of positive volume."""
    return matrix_cells(projects.select("scenario_id", F.col("consequence.oil_onboard").alias("oil_m3")).where("oil_m3 is not null"), ["oil_m3"])


def spill_matrix(projects: DataFrame) -> DataFrame:
    """(scenario_id, kind, level, probability, fraction) of the kinds and levels that have a positive probability, by place."""
    rows = projects.select("scenario_id", F.col("consequence.spill_probability").alias("probability"), F.coalesce("consequence.spill_fraction", F.array().cast(_MATRIX)).alias("fraction")).where("probability is not null")
    return matrix_cells(rows, ["probability", "fraction"]).withColumnsRenamed({"ship_type": "kind", "size_bin": "level"})


def catastrophe_levels(projects: DataFrame) -> DataFrame:
    """(scenario_id, name, quantity_m3)."""
    return projects.select("scenario_id", F.explode("consequence.catastrophe_levels").alias("l")).select("scenario_id", F.col("l.name").alias("name"), _number(F.col("l.quantity")).alias("quantity_m3"))


def junction_legs(projects: DataFrame) -> DataFrame:
    """(scenario_id, junction_id, source, lon, lat, leg_id, end): the legs that meet at each junction."""
    own = projects.select("scenario_id", F.explode("junctions").alias("junction_id", "j"))
    legs = own.select("scenario_id", "junction_id", F.coalesce("j.source", F.lit("geometry")).alias("source"), F.get("j.point", 0).alias("lon"), F.get("j.point", 1).alias("lat"), F.explode("j.legs").alias("leg_id", "end"))
    return legs


def junction_shares(projects: DataFrame) -> DataFrame:
    """(scenario_id, junction_id, in_leg, out_leg, share) of the chosen transitions."""
    own = projects.select("scenario_id", F.explode("junctions").alias("junction_id", "j")).select("scenario_id", "junction_id", F.explode("j.transitions").alias("in_leg", "outs"))
    return own.select("scenario_id", "junction_id", "in_leg", F.explode("outs").alias("out_leg", "share"))
