"""Readers and writers: position report files, project files, obstacles, runs and partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Canonical columns and the header names that stand for them (fixed values).
ALIASES = {
    "mmsi": ("mmsi", "MMSI", "Mmsi"),
    "t": ("time", "BaseDateTime", "# Timestamp", "Timestamp", "t"),
    "lon": ("lon", "LON", "Longitude", "longitude"),
    "lat": ("lat", "LAT", "Latitude", "latitude"),
    "sog": ("sog", "SOG", "speed"),
    "cog": ("cog", "COG", "course"),
}
KINDS = {"mmsi": "long", "t": "timestamp", "lon": "double", "lat": "double", "sog": "double", "cog": "double"}


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file, from its first line, read by Spark (any file system, plain or gz)."""
    line = spark.read.text(path).first()
    return [c.strip().strip('"') for c in line[0].split(",")] if line else []


def read_reports(spark: SparkSession, paths: list[str], partitions: int | None = None) -> DataFrame:
    """Position reports of CSV files of different headers, under canonical names, with the file's name.

    Files of one header are one read.  Values that do not parse are null.  gz files cannot be split, so the
    rows are dealt out by vessel at once.
    """
    dialects: dict[tuple[str, ...], list[str]] = {}
    for p in paths:
        dialects.setdefault(tuple(header(spark, p)), []).append(p)
    parts = []
    for names, files in dialects.items():
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        raw = spark.read.csv(files, header=True, schema=schema)
        pick = lambda c: next((F.col(f"`{a}`") for a in ALIASES[c] if a in names), F.lit(None).cast("string"))  # noqa: E731, B023
        parts.append(raw.select(*[pick(c).try_cast(k).alias(c) for c, k in KINDS.items()], F.input_file_name().alias("file")))
    if not parts:
        return spark.createDataFrame([], "mmsi long, t timestamp, lon double, lat double, sog double, cog double, file string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.where("mmsi is not null and t is not null and lon is not null and lat is not null")
    return out.repartition(partitions, "mmsi") if partitions else out.repartition("mmsi")


PROJECT = T.StructType(
    [
        T.StructField("segment_data", T.MapType(T.StringType(), T.StructType([T.StructField(n, T.StringType()) for n in ("Start_Point", "Start Point", "End_Point", "End Point", "Width")] + [T.StructField("line_length", T.DoubleType())]))),
        T.StructField("drift", T.StructType([T.StructField("anchor_p", T.DoubleType()), T.StructField("anchor_d", T.DoubleType()), T.StructField("speed", T.DoubleType()), T.StructField("rose", T.MapType(T.StringType(), T.DoubleType()))])),
        T.StructField("depths", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("objects", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """Project files, one row each, with scenario_id; old keys and percent values brought to the present form."""
    raw = spark.read.schema(PROJECT).json(path, multiLine=True).withColumn("scenario_id", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    p = F.col("drift.anchor_p")
    return raw.withColumn("anchor_p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(p > 1, p / 100).otherwise(p))))


def project_legs(projects: DataFrame) -> DataFrame:
    """scenario_id, leg_id, ends and stored length of the legs of all projects."""
    from fairway.operators.network import parse_point

    legs = projects.select("scenario_id", F.explode("segment_data").alias("leg_id", "s"))
    ends = legs.select("scenario_id", "leg_id", parse_point(F.coalesce("s.Start_Point", F.col("s.`Start Point`"))).alias("a"), parse_point(F.coalesce("s.End_Point", F.col("s.`End Point`"))).alias("b"), F.col("s.line_length").alias("stored_m"), F.col("s.Width").try_cast("double").alias("width_m"))
    return ends.select("scenario_id", "leg_id", F.col("a.lon").alias("lon1"), F.col("a.lat").alias("lat1"), F.col("b.lon").alias("lon2"), F.col("b.lat").alias("lat2"), "stored_m", "width_m")


def project_obstacles(projects: DataFrame) -> DataFrame:
    """scenario_id, obstacle_id, kind, value_m and edges of the rings of all obstacles' WKT; rings that do not parse go.

    value_m of an interval is its deeper end (see depth_m); a depth that is a single number is the upper edge of a bin as
    wide as the commonest step between the project's depths (depth_bin_width), whose lower edge counts.
    """
    rows = projects.select("scenario_id", F.explode(F.concat(F.transform(F.coalesce("depths", F.array()), lambda x: F.struct(F.lit("depth").alias("kind"), x.alias("x"))), F.transform(F.coalesce("objects", F.array()), lambda x: F.struct(F.lit("object").alias("kind"), x.alias("x"))))).alias("o"))
    rows = rows.select("scenario_id", F.col("o.kind").alias("kind"), F.get("o.x", 0).alias("obstacle_id"), F.get("o.x", 1).alias("text"), F.get("o.x", 2).alias("wkt"))
    widths = depth_bin_width(rows.where("kind = 'depth'"), "text")
    width = F.when(F.col("kind") == "depth", F.coalesce("bin_m", F.lit(0.0))).otherwise(0.0)
    return ring_edges(rows.join(widths, "scenario_id", "left").select("scenario_id", "kind", "obstacle_id", depth_m(F.col("text"), width).alias("value_m"), "wkt"))


def depth_m(text, bin_m=0.0):
    """Metres of '12' or '-12.5' (with the width of a bin added), or of '10-20' and '-20--10' (the deeper end)."""
    number = r"([0-9]*\.?[0-9]+)"
    upper = F.regexp_extract(text, rf"^\s*{number}\s*-\s*{number}\s*$", 2).try_cast("double")
    below = F.regexp_extract(text, rf"^\s*-{number}\s*-\s*-{number}\s*$", 1).try_cast("double")
    return F.coalesce(upper, below, F.abs(F.regexp_extract(text, rf"^\s*(-?{number})", 1).try_cast("double")) + bin_m)


def depth_bin_width(depths: DataFrame, text: str = "depth") -> DataFrame:
    """Per scenario_id: the commonest step between neighbouring depths that are single numbers, to 0.1 m; of equally
    common ones the step met first from the surface down, 0 if there is none."""
    value = F.abs(F.regexp_extract(F.col(text), r"^\s*(-?[0-9]*\.?[0-9]+)\s*$", 1).try_cast("double"))
    own = depths.select("scenario_id", value.alias("d")).where("d is not null").distinct()
    steps = own.withColumn("step", F.round(F.lead("d").over(Window.partitionBy("scenario_id").orderBy("d")) - F.col("d"), 1)).where("step is not null")
    often = steps.groupBy("scenario_id", "step").agg(F.count("*").alias("n"), F.min("d").alias("at"))
    best = often.groupBy("scenario_id").agg(F.max(F.struct("n", -F.col("at"), "step")).alias("b"))
    return depths.select("scenario_id").distinct().join(best, "scenario_id", "left").select("scenario_id", F.greatest(F.coalesce("b.step", F.lit(0.0)), F.lit(0.0)).alias("bin_m"))


def year_counts(root: str, spark: SparkSession, tables: list[str], year: int) -> DataFrame:
    """(table, rows) of the partitions of one year."""
    out = None
    for name in tables:
        n = spark.read.parquet(f"{root}/{name}").where(F.col("year") == year).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = n if out is None else out.unionByName(n)
    return out


def without_year(rows: DataFrame, watermarks: DataFrame, year: int) -> tuple[DataFrame, DataFrame]:
    """What is left when a year is wiped: rows of other years, and watermarks whose last_t is not in it."""
    inside = (F.col("last_t") >= F.lit(f"{year}-01-01").cast("timestamp")) & (F.col("last_t") < F.lit(f"{year + 1}-01-01").cast("timestamp"))
    return rows.where(F.col("year") != year), watermarks.where(~F.coalesce(inside, F.lit(False)))


def ship_code_ratios(codes: DataFrame) -> DataFrame:
    """(ship_code, lpp_min, length_m, beam_m, moulded_m, draught_m, speed_kn) of a table of expected ratios.

    codes: ship_code, lpp_min, n_total, e_l, e_lb, e_bd, e_dt, e_v.  Rows that sum up others (lpp_min below 0) or
    stand for no ship go; where a ratio is not above 0 what depends on it is 0.
    """
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.nullif(b, F.lit(0.0))).otherwise(0.0)
    rows = codes.where("lpp_min >= 0 and n_total > 0").withColumn("beam_m", part("e_l", "e_lb"))
    rows = rows.withColumn("moulded_m", part("beam_m", "e_bd")).withColumn("draught_m", part("moulded_m", "e_dt"))
    return rows.select("ship_code", "lpp_min", F.col("e_l").alias("length_m"), "beam_m", "moulded_m", "draught_m", F.col("e_v").alias("speed_kn"))


#: Categories of another system's ship types (fixed values).
SOURCE_TYPES = {
    "Fishing ship": "Fishing", "Support ship": "Towing", "Pleasure boat": "Pleasure Craft", "Fast ferry": "High speed craft (HSC)",
    "Passenger ship": "Passenger, all ships of this type", "General cargo ship": "Cargo, all ships of this type", "Container ship": "Cargo, all ships of this type",
    "Bulk carrier": "Cargo, all ships of this type", "Ro-Ro cargo ship": "Cargo, all ships of this type", "Crude oil tanker": "Tanker, all ships of this type",
    "Oil products tanker": "Tanker, all ships of this type", "Chemical tanker": "Tanker, all ships of this type", "Gas tanker": "Tanker, all ships of this type",
    "Other ship": "Other Type, all ships of this type",
}


def mapped_cells(rows: DataFrame, keys: list[str], values: list[str], add_up: bool = False) -> DataFrame:
    """Cells of another system's ship types (source_type, seq) by category: the last row of each counts (of equal seq the larger values), or all are summed.

    Unknown types count as the last category.  With add_up, ``freq`` is summed and other values are weighted by it.
    """
    known = F.create_map(*[F.lit(x) for pair in SOURCE_TYPES.items() for x in pair])
    typed = rows.withColumn("category", F.coalesce(F.element_at(known, F.col("source_type")), F.lit(SOURCE_TYPES["Other ship"])))
    per = typed.groupBy(*keys, "category")
    if add_up:
        return per.agg(*[F.sum("freq").alias(v) if v == "freq" else F.try_divide(F.sum(F.col(v) * F.col("freq")), F.sum("freq")).alias(v) for v in values])
    return per.agg(F.max(F.struct("seq", *values)).alias("last_")).select(*keys, "category", *[f"last_.{v}" for v in values])


def ring_edges(rows: DataFrame, wkt: str = "wkt") -> DataFrame:
    """One row per edge of each ring of POLYGON and MULTIPOLYGON texts: part, hole, edge, a_lon, a_lat, b_lon, b_lat.

    A part is a ring; it is a hole unless it is the first of its polygon, which a second bracket opens.
    """
    ring = lambda k: F.regexp_extract_all(F.col(wkt), F.lit(r"(\(?)\s*\(([^()]+)\)"), F.lit(k))
    rings = F.arrays_zip(ring(1).alias("open"), ring(2).alias("text"))
    points = lambda ring: F.filter(F.transform(F.split(ring, ","), lambda p: F.transform(F.split(F.trim(p), r"\s+"), lambda n: n.try_cast("double"))), lambda p: (F.size(p) >= 2) & F.get(p, 0).isNotNull() & F.get(p, 1).isNotNull())
    out = rows.select(*[c for c in rows.columns if c != wkt], F.posexplode(rings).alias("part", "ring")).withColumn("hole", F.col("ring.open") == "").withColumn("pts", points(F.col("ring.text"))).where(F.size("pts") >= 4)
    out = out.select("*", F.posexplode(F.slice("pts", F.lit(1), F.size("pts") - 1)).alias("edge", "a")).withColumn("b", F.element_at("pts", F.col("edge") + 2))
    return out.select(*[c for c in rows.columns if c != wkt], "part", "hole", "edge", F.get("a", 0).alias("a_lon"), F.get("a", 1).alias("a_lat"), F.get("b", 0).alias("b_lon"), F.get("b", 1).alias("b_lat"))


def list_runs(runs: DataFrame) -> DataFrame:
    """The runs, newest first."""
    return runs.orderBy(F.desc("run_id"))


def get_run(runs: DataFrame, run_id: int) -> DataFrame:
    return runs.where(F.col("run_id") == run_id)


def without_run(runs: DataFrame, run_id: int) -> DataFrame:
    """The runs without one; a table partitioned by run_id drops that partition when it is written again."""
    return runs.where(F.col("run_id") != run_id)


def compare_runs(runs: DataFrame, ids: list[int]) -> DataFrame:
    """The rows of the runs asked for, with their place in the order asked for."""
    wanted = runs.sparkSession.createDataFrame(list(enumerate(ids)), "place int, run_id long")
    return runs.join(F.broadcast(wanted), "run_id").orderBy("place")


def matrix_cells(rows: DataFrame, names: list[str]) -> DataFrame:
    """Long cells of [type][size] matrices (arrays of arrays, one column per name); those without a positive frequency go.

    The first name is the frequency.  Values may be text; what is no number, or lies in a row that a matrix lacks, is null.
    """
    keys = [c for c in rows.columns if c not in names]
    out = rows.select(*keys, F.posexplode(F.arrays_zip(*names)).alias("ship_type", "row"))
    out = out.select(*keys, "ship_type", F.posexplode(F.arrays_zip(*[F.coalesce(F.col(f"row.{n}"), F.array()).alias(n) for n in names])).alias("size_bin", "cell"))
    out = out.select(*keys, "ship_type", "size_bin", *[F.col(f"cell.{n}").try_cast("double").alias(n) for n in names])
    return out.where(F.col(names[0]) > 0)


def depth_bands(cells: DataFrame, edges: list[float], z: str = "z") -> DataFrame:
    """Adds band_m: the upper end of the band (low, high] of depth -z; cells in no band go."""
    band = F
    for low, high in zip(edges, edges[1:]):
        band = band.when((-F.col(z) > low) & (-F.col(z) <= high), F.lit(float(high)))
    return cells.withColumn("band_m", band).where("band_m is not null")


def mapped_registry(table: DataFrame, columns: dict[str, str | None]) -> DataFrame:
    """A vessel registry under canonical names: mmsi and any of loa_m, beam_m, ship_type, air_draught_m; what is not mapped is null."""
    kinds = {"loa_m": "double", "beam_m": "double", "ship_type": "int", "air_draught_m": "double"}
    pick = lambda n, k: (F.col(columns[n]) if columns.get(n) else F.lit(None)).cast(k).alias(n)
    return table.select(F.col(columns["mmsi"]).cast("long").alias("mmsi"), *[pick(n, k) for n, k in kinds.items()])


def with_defaults(settings: DataFrame, defaults: dict[str, float], key: str = "scenario_id") -> DataFrame:
    """Settings (scenario, name, value) of every scenario for every default's name; a missing or null value is the default."""
    base = settings.sparkSession.createDataFrame(list(defaults.items()), "name string, default double")
    grid = settings.select(key).distinct().withColumn("name", F.explode(F.array(*[F.lit(n) for n in defaults])))
    return grid.join(F.broadcast(base), "name").join(settings, [key, "name"], "left").select(key, "name", F.coalesce("value", "default").alias("value"))
