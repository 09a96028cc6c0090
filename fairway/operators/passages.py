"""Passages of segments over legs, and traffic tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairway.functions import expr as X

CELL = 0.05
#: AIS ship and cargo codes, first to last, of each ship category (fixed values); all others are OTHER_TYPE.
CATEGORIES = {
    "Fishing": (30, 30),
    "Towing": (31, 32),
    "Dredging or underwater ops": (33, 33),
    "Diving ops": (34, 34),
    "Military ops": (35, 35),
    "Sailing": (36, 36),
    "Pleasure Craft": (37, 37),
    "High speed craft": (40, 49),
    "Pilot Vessel": (50, 50),
    "Search and Rescue vessel": (51, 51),
    "Tug": (52, 52),
    "Port Tender": (53, 53),
    "Anti-pollution equipment": (54, 54),
    "Law Enforcement": (55, 55),
    "Spare": (56, 57),
    "Medical Transport": (58, 58),
    "Noncombatant ship": (59, 59),
    "Passenger": (60, 69),
    "Cargo": (70, 79),
    "Tanker": (80, 89),
}
OTHER_TYPE = 20


def passage_lines(legs: DataFrame) -> DataFrame:
    """Adds bearing and the line across each leg's midpoint, width_m long: pl_lon1, pl_lat1, pl_lon2, pl_lat2."""
    out = legs.withColumn("bearing", F.expr(X.bearing("lon1", "lat1", "lon2", "lat2")))
    out = out.withColumn("mid_lon", (F.col("lon1") + F.col("lon2")) / 2).withColumn("mid_lat", (F.col("lat1") + F.col("lat2")) / 2)
    for k, side in (("1", "bearing - 90e0"), ("2", "bearing + 90e0")):
        out = out.withColumn(f"pl_lon{k}", F.expr(X.destination_lon("mid_lon", "mid_lat", side, "width_m / 2e0"))).withColumn(f"pl_lat{k}", F.expr(X.destination_lat("mid_lat", side, "width_m / 2e0")))
    return out


def cells(x1: str, y1: str, x2: str, y2: str, size: float = CELL) -> Column:
    """Grid cells that the box of two points touches."""
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size))
    return F.flatten(F.transform(span(x1, x2), lambda i: F.transform(span(y1, y2), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def crossings(segments: DataFrame, legs: DataFrame) -> DataFrame:
    """Segments that cross a leg's passage line, with the crossing's place u along the line and w along the segment.

    Both sides are dealt to grid cells and meet by cell; a pair that shares several cells is kept in the one
    that holds the crossing, so nothing need be made distinct.
    """
    lines = passage_lines(legs).select("leg_id", "bearing", "width_m", "pl_lon1", "pl_lat1", "pl_lon2", "pl_lat2")
    lines = lines.withColumn("cell", F.explode(cells("pl_lon1", "pl_lat1", "pl_lon2", "pl_lat2")))
    moves = segments.withColumn("cell", F.explode(cells("lon1", "lat1", "lon2", "lat2")))
    both = moves.join(lines, "cell").withColumns({"dx_": F.expr("lon2 - lon1"), "dy_": F.expr("lat2 - lat1"), "px_": F.expr("pl_lon2 - pl_lon1"), "py_": F.expr("pl_lat2 - pl_lat1")})
    both = both.withColumn("det_", F.expr("nullif(dx_ * py_ - dy_ * px_, 0e0)"))
    both = both.withColumn("w", F.expr("((pl_lon1 - lon1) * py_ - (pl_lat1 - lat1) * px_) / det_")).withColumn("u", F.expr("((pl_lon1 - lon1) * dy_ - (pl_lat1 - lat1) * dx_) / det_"))
    both = both.where("w between 0e0 and 1e0 and u between 0e0 and 1e0")
    own = F.struct(F.floor(F.expr("lon1 + w * dx_") / CELL).alias("i"), F.floor(F.expr("lat1 + w * dy_") / CELL).alias("j"))
    return both.where(own == F.col("cell")).drop("cell", "dx_", "dy_", "px_", "py_", "det_")


def lateral_offset(crossed: DataFrame) -> DataFrame:
    """Adds offset_m: signed distance of the crossing from the middle of the line."""
    return crossed.withColumn("offset_m", (F.col("u") - 0.5) * F.col("width_m"))


def direction(crossed: DataFrame, max_angle: float = 45.0) -> DataFrame:
    """Adds dir_idx: 0 along the leg, 1 against it; other courses go."""
    along = F.expr(X.turn("cog", "bearing"))
    return crossed.withColumn("dir_idx", F.when(along < max_angle, 0).when(180.0 - along < max_angle, 1)).where("dir_idx is not null")


def ship_category(code: Column) -> Column:
    """Place of a ship and cargo code's category; null and all other codes are OTHER_TYPE."""
    out = F
    for i, (low, high) in enumerate(CATEGORIES.values()):
        out = out.when(code.between(low, high), F.lit(i))
    return out.otherwise(F.lit(OTHER_TYPE))


def length_bin(loa: Column, bins: int = 15, width: int = 25) -> Column:
    """Bin i of lengths in (25 i, 25 (i + 1)]; null counts as 100 m; out of range is the last bin."""
    whole = F.coalesce(loa.cast("int"), F.lit(100))
    i = F.ceil(whole / width).cast("int") - 1
    return F.when(i.between(0, bins - 1), i).otherwise(bins - 1).cast("int")


def plausible(a: Column, b: Column, fallback: Column, low: float, high: float) -> Column:
    """a + b if it can be a ship's dimension, else the fallback."""
    return F.when((a + b < low) | (a > high) | (b > high), fallback).otherwise(a + b)


def traffic(passages: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """Counts times the multiplier, and means of the values that are known, per (leg, direction, type, size); draught_m where passages have it."""
    mean = lambda c: F.avg(c).alias(c)
    return passages.groupBy("leg_id", "dir_idx", "ship_type", "size_bin").agg((F.count("*") * F.lit(multiplier)).alias("freq"), mean("speed_kn"), mean("beam_m"), mean("height_m"), *([mean("draught_m")] if "draught_m" in passages.columns else []))


def dense(cells_: DataFrame, legs: DataFrame, types: int = 21, bins: int = 15) -> DataFrame:
    """Every (leg, direction, type, size), with frequency 0 and scaling 100 where there is none."""
    grid = legs.select("leg_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("dir_idx"))
    grid = grid.withColumn("ship_type", F.explode(F.sequence(F.lit(0), F.lit(types - 1)))).withColumn("size_bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(cells_, ["leg_id", "dir_idx", "ship_type", "size_bin"], "left").withColumn("freq", F.coalesce("freq", F.lit(0.0))).withColumn("scaling", F.lit(100.0))


def lateral_fit(offsets: DataFrame) -> DataFrame:
    """Mean, population deviation and range of the offsets per leg and direction."""
    return offsets.groupBy("leg_id", "dir_idx").agg(F.count("*").alias("n"), F.avg("offset_m").alias("mean_m"), F.coalesce(F.stddev_pop("offset_m"), F.lit(0.0)).alias("std_m"), F.min("offset_m").alias("min_m"), F.max("offset_m").alias("max_m"))


def coverage(times: DataFrame, t: str = "t_s", max_gap_s: float = 43200.0) -> DataFrame:
    """Span, gaps over max_gap_s, covered seconds and the factor that makes a year of them.

    Times fall into buckets as long as the least gap, so no such gap lies inside one: each bucket's first and last
    time, which combine before the shuffle, say all.
    """
    bucket = F.floor(F.col(t) / max_gap_s).alias("bucket")
    ends = times.groupBy(bucket).agg(F.min(t).alias("first"), F.max(t).alias("last"))
    gap = F.col("first") - F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("bucket"))  # two rows a day
    between = ends.withColumn("gap", gap)
    got = between.agg(F.min("first").alias("a"), F.max("last").alias("b"), F.coalesce(F.sum(F.when(F.col("gap") > max_gap_s, F.col("gap"))), F.lit(0.0)).alias("gaps_s"))
    got = got.select((F.col("b") - F.col("a")).alias("span_s"), "gaps_s", (F.col("b") - F.col("a") - F.col("gaps_s")).alias("covered_s"))
    return got.withColumn("multiplier", F.when(F.col("covered_s") > 0, F.lit(365.0 * 86400.0) / F.col("covered_s")))


def leg_passages(crossed: DataFrame) -> DataFrame:
    """(leg_id, mmsi, t_s): when vessels passed each leg's line, repeated segments once; rows without a vessel or a time go."""
    return crossed.where("mmsi is not null and t1 is not null").select("leg_id", "mmsi", F.col("t1").alias("t_s")).distinct()


def junction_visits(passages: DataFrame, junctions: DataFrame) -> DataFrame:
    """(junction_id, mmsi, leg_id, t_s): passages of the legs (junction_id, leg_id) that meet at each junction."""
    return passages.join(junctions.select("junction_id", "leg_id").distinct(), "leg_id").select("junction_id", "mmsi", "leg_id", "t_s")


def transitions(visits: DataFrame, window_s: float = 7200.0, consecutive: bool = False) -> DataFrame:
    """Counts of (in_leg, out_leg) per junction from visits (junction_id, mmsi, leg_id, t_s).

    A vessel's first passage of each leg counts.  The leg it came by stays the same until more than window_s
    pass without one; with ``consecutive`` each leg is the next one's.
    """
    firsts = visits.groupBy("junction_id", "mmsi", "leg_id").agg(F.min("t_s").alias("t_s"))
    ordered = firsts.groupBy("junction_id", "mmsi").agg(F.array_sort(F.collect_list(F.struct("t_s", "leg_id"))).alias("v"))  # at most one entry per leg of a junction
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    start = F.struct(F.lit(None).cast("double").alias("t"), F.lit(None).cast("bigint").alias("leg"), none.alias("out"))

    def step(s, x):
        near = s["leg"].isNotNull() & (x["t_s"] - s["t"] <= window_s)
        out = F.when(near & (x["leg_id"] != s["leg"]), F.concat(s["out"], F.array(F.struct(s["leg"].alias("a"), x["leg_id"].alias("b"))))).otherwise(s["out"])
        keep = near & F.lit(not consecutive)
        return F.struct(F.when(keep, s["t"]).otherwise(x["t_s"]).alias("t"), F.when(keep, s["leg"]).otherwise(x["leg_id"]).alias("leg"), out.alias("out"))

    pairs = ordered.select("junction_id", F.explode(F.aggregate("v", start, step)["out"]).alias("p"))
    return pairs.groupBy("junction_id", F.col("p.a").alias("in_leg"), F.col("p.b").alias("out_leg")).agg(F.count("*").alias("n"))


def shares(counts: DataFrame) -> DataFrame:
    """Each count's share of its (junction, in_leg)."""
    return counts.where("n > 0").withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("junction_id", "in_leg")))


def scaled(cells_: DataFrame, scale: Column) -> DataFrame:
    """Frequencies times a percentage; null and non-finite ones stay."""
    usable = F.col("freq").isNotNull() & ~F.isnan("freq") & (F.abs("freq") < float("inf"))
    return cells_.withColumn("freq", F.when(usable, F.col("freq") * F.coalesce(scale, F.lit(100.0)) / 100.0).otherwise(F.col("freq")))


def follow_global(own: Column, follows: Column, overall: Column) -> Column:
    """The global scale for rows that follow it (a missing flag does), else their own."""
    return F.when(F.coalesce(follows, F.lit(True)), overall).otherwise(own)


def ship_seconds(cells_: DataFrame, legs: DataFrame) -> DataFrame:
    """Seconds per year that ships are on each leg and direction."""
    length = legs.select("leg_id", F.expr(X.haversine("lon1", "lat1", "lon2", "lat2")).alias("length_m"))
    return cells_.where("speed_kn > 0").join(length, "leg_id").groupBy("leg_id", "dir_idx").agg(F.sum(F.col("freq") * F.col("length_m") / (F.col("speed_kn") * X.KNOT_MS)).alias("ship_s"))


def mean_speed(cells_: DataFrame) -> DataFrame:
    """Mean speed per leg and direction, weighted by frequency; 0 without traffic."""
    fine = cells_.where("freq > 0 and speed_kn > 0")
    return fine.groupBy("leg_id", "dir_idx").agg(F.coalesce(F.try_divide(F.sum(F.col("freq") * F.col("speed_kn")), F.sum("freq")), F.lit(0.0)).alias("speed_kn"))


def imputed(cells_: DataFrame, ratios: DataFrame) -> DataFrame:
    """Missing or zero beam and draught from the ratio table by (ship_type, size_bin), then length / 12 for draught."""
    fill = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.round(f"ref_{c}", 2))
    joined = cells_.join(ratios, ["ship_type", "size_bin"], "left").withColumn("beam_m", fill("beam_m"))
    return joined.withColumn("draught_m", F.coalesce(fill("draught_m"), (F.col("size_bin") * 25 + 12.5) / 12)).drop("ref_beam_m", "ref_draught_m")
