"""Route legs, waypoints and junctions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairway.functions import expr as X

from .passages import cells

EPS = 1e-9


def parse_point(text: Column) -> Column:
    """(lon, lat) of 'lon lat', 'lon, lat' or 'POINT(lon lat)'; null parts where there is no number."""
    number = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
    part = lambda i: F.regexp_extract(text, rf"^\s*(?:POINT\s*\(\s*)?({number})[\s,]+({number})\s*\)?\s*$", i).try_cast("double")
    return F.struct(part(1).alias("lon"), part(2).alias("lat"))


def format_point(lon: Column, lat: Column) -> Column:
    return F.format_string("%.6f %.6f", lon, lat)


def with_length(legs: DataFrame, stored: str | None = None) -> DataFrame:
    """Adds length_m: the stored length if it is positive, else the great-circle distance."""
    own = F.expr(X.haversine("lon1", "lat1", "lon2", "lat2", X.EARTH_ROUTE_M))
    return legs.withColumn("length_m", F.coalesce(F.when(F.col(stored) > 0, F.col(stored)), own) if stored else own)


def leg_ends(legs: DataFrame) -> DataFrame:
    """One row per leg end: leg_id, side, lon, lat, and the other end."""
    side = lambda k, a, b: F.struct(F.lit(k).alias("side"), F.col(f"lon{a}").alias("lon"), F.col(f"lat{a}").alias("lat"), F.col(f"lon{b}").alias("far_lon"), F.col(f"lat{b}").alias("far_lat"))
    return legs.select("leg_id", F.explode(F.array(side("start", 1, 2), side("end", 2, 1))).alias("e")).select("leg_id", "e.*")


def junctions(legs: DataFrame, digits: int = 6) -> DataFrame:
    """Leg ends at points that at least two legs share: junction_id, leg_id, side, outward bearing."""
    key = format_point(F.round("lon", digits), F.round("lat", digits))
    ends = leg_ends(legs).withColumn("junction_id", F.concat(F.lit("j_"), F.regexp_replace(key, " ", "_")))
    ends = ends.withColumn("bearing", F.expr(X.outward("lon", "lat", "far_lon", "far_lat")))
    shared = ends.groupBy("junction_id").agg(F.count_distinct("leg_id").alias("n_legs")).where("n_legs >= 2")
    return ends.join(shared, "junction_id").select("junction_id", "leg_id", "side", "bearing", "n_legs")


def geometric_shares(ends: DataFrame, decay_deg: float = 30.0) -> DataFrame:
    """Share of each out-leg per in-leg: exp(-deflection / decay), normalised; alike if all vanish."""
    a = ends.select("junction_id", F.col("leg_id").alias("in_leg"), F.col("bearing").alias("b_in"))
    b = ends.select("junction_id", F.col("leg_id").alias("out_leg"), F.col("bearing").alias("b_out"))
    pairs = a.join(b, "junction_id").where("in_leg <> out_leg").withColumn("deflection", F.expr(f"180e0 - {X.turn('b_in', 'b_out')}"))
    w = Window.partitionBy("junction_id", "in_leg")
    pairs = pairs.withColumn("weight", F.exp(-F.col("deflection") / decay_deg))
    total = F.sum("weight").over(w)
    return pairs.withColumn("share", F.when(total > 0, F.col("weight") / total).otherwise(1.0 / F.count("*").over(w))).drop("weight", "b_in", "b_out")


def chosen_shares(geometric: DataFrame, measured: DataFrame, user: DataFrame) -> DataFrame:
    """Rows by (junction, in_leg) from the user's matrix, else from measured shares, else from geometry."""
    key = ["junction_id", "in_leg"]
    tag = lambda df, s: df.select(*key, "out_leg", "share", F.lit(s).alias("source"))
    rest = measured.join(user, key, "left_anti")
    last = geometric.join(user, key, "left_anti").join(measured, key, "left_anti")
    return tag(user, "user").unionByName(tag(rest, "ais")).unionByName(tag(last, "geometry"))


def share_findings(shares: DataFrame, ends: DataFrame) -> DataFrame:
    """(junction_id, in_leg, check) for rows that do not sum to 1, legs without a row, and unknown legs."""
    key = ["junction_id", "in_leg"]
    legs = ends.select("junction_id", F.col("leg_id").alias("in_leg")).distinct()
    sums = shares.groupBy(*key).agg(F.sum("share").alias("s")).where(F.abs(F.col("s") - 1) > 1e-6).select(*key, F.lit("row_sum").alias("check"))
    missing = legs.join(shares, key, "left_anti").select(*key, F.lit("missing_row").alias("check"))
    foreign = shares.select("junction_id", F.col("out_leg").alias("in_leg")).distinct().join(legs, key, "left_anti").select(*key, F.lit("unknown_leg").alias("check"))
    return sums.unionByName(missing).unionByName(foreign)


def close_waypoints(legs: DataFrame, share: float = 0.05, size: float = 0.05) -> DataFrame:
    """Pairs of waypoints nearer than a share of the shortest leg at either, nearest first."""
    ends = leg_ends(with_length(legs).select("leg_id", "lon1", "lat1", "lon2", "lat2")).join(with_length(legs).select("leg_id", "length_m"), "leg_id")
    points = ends.groupBy(F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat")).agg(F.min("length_m").alias("least_m"))
    points = points.withColumn("key", format_point(F.col("lon"), F.col("lat")))
    near = points.withColumn("i", F.floor(F.col("lon") / size)).withColumn("j", F.floor(F.col("lat") / size))
    around = points.select(*[F.col(c).alias(f"{c}_b") for c in points.columns], F.explode(F.sequence(F.floor(F.col("lon") / size) - 1, F.floor(F.col("lon") / size) + 1)).alias("i"))
    around = around.withColumn("j", F.explode(F.sequence(F.floor(F.col("lat_b") / size) - 1, F.floor(F.col("lat_b") / size) + 1)))
    pairs = near.join(around, ["i", "j"]).where("key < key_b").withColumn("distance_m", F.expr(X.haversine("lon", "lat", "lon_b", "lat_b", X.EARTH_ROUTE_M)))
    return pairs.where(F.col("distance_m") < share * F.least("least_m", "least_m_b")).select(F.col("key").alias("a"), F.col("key_b").alias("b"), "distance_m")


def intersections(legs: DataFrame) -> DataFrame:
    """Inner crossings of legs: (leg_a, leg_b, t, u, lon, lat), leg_a < leg_b, t and u along each."""
    a = legs.select(F.col("leg_id").alias("leg_a"), *[F.col(c).alias(f"{c}_a") for c in ("lon1", "lat1", "lon2", "lat2")]).withColumn("cell", F.explode(cells("lon1_a", "lat1_a", "lon2_a", "lat2_a")))
    b = legs.select(F.col("leg_id").alias("leg_b"), *[F.col(c).alias(f"{c}_b") for c in ("lon1", "lat1", "lon2", "lat2")]).withColumn("cell", F.explode(cells("lon1_b", "lat1_b", "lon2_b", "lat2_b")))
    both = a.join(b, "cell").where("leg_a < leg_b").drop("cell").distinct()
    both = both.withColumn("det", F.expr("nullif((lon2_a - lon1_a) * (lat2_b - lat1_b) - (lat2_a - lat1_a) * (lon2_b - lon1_b), 0e0)"))
    both = both.withColumn("t", F.expr("((lon1_b - lon1_a) * (lat2_b - lat1_b) - (lat1_b - lat1_a) * (lon2_b - lon1_b)) / det"))
    both = both.withColumn("u", F.expr("((lon1_b - lon1_a) * (lat2_a - lat1_a) - (lat1_b - lat1_a) * (lon2_a - lon1_a)) / det"))
    both = both.where(F.col("t").between(EPS, 1 - EPS) & F.col("u").between(EPS, 1 - EPS))
    return both.select("leg_a", "leg_b", "t", "u", F.expr("lon1_a + t * (lon2_a - lon1_a)").alias("lon"), F.expr("lat1_a + t * (lat2_a - lat1_a)").alias("lat"))


def split_legs(legs: DataFrame, crossings: DataFrame) -> DataFrame:
    """Legs cut at their crossings: parent_id, part (from 0) and the ends of each part."""
    cuts = crossings.select(F.col("leg_a").alias("leg_id"), "t").unionByName(crossings.select(F.col("leg_b").alias("leg_id"), F.col("u").alias("t")))
    cuts = cuts.groupBy("leg_id").agg(F.array_sort(F.collect_set("t")).alias("ts"))  # as many as legs that cross one
    out = legs.join(cuts, "leg_id", "left").withColumn("ts", F.concat(F.array(F.lit(0.0)), F.coalesce("ts", F.array().cast("array<double>")), F.array(F.lit(1.0))))
    out = out.select("*", F.posexplode(F.slice("ts", F.lit(1), F.size("ts") - 1)).alias("part", "t1")).withColumn("t2", F.element_at("ts", F.col("part") + 2))
    at = lambda c, t: F.col(f"{c}1") + F.col(t) * (F.col(f"{c}2") - F.col(f"{c}1"))
    return out.select(F.col("leg_id").alias("parent_id"), "part", at("lon", "t1").alias("a_lon"), at("lat", "t1").alias("a_lat"), at("lon", "t2").alias("b_lon"), at("lat", "t2").alias("b_lat"))


def bounding_box(legs: DataFrame, percent: float = 0.0) -> DataFrame:
    """One row: the legs' box, widened by a percentage of its sides."""
    box = legs.agg(*[f(g(f"{c}1", f"{c}2")).alias(n) for f, g, c, n in ((F.min, F.least, "lon", "w"), (F.min, F.least, "lat", "s"), (F.max, F.greatest, "lon", "e"), (F.max, F.greatest, "lat", "n"))])
    k = percent / 100.0
    return box.select((F.col("w") - (F.col("e") - F.col("w")) * k).alias("west"), (F.col("s") - (F.col("n") - F.col("s")) * k).alias("south"), (F.col("e") + (F.col("e") - F.col("w")) * k).alias("east"), (F.col("n") + (F.col("n") - F.col("s")) * k).alias("north"))


def compass(bearing: Column) -> Column:
    """Name of the quadrant that a bearing points to."""
    return F.when((bearing >= 315) | (bearing < 45), "North").when(bearing < 135, "East").when(bearing < 225, "South").otherwise("West")


def merge_waypoints(legs: DataFrame, merges: DataFrame) -> DataFrame:
    """Legs with ends moved by merges (key, lon, lat), key being format_point of the old end."""
    out = legs
    for k in ("1", "2"):
        to = merges.select(F.col("key").alias("key_"), F.col("lon").alias("lon_"), F.col("lat").alias("lat_"))
        out = out.withColumn("key_", format_point(F.col(f"lon{k}"), F.col(f"lat{k}"))).join(to, "key_", "left")
        out = out.withColumn(f"lon{k}", F.coalesce("lon_", f"lon{k}")).withColumn(f"lat{k}", F.coalesce("lat_", f"lat{k}")).drop("key_", "lon_", "lat_")
    return out


def next_legs(legs: DataFrame) -> DataFrame:
    """The first leg (by id) that starts where each leg ends, and the bend between: leg_id, next_leg, bend_deg."""
    key = lambda k: format_point(F.round(f"lon{k}", 6), F.round(f"lat{k}", 6))
    own = legs.select("leg_id", key("2").alias("p"), F.expr(X.outward("lon1", "lat1", "lon2", "lat2")).alias("b1"))
    other = legs.select(F.col("leg_id").alias("next_leg"), key("1").alias("p"), F.expr(X.outward("lon1", "lat1", "lon2", "lat2")).alias("b2"))
    best = own.join(other, "p").where("leg_id <> next_leg").groupBy("leg_id", "b1").agg(F.min(F.struct("next_leg", "b2")).alias("n"))
    return best.select("leg_id", "n.next_leg", F.expr(X.turn("b1", "n.b2")).alias("bend_deg"))
