"""Roll-ups, comparisons and audits of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_contributor(df: DataFrame, keys: list[str], item: str, value: str) -> DataFrame:
    """Per key: total value, and the item that contributes most (of equals the smaller) with its value."""
    items = df.groupBy(*keys, item).agg(F.sum(value).alias("v"))
    best = F.max(F.struct("v", (-F.col(item)).alias("neg"))).alias("b")
    return items.groupBy(*keys).agg(F.sum("v").alias("total"), best).select(*keys, "total", (-F.col("b.neg")).alias("top"), F.col("b.v").alias("top_value"))


def pivoted(df: DataFrame, rows: list[str], column: str, values: list, value: str) -> DataFrame:
    """A row per key and a column per listed value."""
    return df.groupBy(*rows).pivot(column, values).agg(F.sum(value))


def classes(df: DataFrame, value: str, n: int = 5) -> DataFrame:
    """Adds class: n equal intervals over the positive values; one if they are all equal."""
    span = df.where(F.col(value) > 0).agg(F.min(value).alias("lo_"), F.max(value).alias("hi_"))
    rows = df.where(F.col(value) > 0).crossJoin(F.broadcast(span))  # one row
    step = (F.col("hi_") - F.col("lo_")) / n
    return rows.withColumn("class", F.when(step <= 0, 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo_")) / F.nullif(step, F.lit(0.0))), F.lit(n - 1))).cast("int")).drop("lo_", "hi_")


def compared(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison: difference, and percent of a (null if a is missing or 0 with b 0 too; infinite from 0)."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full_outer")
    percent = F.when(F.col("a").isNull() | F.col("b").isNull(), None).when(F.col("a") != 0, (F.col("b") - F.col("a")) / F.nullif("a", F.lit(0.0)) * 100).when(F.col("b") == 0, 0.0).otherwise(F.lit(float("inf")) * F.signum("b"))
    return both.select(key, "a", "b", (F.col("b") - F.col("a")).alias("delta"), percent.alias("delta_pct"))


def against_first(runs: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Adds delta_pct of each run to the first of its group."""
    base = F.first(value).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return runs.withColumn("delta_pct", F.when(base != 0, (F.col(value) - base) / base * 100))


def differences(a: DataFrame, b: DataFrame, key: list[str], value: str, rel: float = 1e-9, absolute: float = 1e-12) -> DataFrame:
    """Settings that differ, or are on one side only."""
    both = a.select(*key, F.col(value).alias("a")).join(b.select(*key, F.col(value).alias("b")), key, "full_outer")
    close = F.abs(F.col("a") - F.col("b")) <= F.greatest(rel * F.greatest(F.abs("a"), F.abs("b")), F.lit(absolute))
    return both.where(~F.coalesce(close, F.lit(False)))


def project_findings(cells: DataFrame) -> DataFrame:
    """Legs that do not have exactly two directions."""
    return cells.groupBy("leg_id").agg(F.count_distinct("dir_idx").alias("directions")).where("directions <> 2")


def drill_down(contributions: DataFrame, value: str, k: int | None = None) -> DataFrame:
    """Positive contributions, largest first (ties by key); the first k if asked for."""
    out = contributions.where(F.col(value) > 0).orderBy(F.desc(value), *[c for c in contributions.columns if c != value])
    return out.limit(k) if k else out


def run_totals(facts: DataFrame, kinds: list[str]) -> DataFrame:
    """One row per scenario with a column per accident kind; kinds without facts are 0."""
    return facts.groupBy("scenario_id").pivot("kind", kinds).agg(F.sum("frequency")).na.fill(0.0)


def leg_lengths(a: DataFrame, b: DataFrame) -> DataFrame:
    """Leg lengths of two projects; legs on one side only are kept."""
    return a.select("leg_id", F.col("length_m").alias("a_m")).join(b.select("leg_id", F.col("length_m").alias("b_m")), "leg_id", "full_outer").withColumn("delta_m", F.col("b_m") - F.col("a_m"))


def moved_ends(now: DataFrame, baseline: DataFrame, least_m: float = 25.0) -> DataFrame:
    """Leg ends that lie at least least_m from where the baseline has them."""
    from fairway.functions import expr as X

    old = baseline.select("leg_id", "side", F.col("lon").alias("lon0"), F.col("lat").alias("lat0"))
    both = now.join(old, ["leg_id", "side"]).withColumn("moved_m", F.expr(X.haversine("lon0", "lat0", "lon", "lat", X.EARTH_ROUTE_M)))
    return both.where(F.col("moved_m") >= least_m).select("leg_id", "side", "moved_m")


def by_direction(facts: DataFrame, angle: str, value: str, weighted: list[str]) -> DataFrame:
    """Per drift direction: the sum of a value, and means of other columns weighted by it."""
    means = [F.try_divide(F.sum(F.col(c) * F.col(value)), F.sum(value)).alias(c) for c in weighted]
    return facts.groupBy(angle).agg(F.sum(value).alias(value), *means)


def leg_directions(facts: DataFrame) -> DataFrame:
    """Per scenario, leg, travel and drift direction: frequency by accident, and the cells' mean chance not to be repaired."""
    per = facts.groupBy("scenario_id", "leg_id", "dir_idx", "direction")
    sums = [F.sum(F.when(F.col("accident") == a, F.col("frequency")).otherwise(0.0)).alias(a) for a in ("allision", "grounding", "anchoring")]
    hit = F.when(F.col("accident") != "anchoring", F.col("frequency"))
    return per.agg(*sums, F.try_divide(F.sum(F.col("p_not_repaired") * hit), F.sum(hit)).alias("p_not_repaired"))


def by_ship_category(facts: DataFrame, types: DataFrame, sizes: DataFrame) -> DataFrame:
    """Frequencies by accident and labelled ship category; types (ship_type, type_label), sizes (size_bin, size_label)."""
    sums = facts.groupBy("accident", "ship_type", "size_bin").agg(F.sum("frequency").alias("frequency"))
    return sums.join(types, "ship_type", "left").join(sizes, "size_bin", "left").select("accident", F.coalesce("type_label", F.col("ship_type").cast("string")).alias("type_label"), F.coalesce("size_label", F.col("size_bin").cast("string")).alias("size_label"), "frequency")


def collision_lines(contributions: DataFrame) -> DataFrame:
    """Per leg: head-on and overtaking (kind, leg_id, n) side by side, where their sum is positive."""
    side = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0.0)).alias(k) for k in ("headon", "overtaking")]
    return contributions.groupBy("leg_id").agg(*side).withColumn("combined", F.col("headon") + F.col("overtaking")).where("combined > 0")


def collision_points(contributions: DataFrame) -> DataFrame:
    """Per junction: crossing (with merging) and bend (kind, junction_id, n) side by side, where their sum is positive."""
    crossing = F.sum(F.when(F.col("kind").isin("crossing", "merging"), F.col("n")).otherwise(0.0)).alias("crossing")
    bend = F.sum(F.when(F.col("kind") == "bend", F.col("n")).otherwise(0.0)).alias("bend")
    return contributions.groupBy("junction_id").agg(crossing, bend).withColumn("combined", F.col("crossing") + F.col("bend")).where("combined > 0")


def summary(accidents: DataFrame) -> DataFrame:
    """Per kind of accident (kind, frequency): the yearly frequency, its share of all, and the mean years between two."""
    sums = accidents.groupBy("kind").agg(F.sum("frequency").alias("frequency"))
    whole = F.sum("frequency").over(Window.partitionBy(F.lit(0)))  # one row for each of the eight kinds
    return sums.select("kind", "frequency", F.try_divide(F.col("frequency"), whole).alias("share"), F.try_divide(F.lit(1.0), F.col("frequency")).alias("years_between"))
