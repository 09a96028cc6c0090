"""Expected yearly ship-ship collision candidates.

Head-on and overtaking pairs meet cell by cell inside a leg.  Crossing and bend sums factor into moments of
each leg's cells, so legs are paired by their moments and cells never cross.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairway.functions import expr as X

BIN_M, BEAM_SHARE, DEFAULT_KN = 25.0, 6.5, 10.0
#: Default causation factors (fixed values).
CAUSATION = {"headon": 4.9e-5, "overtaking": 1.1e-4, "crossing": 1.3e-4, "bend": 1.3e-4, "grounding": 1.6e-4, "allision": 1.9e-4}
NO_TURN, LEAST_TURN_DEG = 0.01, 5.0


def scope(*tables: DataFrame) -> list[str]:
    """The scenario's key, where all of the tables have it."""
    return ["scenario_id"] if all("scenario_id" in t.columns for t in tables) else []


def lateral_mixture(lateral: DataFrame) -> DataFrame:
    """Mean and deviation of each leg and direction's mixture of normals; a deviation under 1 m goes."""
    total = F.sum("weight")
    mean = F.sum(F.col("weight") * F.col("mean_m")) / total
    square = F.sum(F.col("weight") * (F.col("std_m") ** 2 + F.col("mean_m") ** 2)) / total
    out = lateral.groupBy(*scope(lateral), "leg_id", "dir_idx").agg(mean.alias("mu"), square.alias("square_"))
    return out.withColumn("sigma", F.sqrt(F.greatest(F.col("square_") - F.col("mu") ** 2, F.lit(0.0)))).drop("square_").where("sigma >= 1")


def ship_cells(cells: DataFrame) -> DataFrame:
    """Cells with speed in m/s, length and beam, defaults where missing, and a cell key."""
    loa = (F.col("size_bin") + 0.5) * BIN_M
    speed = F.when(F.col("speed_kn") > 0, F.col("speed_kn")).otherwise(DEFAULT_KN) * X.KNOT_MS
    beam = F.when(F.col("beam_m") > 0, F.col("beam_m")).otherwise(loa / BEAM_SHARE)
    return cells.where("freq > 0").select(*scope(cells), "leg_id", "dir_idx", F.struct("ship_type", "size_bin").alias("cell"), F.col("freq").alias("q"), speed.alias("v"), loa.alias("loa"), beam.alias("b"))


def _named(df: DataFrame, k: str) -> DataFrame:
    leg = [*scope(df), "leg_id"]
    return df.select(*leg, *[F.col(c).alias(f"{c}{k}") for c in df.columns if c not in leg])


def _in_reach(pair: DataFrame, mu: str) -> DataFrame:
    """Adds p: the chance that the lateral distance of a pair is within their mean beam."""
    pair = pair.withColumn("spread", F.expr("sqrt(sigma1 * sigma1 + sigma2 * sigma2)"))
    pair = pair.withColumn("z1", F.expr(f"({mu} + (b1 + b2) / 2e0) / spread")).withColumn("z2", F.expr(f"({mu} - (b1 + b2) / 2e0) / spread"))
    return pair.withColumn("p", F.expr(f"{X.phi('z1')} - {X.phi('z2')}"))


def _with_mixture(cells: DataFrame, mixture: DataFrame, legs: DataFrame) -> tuple[DataFrame, list[str], DataFrame]:
    own = scope(cells, mixture, legs)
    c = ship_cells(cells).join(mixture, [*own, "leg_id", "dir_idx"])
    return c, [*own, "leg_id"], legs.select(*own, "leg_id", "length_m")


def head_on(cells: DataFrame, mixture: DataFrame, legs: DataFrame) -> DataFrame:
    """(kind, leg_id, cell1, cell2, n) of opposing cells of a leg (and scenario_id, if all tables have it)."""
    c, leg, lengths = _with_mixture(cells, mixture, legs)
    pair = _named(c.where("dir_idx = 0"), "1").join(_named(c.where("dir_idx = 1"), "2"), leg).join(lengths, leg)
    pair, p = _in_reach(pair, "(mu1 - mu2)"), F.col("p")
    n = F.col("q1") / F.col("v1") * F.col("q2") / F.col("v2") * (F.col("v1") + F.col("v2")) * p * F.col("length_m") / X.YEAR_S
    return pair.select(F.lit("headon").alias("kind"), *leg, F.col("cell1"), F.col("cell2"), n.alias("n"))


def overtaking(cells: DataFrame, mixture: DataFrame, legs: DataFrame) -> DataFrame:
    """(kind, leg_id, cell1, cell2, n) of a faster and a slower cell of one leg and direction."""
    c, leg, lengths = _with_mixture(cells, mixture, legs)
    a, b = _named(c, "1").withColumnRenamed("dir_idx1", "dir_idx"), _named(c, "2").withColumnRenamed("dir_idx2", "dir_idx")
    pair = a.join(b, [*leg, "dir_idx"]).where("v1 > v2").join(lengths, leg)
    pair, p = _in_reach(pair, "0e0"), F.col("p")
    n = F.col("q1") / F.col("v1") * F.col("q2") / F.col("v2") * (F.col("v1") - F.col("v2")) * p * F.col("length_m") / X.YEAR_S
    return pair.select(F.lit("overtaking").alias("kind"), *leg, F.col("cell1"), F.col("cell2"), n.alias("n"))


def moments(cells: DataFrame, *by: str) -> DataFrame:
    """Per leg (and more keys): sums of q / v, q L / v and q B / v over both directions' cells."""
    f = F.col("q") / F.col("v")
    sums = F.sum(f).alias("s"), F.sum(f * F.col("loa")).alias("sl"), F.sum(f * F.col("b")).alias("sb")
    return ship_cells(cells).groupBy(*scope(cells), "leg_id", *by).agg(*sums)


def crossing_geometry(ends: DataFrame, least_rad: float = 0.1, merging_deg: float = 30.0) -> DataFrame:
    """Pairs of legs at a junction: leg_a < leg_b, angle folded to [0, 90] degrees, kind by angle."""
    own = [*scope(ends), "junction_id"]
    a = ends.select(*own, F.col("leg_id").alias("leg_a"), F.col("bearing").alias("ba"))
    b = ends.select(*own, F.col("leg_id").alias("leg_b"), F.col("bearing").alias("bb"))
    pair = a.join(b, own).where("leg_a < leg_b").withColumn("turn", F.expr(X.turn("ba", "bb")))
    pair = pair.withColumn("angle", F.least("turn", 180.0 - F.col("turn"))).where(F.radians("angle") >= least_rad)
    return pair.select(*own, "leg_a", "leg_b", "angle", F.when(F.col("angle") <= merging_deg, "merging").otherwise("crossing").alias("kind"))


def _pairs_of_moments(a: DataFrame, b: DataFrame, pairs: DataFrame, shares: DataFrame) -> DataFrame:
    """Crossing pairs with both legs' moments and the factor 1 - share(a to b) * share(b to a).

    A leg pair without a share (no junction matrix, no row, or not in its row) has share 0: all its traffic crosses.
    """
    own = scope(a)
    named = lambda m, k: m.select(*own, *[F.col(c).alias(f"{c}_{k}" if c != "leg_id" else f"leg_{k}") for c in m.columns if c not in own])
    key = [*scope(pairs, shares), "junction_id", "leg_a", "leg_b"]
    t = shares.select(*key[:-2], "in_leg", "out_leg", "share")
    way = lambda x, y, n: t.withColumnsRenamed({"in_leg": f"leg_{x}", "out_leg": f"leg_{y}", "share": n})
    both = pairs.join(way("a", "b", "t1"), key, "left").join(way("b", "a", "t2"), key, "left")
    factor = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.coalesce("t1", F.lit(0.0)) * F.coalesce("t2", F.lit(0.0))))
    both = both.withColumn("factor", factor).where("factor > 0")
    return both.join(named(a, "a"), [*scope(pairs, a), "leg_a"]).join(named(b, "b"), [*own, "leg_b"])


def _crossing_n() -> Column:
    s, c = F.sin(F.radians("angle")), F.abs(F.cos(F.radians("angle")))
    wide = (F.col("sl_a") * F.col("s_b") + F.col("s_a") * F.col("sl_b")) * s + (F.col("sb_a") * F.col("s_b") + F.col("s_a") * F.col("sb_b")) * c
    return F.col("factor") * wide / (s * X.YEAR_S)


def crossing(cells: DataFrame, pairs: DataFrame, shares: DataFrame) -> DataFrame:
    """(kind, junction_id, leg_a, leg_b, n): candidates of two legs' traffic, times 1 - share(a to b) * share(b to a)."""
    m = moments(cells)
    return _pairs_of_moments(m, m, pairs, shares).select("kind", *scope(cells), "junction_id", "leg_a", "leg_b", _crossing_n().alias("n"))


def crossing_by_cell(cells: DataFrame, pairs: DataFrame, shares: DataFrame) -> DataFrame:
    """(kind, ship_type, size_bin, n): half of each crossing to each of its cells, without pairing cells."""
    key = ("cell",)
    turned = pairs.select(*[F.col({"leg_a": "leg_b", "leg_b": "leg_a"}.get(c, c)).alias(c) for c in pairs.columns])
    both = _pairs_of_moments(moments(cells, *key), moments(cells), pairs.unionByName(turned), shares)
    return both.groupBy("kind", *scope(cells), "cell_a.ship_type", "cell_a.size_bin").agg((F.sum(_crossing_n()) / 2).alias("n"))


def _bend_n(turn_deg: Column, q: Column, loa: Column, speed: float) -> Column:
    """Candidates of ships that do not turn with those that do, of one length and the beam that goes with it."""
    s, c = F.abs(F.sin(F.radians(turn_deg))), F.abs(F.cos(F.radians(turn_deg)))
    return NO_TURN * q * (1 - NO_TURN) * q * (2 * loa * s + 2 * loa / BEAM_SHARE * c) / (speed**2 * s * X.YEAR_S)


def _flows(cells: DataFrame) -> DataFrame:
    return ship_cells(cells).groupBy(*scope(cells), "leg_id").agg(F.sum("q").alias("q"), F.avg("loa").alias("loa"))


def bend(cells: DataFrame, shares: DataFrame, ends: DataFrame, least_deg: float = LEAST_TURN_DEG, speed: float = 1.0) -> DataFrame:
    """(kind, junction_id, leg_a, leg_b, n): ships of a leg that fail to turn into the next one, by its share.

    Counted at the junction at the leg's end only; ends: junctions with leg_id and side, shares with deflection.
    """
    own = scope(cells, shares, ends)
    at_end = ends.where("side = 'end'").select(*own, "junction_id", F.col("leg_id").alias("in_leg"))
    g = shares.where((F.col("deflection") > least_deg) & (F.col("share") > 0)).join(at_end, [*own, "junction_id", "in_leg"])
    g = g.join(_flows(cells).withColumnRenamed("leg_id", "in_leg"), [*scope(cells, shares), "in_leg"]).where(F.abs(F.sin(F.radians("deflection"))) > 1e-9)
    n = _bend_n(F.col("deflection"), F.col("q") * F.col("share"), F.col("loa"), speed)
    return g.select(F.lit("bend").alias("kind"), *scope(cells), "junction_id", F.col("in_leg").alias("leg_a"), F.col("out_leg").alias("leg_b"), n.alias("n"))


def static_bend(cells: DataFrame, legs: DataFrame, ends: DataFrame, least_deg: float = LEAST_TURN_DEG, speed: float = 1.0) -> DataFrame:
    """(kind, leg_a, n) of legs without a junction at their end, by their own bend_angle."""
    own = scope(cells, legs)
    alone = legs.where(F.col("bend_angle") > least_deg).join(ends.where("side = 'end'"), [*scope(legs, ends), "leg_id"], "left_anti")
    g = alone.join(_flows(cells), [*own, "leg_id"]).where(F.abs(F.sin(F.radians("bend_angle"))) > 1e-9)
    return g.select(F.lit("bend").alias("kind"), *own, F.col("leg_id").alias("leg_a"), _bend_n(F.col("bend_angle"), F.col("q"), F.col("loa"), speed).alias("n"))


def bend_by_cell(bends: DataFrame, cells: DataFrame) -> DataFrame:
    """(kind, ship_type, size_bin, n): each leg's bends to its cells by their share of its traffic."""
    own = scope(bends, cells)
    per_leg = bends.groupBy("kind", *own, F.col("leg_a").alias("leg_id")).agg(F.sum("n").alias("n"))
    c = cells.where("freq > 0").groupBy(*own, "leg_id", "ship_type", "size_bin").agg(F.sum("freq").alias("q"))
    c = c.withColumn("part", F.col("q") / F.sum("q").over(Window.partitionBy(*own, "leg_id")))
    return per_leg.join(c, [*own, "leg_id"]).groupBy("kind", *own, "ship_type", "size_bin").agg(F.sum(F.col("n") * F.col("part")).alias("n"))


def by_waypoint(contributions: DataFrame) -> DataFrame:
    """Sums by kind and junction."""
    return contributions.groupBy("kind", *scope(contributions), "junction_id").agg(F.sum("n").alias("n"))


def by_leg_pair(contributions: DataFrame) -> DataFrame:
    """Sums by kind and unordered pair of legs."""
    least, most = F.least("leg_a", "leg_b").alias("leg_1"), F.greatest("leg_a", "leg_b").alias("leg_2")
    return contributions.groupBy("kind", *scope(contributions), least, most).agg(F.sum("n").alias("n"))


def total(*contributions: DataFrame) -> DataFrame:
    """Sums by kind over all given tables of contributions (kind, n)."""
    rows = [c.select("kind", *scope(*contributions), "n") for c in contributions]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("kind", *scope(*contributions)).agg(F.sum("n").alias("n"))


def by_cell(pairs: DataFrame) -> DataFrame:
    """Half of each pair's value to each of its cells."""
    own = scope(pairs)
    halves = pairs.select("kind", *own, F.explode(F.array("cell1", "cell2")).alias("cell"), (F.col("n") / 2).alias("n"))
    return halves.groupBy("kind", *own, "cell.ship_type", "cell.size_bin").agg(F.sum("n").alias("n"))


def frequencies(contributions: DataFrame, causation: dict[str, float] = CAUSATION) -> DataFrame:
    """Candidates times the causation factor of their kind (merging as crossing)."""
    factor = F
    for k, v in causation.items():
        factor = factor.when(F.col("kind") == k, F.lit(v))
    return contributions.withColumn("frequency", F.col("n") * factor.when(F.col("kind") == "merging", F.lit(causation["crossing"])))
