"""The drifting cascade against a brute force over all rays and edges, and hand-computed values of the other models."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairway.operators import cascade as K
from fairway.operators import collision as C
from fairway.operators import consequence as O
from fairway.operators import drifting as D
from fairway.operators import network as N

LEG = "scenario_id long, leg_id long, s_x double, s_y double, e_x double, e_y double, length_m double"
LATERAL = "scenario_id long, leg_id long, dir_idx int, mean_m double, std_m double"
EDGE = "scenario_id long, obstacle_id long, kind string, value_m double, edge int, a_x double, a_y double, b_x double, b_y double"
CELL = "scenario_id long, leg_id long, dir_idx int, ship_type int, size_bin int, freq double, speed_kn double, draught_m double, height_m double"


def phi(x):
    return 0.5 * math.erfc(-x / math.sqrt(2))


def box(scenario, i, kind, value, x0, y0, x1, y1):
    ends = [(x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)]
    return [(scenario, i, kind, value, k, *map(float, e)) for k, e in enumerate(ends)]


def tables(spark, boxes, scenarios=(7,), leg=(0.0, 0.0, 10_000.0, 0.0), draughts=(6.0, 13.0)):
    legs = [(s, 1, *leg, math.hypot(leg[2] - leg[0], leg[3] - leg[1])) for s in scenarios]
    lateral = [(s, 1, d, 100.0 * (1 - 2 * d), 200.0) for s in scenarios for d in (0, 1)]
    edges = [e for s in scenarios for i, b in enumerate(boxes) for e in box(s, i, *b)]
    cells = [(s, 1, d, 18, k, 100.0 * (s - scenarios[0] + 1), 10.0, t, 20.0) for s in scenarios for d in (0, 1) for k, t in enumerate(draughts)]
    rose = [(s, d, 0.125) for s in scenarios for d in range(8)]
    make = spark.createDataFrame
    return {
        "cells": make(cells, CELL), "legs": make(legs, LEG), "lateral": make(lateral, LATERAL), "edges": make(edges, EDGE), "rose": make(rose, "scenario_id long, direction int, rp double"),
        "rates": make([], "ship_type int, rate double"), "reach": make([(s, 20_000.0) for s in scenarios], "scenario_id long, reach_m double"),
    }


BOXES = [("object", 10.0, 3000, 1500, 4200, 2500), ("depth", 5.0, 2500, 4000, 6000, 6000), ("depth", 12.0, 5000, 1200, 8000, 3000), ("depth", 40.0, -500, 2000, 2000, 9000), ("object", 5.0, 9000, -3000, 9900, -900)]


def brute(boxes, slices, rays, reach, leg=(0.0, 0.0, 10_000.0, 0.0)):
    """(dir, direction, obstacle, slice, ray): (mass, enter, exit) with each ray held against each edge."""
    out = {}
    sx, sy, ex, ey = leg
    n = math.hypot(ex - sx, ey - sy)
    nx, ny = -(ey - sy) / n, (ex - sx) / n
    for dir_idx, mean in ((0, 100.0), (1, -100.0)):
        for d in range(8):
            gx, gy = math.sin(math.radians(45 * d)), math.cos(math.radians(45 * d))
            for sl in range(slices):
                f = (sl + 0.5) / slices
                for r in range(rays):
                    step = 2 * 5 * 200.0 / rays
                    w = mean - 1000 + (r + 0.5) * step
                    mass = (phi((w + step / 2 - mean) / 200) - phi((w - step / 2 - mean) / 200)) / slices
                    px, py = sx + f * (ex - sx) + w * nx, sy + f * (ey - sy) + w * ny
                    for i, (kind, value, x0, y0, x1, y1) in enumerate(boxes):
                        ts = []
                        for _, _, _, _, _, ax, ay, bx, by in box(0, i, kind, value, x0, y0, x1, y1):
                            ca, cb = gx * (ay - py) - gy * (ax - px), gx * (by - py) - gy * (bx - px)
                            if min(ca, cb) <= 0 < max(ca, cb):
                                xa, xb = (ax - px) * gx + (ay - py) * gy, (bx - px) * gx + (by - py) * gy
                                t = xa + (0 - ca) / (cb - ca) * (xb - xa)
                                if 0 <= t <= reach:
                                    ts.append(t)
                        if ts:
                            out[dir_idx, d, i, sl, r] = mass, min(ts), max(ts)
    return out


def test_rays_and_cascade_against_brute_force(spark):
    slices, rays, reach = 4, 20, 20_000.0
    t = tables(spark, BOXES)
    facing = K.facing_edges(K.frames(t["legs"], t["lateral"]).join(t["reach"], "scenario_id"), t["edges"])
    hits = K.ray_hits(facing, slices, rays)
    want = brute(BOXES, slices, rays, reach)
    got = {(r.dir_idx, r.direction, r.obstacle_id, r.slice, r.ray): (r.mass, r.enter_m, r.exit_m) for r in hits.collect()}
    odd = set(got) ^ set(want)  # rays along an edge or through a corner
    assert len(want) > 600 and len(odd) <= 0.01 * len(want)
    for k in set(got) & set(want):
        assert got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-4)

    far, plain = defaultdict(lambda: math.inf), defaultdict(float)
    for (dir_idx, d, i, _, _), (mass, enter, _) in got.items():
        far[dir_idx, d, i] = min(far[dir_idx, d, i], enter)
        plain[dir_idx, d, i] += mass
    exposure = K.with_buckets(t["cells"], t["edges"].where("kind = 'depth'").select("scenario_id", "value_m"), 3.0)
    buckets = {(r.ground_m, r.anchor_m) for r in exposure.collect()}
    assert buckets == {(5.0, 12.0), (12.0, 12.0)}
    reached = K.reached(hits, exposure.select(*K.LEG, "ground_m", "anchor_m").distinct()).collect()
    rays_of = defaultdict(dict)
    for (dir_idx, d, i, sl, r), v in got.items():
        rays_of[dir_idx, d, sl, r][i] = v
    sums = defaultdict(lambda: [0.0, 0.0])
    for ground, anchor in buckets:
        for (dir_idx, d, _, _), on in rays_of.items():
            rows = []
            for i in on:
                kind, value = BOXES[i][:2]
                if kind == "object":
                    rows.append((far[dir_idx, d, i], 0, i, 0, "allision"))
                else:
                    rows += [(far[dir_idx, d, i], 1, i, 1, "anchoring")] * (value <= anchor) + [(far[dir_idx, d, i], 1, i, 2, "grounding")] * (value <= ground)
            blocked = anchors = math.inf
            for _, _, i, _, accident in sorted(rows):
                mass, enter, leave = on[i]
                free = enter < blocked
                cell = sums[dir_idx, d, ground, anchor, i, accident]
                cell[0] += mass * free
                cell[1] += mass * (free and accident != "anchoring" and anchors <= min(leave, blocked))
                if accident == "anchoring":
                    anchors = min(anchors, enter)
                else:
                    blocked = min(blocked, enter)
    assert len(reached) == len(sums)
    for r in reached:
        h_reach, h_anchor = sums[r.dir_idx, r.direction, r.ground_m, r.anchor_m, r.obstacle_id, r.accident]
        assert (r.h_reach, r.h_in_anchor) == pytest.approx((h_reach, h_anchor), abs=1e-9)
        assert r.hole == pytest.approx(plain[r.dir_idx, r.direction, r.obstacle_id]) and r.distance_m == pytest.approx(far[r.dir_idx, r.direction, r.obstacle_id])


def test_exact_holes_agree_with_rays(spark):
    t = tables(spark, BOXES)
    facing = K.facing_edges(K.frames(t["legs"], t["lateral"]).join(t["reach"], "scenario_id"), t["edges"])
    exact = {(r.dir_idx, r.direction, r.obstacle_id): r.hole for r in D.holes(D.edge_intervals(facing, 10), 10).collect()}
    rays = {(r.dir_idx, r.direction, r.obstacle_id): r.hole for r in K.plain_holes(K.ray_hits(facing, 10, 200)).collect()}
    assert len(rays) > 20
    for k, v in rays.items():
        assert v == pytest.approx(exact.get(k, 0.0), abs=5e-3)


def test_a_shadowed_obstacle_is_not_reached(spark):
    # North of the leg a wide shoal hides an object; south of it nothing stands.
    t = tables(spark, [("depth", 4.0, -60_000, 2000, 60_000, 2500), ("object", 5.0, 4000, 6000, 6000, 7000)])
    facts = K.cascade(**t, slices=4, rays=20, anchor_share=0.0)
    assert {r.accident for r in facts.select("accident").distinct().collect()} == {"grounding"}


def test_minimal_project(spark):
    """One leg eastwards, a contour of 12 m and an object of 20 m north of it, one ship type."""
    boxes = [("depth", 12.0, 5090, 2212, 6360, 3317), ("object", 20.0, 5720, 884, 6360, 1327)]
    repair = {"kind": "normal", "shape": 1.0, "loc": 0.0, "scale": 1.0}

    def run(share, scenarios=(7,)):
        t = tables(spark, boxes, scenarios, draughts=(13.0,))
        facts = K.cascade(**t, anchor_share=share, drift_kn=1.94, slices=5, rays=30, **repair)
        return {(r.scenario_id, r.accident): r.f for r in facts.groupBy("scenario_id", "accident").agg(F.sum("frequency").alias("f")).collect()}, facts

    without, _ = run(0.0)
    with_, facts = run(0.7, (7, 8))
    for kind in ("allision", "grounding"):
        assert 0 < with_[7, kind] < 1
        assert with_[8, kind] == pytest.approx(2 * with_[7, kind])  # twice the traffic
    assert with_[7, "grounding"] < without[7, "grounding"] and with_[7, "anchoring"] > 0
    by_leg = K.rolled_up(facts, "leg_id", "dir_idx", "direction").groupBy("scenario_id", "accident").agg(F.sum("frequency").alias("f")).collect()
    assert {(r.scenario_id, r.accident): r.f for r in by_leg} == pytest.approx(with_)
    hours = {r.scenario_id: r.ship_hours for r in K.exposed_hours(facts).collect()}
    assert hours[8] == pytest.approx(2 * hours[7])
    halved = K.cascade(**tables(spark, boxes, (7,), draughts=(13.0,)), drift_kn=1.94, slices=5, rays=30, factors={"allision": 0.5}, **repair)
    assert halved.where("accident = 'allision'").agg(F.sum("frequency")).first()[0] == pytest.approx(with_[7, "allision"] / 2)


def test_nothing_to_hit_gives_no_rows(spark):
    t = tables(spark, [])
    assert K.cascade(**t).count() == 0


def test_edge_shares_of_a_box_ahead(spark):
    t = tables(spark, [("object", 5.0, 4000, 3000, 6000, 5000)])
    facing = K.facing_edges(K.frames(t["legs"], t["lateral"]).join(t["reach"], "scenario_id"), t["edges"])
    shares = {(r.direction, r.edge): (r.share, r.edge_m) for r in K.edge_shares(facing).where("dir_idx = 0").collect()}
    assert shares[0, 0] == pytest.approx((1.0, 3000.0))  # northwards only the southern edge faces the drift
    assert {e for d, e in shares if d == 1} == {0, 3}  # to the north-east the southern and the western one


def test_small_formulas(spark):
    one = spark.range(1)
    knots = one.select(D.squat_m(F.lit(10.0)).alias("a"), D.squat_m(F.lit(10.0), F.lit(0.8)).alias("b"), D.squat_m(F.lit(0.0)).alias("c")).first()
    assert tuple(knots) == (0.75, 0.8, 0.0)
    assert D.reach_m(5000.0, drift_kn=0.0) == 50_000.0 and D.reach_m(1e9, "normal") == 1e10
    assert D.reach_m(1e9, "weibull", 1.0, 0.0, 1.0, 1.0) == pytest.approx(1852 * math.log(100))
    f = one.select(K.exposure_factor(F.lit(0.0), F.lit(180.0)).alias("a"), K.exposure_factor(F.lit(60.0), F.lit(180.0)).alias("b"), K.exposure_factor(F.lit(0.0), F.lit(0.0)).alias("c")).first()
    assert tuple(f) == pytest.approx((1.0, 0.5, 0.0))


def test_crossings_without_shares_all_count(spark):
    cells = spark.createDataFrame([(leg, 0, 1, 3, 100.0, 10.0, 15.0) for leg in (1, 2, 3)], "leg_id long, dir_idx int, ship_type int, size_bin int, freq double, speed_kn double, beam_m double")
    pairs = spark.createDataFrame([("j", 1, 2, 90.0, "crossing"), ("j", 1, 3, 90.0, "crossing"), ("j", 2, 3, 90.0, "crossing")], "junction_id string, leg_a long, leg_b long, angle double, kind string")
    shares = spark.createDataFrame([("j", 1, 2, 0.5), ("j", 2, 1, 0.4), ("j", 1, 3, 0.5), ("j", 2, 3, 1.0), ("j", 3, 2, 1.0)], "junction_id string, in_leg long, out_leg long, share double")
    got = {(r.leg_a, r.leg_b): r.n for r in C.crossing(cells, pairs, shares).collect()}
    v, loa = 10 * 1852 / 3600, 87.5
    whole = 100 * 100 * (2 * loa) / (v * v * 365.25 * 86400)
    assert got == {(1, 2): pytest.approx(whole * 0.8), (1, 3): pytest.approx(whole)}  # all of 2 and 3 turn into each other
    by_cell = C.crossing_by_cell(cells, pairs, shares).collect()
    assert sum(r.n for r in by_cell) == pytest.approx(whole * 1.8)


def test_bends_count_at_the_end_of_a_leg_with_the_beam_of_its_length(spark):
    legs = spark.createDataFrame([(1, 0.0, 0.0, 0.1, 0.0), (2, 0.1, 0.0, 0.1, 0.1)], "leg_id long, lon1 double, lat1 double, lon2 double, lat2 double")
    cells = spark.createDataFrame([(leg, 0, 1, 3, 100.0, 10.0, 99.0) for leg in (1, 2)], "leg_id long, dir_idx int, ship_type int, size_bin int, freq double, speed_kn double, beam_m double")
    ends = N.junctions(legs)
    got = C.bend(cells, N.geometric_shares(ends), ends).collect()
    loa = 87.5
    want = 0.01 * 100 * 0.99 * 100 * 2 * loa / (365.25 * 86400)  # a turn of 90 degrees
    assert [(r.leg_a, r.leg_b) for r in got] == [(1, 2)] and got[0].n == pytest.approx(want)
    alone = C.static_bend(cells, legs.withColumn("bend_angle", F.lit(90.0)), ends).collect()
    assert [(r.leg_a, r.n) for r in alone] == [(2, pytest.approx(want))]


def test_spills_of_all_kinds(spark):
    kinds = [*O.KINDS, "unheard_of"]
    accidents = spark.createDataFrame([(k, 19, 3, 1.0) for k in kinds], "kind string, ship_type int, size_bin int, frequency double")
    oil = O.default_oil(spark.createDataFrame([(19, 3)], "ship_type int, size_bin int"), F.lit(True))
    matrix = O.default_matrix(spark)
    rows = O.spills(accidents, oil, matrix).collect()
    by = defaultdict(dict)
    for r in rows:
        by[r.kind][r.level] = r.frequency, r.volume_m3
    v = 80 * 87.5
    for k in O.KINDS:
        want = {0: (0.98, 0.0), 1: (0.02, v / 10)} if k.startswith("drifting") else {0: (0.97, 0.0), 1: (0.01, v / 10), 2: (0.01, v * 0.3), 3: (0.01, v)}
        assert by[k] == {i: pytest.approx(w) for i, w in want.items()}
    assert [tuple(r) for r in O.unknown_kinds(accidents, matrix).collect()] == [("unheard_of", 1.0)]
    over = {r.name: r.frequency for r in O.exceedance(O.spills(accidents, oil, matrix)).collect()}
    assert over == {"Minor": pytest.approx(2 * 0.02 + 6 * 0.03), "Major": pytest.approx(2 * 0.02 + 6 * 0.03), "Catastrophic": pytest.approx(6 * 0.01)}


def test_consequence_findings(spark):
    matrix = spark.createDataFrame([("a", 0, 60.0, 0.0), ("a", 1, 30.0, 120.0), ("b", 0, 101.0, 0.0), ("b", 1, -1.0, 5.0), ("b", 1, 0.0, 5.0)], "kind string, level int, percent double, lost_percent double")
    levels = spark.createDataFrame([("x", 0.0)], "name string, quantity_m3 double")
    oil = spark.createDataFrame([(1, 2, -1.0), (1, 3, 5.0)], "ship_type int, size_bin int, oil_m3 double")
    got = sorted((r.check, str(r.kind), str(r.level)) for r in O.findings(matrix, levels, oil).collect())
    assert got == sorted([("row_sum", "a", "None"), ("range", "b", "0"), ("range", "b", "1"), ("duplicate", "b", "1"), ("lost_range", "a", "1"), ("few_levels", "None", "None"), ("quantity", "x", "None"), ("oil", "1", "2")])
    length = spark.createDataFrame([(0.0, "25"), (100.0, "inf"), (200.0, "250+")], "lo double, hi string").select(O.interval_length(F.col("lo"), F.col("hi")).alias("m"))
    assert [r.m for r in length.collect()] == [12.5, 150.0, 250.0]
