"""Polygons and corridors against sampled points, hulls and hand-computed values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairway.operators import corridors as V
from fairway.operators import drifting as D
from fairway.operators import polygons as G
from fairway.operators import projection as U
from fairway.operators import repair as H

EDGE = "scenario_id long, obstacle_id long, part int, edge int, value_m double, hole boolean, a_x double, a_y double, b_x double, b_y double"


def edges_of(spark, polygons):
    """polygons: (scenario, id, depth, rings), a ring being corners in any order of turning; all but the first are holes."""
    rows = [(s, i, p, k, float(v), p > 0, *map(float, a), *map(float, b)) for s, i, v, rings in polygons for p, ring in enumerate(rings) for k, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1]))]
    return spark.createDataFrame(rows, EDGE)


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def inside(rings, x, y):
    odd = np.zeros(len(x), bool)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if ay != by:
                odd ^= ((ay > y) != (by > y)) & (x < ax + (y - ay) / (by - ay) * (bx - ax))
    return odd


def test_unions_of_slanted_polygons_cover_what_the_polygons_cover(spark):
    rng = np.random.default_rng(7)
    polygons = []
    for i in range(14):
        c, r, turn = rng.uniform(0, 600, 2), rng.uniform(40, 200), rng.uniform(0, 6)
        n = int(rng.integers(3, 8))
        ring = [tuple(c + r * rng.uniform(0.4, 1) * np.array([math.cos(turn + 2 * math.pi * k / n), math.sin(turn + 2 * math.pi * k / n)])) for k in range(n)]
        ring = [(round(x, 3), round(y, 3)) for x, y in ring]
        polygons.append((i % 2, i, float(i % 4 * 3), [ring[::-1] if i % 3 else ring]))
    polygons.append((0, 50, 3.0, [box(0, 0, 500, 500), box(100, 100, 400, 400)]))  # with a hole
    polygons.append((0, 51, 6.0, [box(500, 0, 700, 500)]))  # shares a side
    merged = G.merged_contours(edges_of(spark, polygons), 150.0).collect()
    x, y = rng.uniform(-250, 900, 4000), rng.uniform(-250, 900, 4000)
    for scenario in (0, 1):
        for b in sorted({v for s, _, v, _ in polygons if s == scenario}):
            want = np.zeros(4000, bool)
            for s, _, v, rings in polygons:
                if s == scenario and v <= b:
                    want |= inside(rings, x, y)
            got = np.zeros(4000, bool)
            for r in merged:
                if r.scenario_id == scenario and r.boundary_m == b and r.a_y != r.b_y:
                    got ^= ((r.a_y > y) != (r.b_y > y)) & (x < r.a_x + (y - r.a_y) / (r.b_y - r.a_y) * (r.b_x - r.a_x))
            assert (got == want).all()
    rows = [r for r in merged]
    ends = lambda a, b: sorted((r.scenario_id, r.boundary_m, r[a], r[b]) for r in rows)
    assert ends("a_x", "a_y") == ends("b_x", "b_y")  # every chain is closed


def test_rings_of_boxes_that_touch_overlap_and_nest(spark):
    boxes = [(3, box(0, 0, 10, 10)), (6, box(10, 0, 20, 10)), (3, box(5, 5, 15, 15)), (9, box(2, 2, 4, 4)), (0, box(100, 100, 110, 110)), (6, box(110, 110, 120, 120)), (3, box(0, 0, 10, 10)), (0, box(200, 200, 230, 230))]
    polygons = [(1, i, v, [b]) for i, (v, b) in enumerate(boxes)] + [(1, 9, 6.0, [box(190, 190, 240, 240), box(195, 195, 235, 235)])]
    table = G.ring_table(G.chained(G.merged_contours(edges_of(spark, polygons)))).collect()
    got = {b: sorted((round(r.area_m2, 6), round(r.length_m, 6)) for r in table if r.boundary_m == b) for b in (0.0, 3.0, 6.0, 9.0)}
    top = [(-1600.0, 160.0), (100.0, 40.0), (100.0, 40.0), (250.0, 70.0), (900.0, 120.0), (2500.0, 200.0)]
    assert got == {0.0: [(100.0, 40.0), (900.0, 120.0)], 3.0: [(100.0, 40.0), (175.0, 60.0), (900.0, 120.0)], 6.0: top, 9.0: top}


def test_merged_contours_of_nothing(spark):
    empty = edges_of(spark, [])
    assert G.merged_contours(empty).count() == 0 and G.chained(G.merged_contours(empty)).count() == 0


def test_many_copies_give_one_contour(spark):
    merged = G.merged_contours(edges_of(spark, [(0, i, 5.0, [box(0, 0, 10, 10)]) for i in range(300)]))
    assert merged.count() == 4 and merged.first().boundary_m == 5.0


# ---- corridors --------------------------------------------------------------------------------------------------


def band(spark, leg=(0.0, 0.0, 10_000.0, 0.0), mean=0.0, std=1.0, reach=5_000.0, spread=V.ENGINE_SPREAD, least=1.0):
    legs = spark.createDataFrame([(0, 1, *map(float, leg))], "scenario_id long, leg_id long, s_x double, s_y double, e_x double, e_y double")
    lateral = spark.createDataFrame([(0, 1, 0, float(mean), float(std))], "scenario_id long, leg_id long, dir_idx int, mean_m double, std_m double")
    return legs, lateral, spark.createDataFrame([(0, float(reach))], "scenario_id long, reach_m double")


def targets(spark, shapes):
    """shapes: (id, kind, value, corners)."""
    rows = [(0, i, kind, float(v), k, *map(float, a), *map(float, b)) for i, kind, v, ring in shapes for k, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1]))]
    return spark.createDataFrame(rows, "scenario_id long, obstacle_id long, kind string, value_m double, edge int, a_x double, a_y double, b_x double, b_y double")


def ships(spark, *rows):
    return spark.createDataFrame([(0, i, float(d), float(a), h) for i, (d, a, h) in enumerate(rows)], "scenario_id long, ship_id long, draught_m double, anchor_draughts double, height_m double")


def hull(points):
    """Monotone chain."""
    points = sorted(map(tuple, points))
    out = []
    for pts in (points, points[::-1]):
        side = []
        for p in pts:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) - (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]) <= 1e-9:
                side.pop()
            side.append(p)
        out += side[:-1]
    return np.array(out)


@pytest.mark.parametrize("leg", [(0, 0, 10_000, 0), (500, -300, 1700, 4100), (0, 0, -800, 300)])
def test_bands_are_the_hulls_of_the_widened_leg_and_its_shift(spark, leg):
    at = V.bands(*band(spark, leg, 120.0, 200.0), V.BAND_SPREAD)
    got = V.corners_of(at).toPandas()
    r = V.BAND_SPREAD * 200
    d = np.array([leg[2] - leg[0], leg[3] - leg[1]], float)
    n = np.array([-d[1], d[0]]) / np.hypot(*d)
    disc = r * np.c_[np.cos(np.arange(32) * math.pi / 16), np.sin(np.arange(32) * math.pi / 16)]
    ends = [np.array(leg[:2]) + 120 * n, np.array(leg[2:]) + 120 * n]
    for k in range(8):
        shift = 5000 * np.array([math.sin(k * math.pi / 4), math.cos(k * math.pi / 4)])
        want = hull(np.concatenate([p + disc + g for p in ends for g in (0 * shift, shift)]))
        mine = hull(got[got.direction == k].sort_values("place")[["x", "y"]].to_numpy())
        area = lambda p: ((p[:, 0] - p[0, 0]) * (np.roll(p[:, 1], -1) - p[0, 1]) - (np.roll(p[:, 0], -1) - p[0, 0]) * (p[:, 1] - p[0, 1])).sum() / 2
        assert area(mine) == pytest.approx(area(want), rel=1e-9)
        ways = np.c_[np.cos(np.arange(0, 6.3, 0.01)), np.sin(np.arange(0, 6.3, 0.01))]
        assert (mine @ ways.T).max(axis=0) == pytest.approx((want @ ways.T).max(axis=0), abs=1e-5)


def test_target_hits_of_an_east_leg_that_drifts_north(spark):
    shapes = [(1, "depth", 8.0, box(4000, 400, 6000, 600)), (2, "depth", 15.0, box(4000, 50, 4100, 60)), (3, "object", 25.0, box(0, 300, 100, 350)), (4, "depth", 5.0, box(4000, -700, 4100, -600)), (5, "depth", 5.0, box(-90_000, -90_000, 90_000, 90_000)), (6, "depth", 5.0, box(0, 9_000, 10, 9_010))]
    hits = V.target_hits(*band(spark), targets(spark, shapes), ships(spark, (10, 2, None), (10, 2, 30.0), (10, 2, 10.0), (1, 2, 10.0)))
    north = {(r.ship_id, r.role, r.obstacle_id): (round(r.distance_m, 3), round(r.coverage_percent, 3)) for r in hits.where("direction = 0").collect()}
    one = {(0, "grounding", 1): (400.0, 44.0), (0, "anchoring", 1): (400.0, 44.0), (0, "anchoring", 2): (50.0, 2.2), (0, "structure", 3): (300.0, 3.0), (0, "grounding", 5): (80_000.0, 0.0), (0, "anchoring", 5): (80_000.0, 0.0)}
    assert north.pop((0, "grounding", 5))[1] == north.pop((0, "anchoring", 5))[1] == 0.0  # holds the whole corridor
    assert {k: v for k, v in north.items() if k[0] == 0} == {k: v for k, v in one.items() if k[2] != 5}
    assert (1, "structure", 3) in north and (2, "structure", 3) not in north and not any(k[0] == 3 for k in north)
    assert not any(k[2] in (4, 6) for k in north)  # behind the leg, and out of reach


def test_corridor_widths_and_distances_by_hand(spark):
    at = V.bands(*band(spark), V.ENGINE_SPREAD, 1.0)
    width = {r.direction: r.w for r in at.select("direction", F.expr(V.WIDTH).alias("w")).collect()}
    assert width[2] == pytest.approx(6.0) and width[0] == pytest.approx(10_000.0)
    distance = lambda x, y, d: at.where(f"direction = {d}").select(F.expr(V.distance_text(f"{float(x)}D", f"{float(y)}D")).alias("d")).first().d
    assert distance(5000, 500, 0) == pytest.approx(500.0) and distance(5000, -500, 0) is None
    assert distance(12_000, 0, 2) == pytest.approx(2000.0)  # along the leg, past its end
    assert distance(5000, 0, 2) == pytest.approx(0.0)
    assert distance(-3000, 0, 2) is None
    assert distance(12_000, 300, 0) == pytest.approx(300.0)  # beside the leg: from its nearest point


def test_lengths_in_the_two_rectangles(spark):
    """Where they overlap the notch between them is outside; where they don't, the hull is inside."""
    shapes = [(1, "depth", 1.0, box(1000, -5000, 1001, 9000)), (2, "depth", 1.0, box(9_000, 3000, 30_000, 3001))]
    e = targets(spark, shapes)
    far = V.corridor_lengths(V.bands(*band(spark, std=100.0, reach=5000.0), 5.0), e)
    got = {(r.direction, r.obstacle_id): r.m for r in far.groupBy("direction", "obstacle_id").agg(F.sum("inside_m").alias("m")).collect()}
    assert got[0, 1] == pytest.approx(2 * 6000.0)  # from -500 to 5500 up either long side
    assert got[0, 2] == pytest.approx(2 * 1000 + 1.0)  # to the leg's end, and the near side
    near = V.corridor_lengths(V.bands(*band(spark, std=100.0, reach=800.0), 5.0), e)
    diagonal = near.where("direction = 1 and obstacle_id = 1").agg(F.sum("inside_m")).first()[0]
    shift = 800 * math.sqrt(0.5)
    assert diagonal == pytest.approx(2 * (500 + shift + 500), abs=2.0)  # both rectangles, what lies in both once


def test_fans_stop_at_obstacles_and_know_where_ships_can_anchor(spark):
    at = V.bands(*band(spark, std=100.0), 1.0)
    stop = targets(spark, [(1, "object", 1.0, box(2000, 1100, 4000, 1200)), (2, "object", 1.0, box(6000, -50, 7000, 50))])
    anchor = targets(spark, [(3, "depth", 1.0, box(0, 600, 5000, 3000))])
    got = {r.direction: r for r in V.fan_areas(V.fans(at, stop, anchor, 1000)).collect()}[0]
    whole = 10_000 * (200 + 5000)
    lost = 2000 * (5100 - 1100) + 1000 * (5100 - -50)
    assert got.area_m2 == pytest.approx(whole - lost, rel=1e-3) and got.blocked == pytest.approx(lost / whole, rel=1e-3)
    assert got.anchorable_m2 == pytest.approx(5000 * (5100 - 600) - 2000 * (5100 - 1100), rel=1e-3)
    inside = V.fan_areas(V.fans(at, targets(spark, [(1, "object", 1.0, box(-50_000, -50_000, 50_000, 50_000))]), anchor, 50)).where("direction = 0").first()
    assert inside.area_m2 == 0 and inside.blocked == 1


def test_weighted_coverage_of_a_box_by_hand(spark):
    """The box lies in the band that drifts north: its four corners count at their distances from the middle line."""
    at = V.bands(*band(spark, (0, 0, 1000, 0), 0.0, 200.0, 4000.0), V.BAND_SPREAD).where("direction = 0")
    mixture = spark.createDataFrame([(0, 1, 0, "normal", 0.0, 200.0, 3.0), (0, 1, 0, "uniform", 0.0, 500.0, 1.0)], "scenario_id long, leg_id long, dir_idx int, kind string, p1 double, p2 double, weight double")
    r = V.weighted_coverage(at, targets(spark, [(1, "depth", 1.0, box(600, 1900, 800, 2100))]), mixture).first()
    pdf = lambda d: 0.75 * math.exp(-((d / 200) ** 2) / 2) / (200 * math.sqrt(2 * math.pi)) + (0.25 / 500 if d <= 500 else 0)
    assert r.corners == 4 and r.nearest_m == pytest.approx(math.hypot(100, 100))
    assert r.coverage == pytest.approx(100 * (2 * pdf(math.hypot(100, 100)) + 2 * pdf(math.hypot(300, 100))))


def test_exposure_of_edges(spark):
    e = spark.createDataFrame([(0.0, 0.0, 10.0, 0.0)], "a_x double, a_y double, b_x double, b_y double")  # the lower side of a polygon: its normal is south
    value = lambda d: e.select(V.exposure(F.lit(float(d)), F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y")).alias("x")).first().x
    assert value(0) == pytest.approx(1.0) and value(180) == 0 and value(45) == pytest.approx(math.sqrt(0.5)) and value(90) == pytest.approx(0, abs=1e-12)


def test_metres_of_the_zone_and_back(spark):
    places = spark.createDataFrame([(1, 15.0, 55.0), (1, 15.3, 55.2), (2, -70.0, -33.0), (2, -70.9, -33.3)], "scenario_id long, lon double, lat double")
    zones = U.zones(places)
    assert {(r.scenario_id, r.zone, r.south) for r in zones.collect()} == {(1, 33, False), (2, 19, True)}
    there = U.to_metres(places, zones, p=("lon", "lat"))
    # On the central meridian the northing is the scaled arc of the meridian.
    e2 = U.FLATTENING * (2 - U.FLATTENING)
    phi = np.radians(np.linspace(0, 55, 200_001))
    arc = np.trapezoid(U.AXIS_M * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5, phi)
    first = there.where("lon = 15").first()
    assert first.p_x == pytest.approx(500_000.0, abs=1e-6) and first.p_y == pytest.approx(0.9996 * arc, abs=1e-4)
    for r in U.to_degrees(there, zones, q=("p_x", "p_y")).collect():
        assert (r.q_lon, r.q_lat) == pytest.approx((r.lon, r.lat), abs=1e-10)


def test_repair_formulas_are_worked_out_or_refused(spark):
    good = {"1 - exp(-1.05 *x ** 0.9)": 1 - math.exp(-1.05 * 2**0.9), "np.sqrt(x) / pi": math.sqrt(2) / math.pi, "norm.cdf(x - 2)": 0.5, "(x >= 1 and x < 3) * 1": 1.0, "-x // 3 + 7 % 4": 2.0, "abs(-x) * log(x) + sin(0) * cos(x)": 2 * math.log(2)}
    bad = ["__import__('os')", "x.real", "open(x)", "y + 1", "lambda: x", "exp(x, 1)", "[x]", "x if x else 1", "exp(*x)", "", "1 +", "'a'", None, "x" * 600, "np.random.rand(1)"]
    rows = spark.createDataFrame([(i, t, 2.0) for i, t in enumerate([*good, *bad])], "scenario_id long, repair_text string, hours double")
    got = {r.scenario_id: r.p_repaired for r in H.repaired(rows).collect()}
    for i, v in enumerate(good.values()):
        assert got[i] == pytest.approx(v)
    assert all(got[i] is None for i in range(len(good), len(good) + len(bad)))
    assert {r.scenario_id for r in H.findings(rows).collect()} == set(range(len(good), len(good) + len(bad)))
    both = spark.range(1).select(F.lit(2.0).alias("x")).select(*[F.expr(H.sql_of(t)).alias(f"v{i}") for i, t in enumerate(good)]).first()
    assert list(both) == pytest.approx(list(good.values()))
    one = spark.range(1).select(F.lit(2.0).alias("x")).select(F.expr(H.sql_of("1 - exp(-1.05 *x ** 0.9)")).alias("v")).first().v
    assert one == pytest.approx(good["1 - exp(-1.05 *x ** 0.9)"])


def test_projection_distance():
    assert D.projection_m() == pytest.approx((0.2 + 0.85 * math.exp(0.95 * 3.090232306167813)) * 1852)
    assert D.projection_m(kind="normal") == D.projection_m(shape=0.0) == D.projection_m(scale=500.0) == 10_000.0
    assert D.projection_m(drift_ms=5.0) == 50_000.0 and D.projection_m(kind="weibull", most_m=3000.0) == 3000.0


def test_copies_of_a_shape_share_what_is_found_for_it(spark):
    """Every copy has its row, of all that bands, edges or rays are paired with there is one."""
    at = V.bands(*band(spark, (0, 0, 1000, 0), 0.0, 200.0, 4000.0), V.BAND_SPREAD).where("direction = 0")
    e = targets(spark, [(k, "depth", float(k % 3), box(600, 1900, 800, 2100)) for k in range(5, 45)] + [(99, "object", 1.0, box(100, 900, 200, 1000))])
    own, copies = G.shapes(e)
    assert {r.obstacle_id for r in own.collect()} == {5, 99} and copies.count() == 41
    assert {r.obstacle_id for r in G.shapes(e, "value_m")[0].collect()} == {5, 6, 7, 99}
    got = {r.obstacle_id: r.inside_m for r in V.overlaps(at, e).collect()}
    assert set(got) == {*range(5, 45), 99} and {round(got[k], 6) for k in range(5, 45)} == {800.0}
    mixture = spark.createDataFrame([(0, 1, 0, "normal", 0.0, 200.0, 1.0)], "scenario_id long, leg_id long, dir_idx int, kind string, p1 double, p2 double, weight double")
    assert {r.obstacle_id for r in V.weighted_coverage(at, e, mixture).collect()} == {*range(5, 45), 99}
    hits = V.target_hits(*band(spark, (0, 0, 1000, 0), 0.0, 200.0, 4000.0), e, ships(spark, (1, 2, None))).where("direction = 0 and role = 'structure'")
    assert [r.obstacle_id for r in hits.collect()] == [99]
