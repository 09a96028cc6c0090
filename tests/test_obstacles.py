"""Rays and drift corridors against crosses of all legs and edges."""

import numpy as np
from pyspark.sql import functions as F

from fairway.operators import cascade as K
from fairway.operators import drifting as D
from fairway.operators import powered as W
from fairway.plans import registry

SF = "/root/testdata/sf0.001"


def edges_of(spark, boxes):
    rows = [(i, kind, v, a, b, c, d) for i, (kind, v, x0, y0, x1, y1) in enumerate(boxes) for a, b, c, d in ((x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0))]
    return spark.createDataFrame(rows, "obstacle_id long, kind string, value_m double, a_x double, a_y double, b_x double, b_y double")


def random_boxes(n):
    rng = np.random.default_rng(3)
    at, size = rng.uniform(-45_000, 45_000, (n, 2)), rng.uniform(50, 9_000, (n, 2))
    return [("depth", 5.0, *map(float, (*a, *(a + s)))) for a, s in zip(at, size)]


def crossed(legs, edges, length_m):
    return legs.crossJoin(edges)


def test_grid_cells_lose_no_pair_of_leg_and_edge(spark, monkeypatch):
    angles = np.radians([0, 17, 90, 133, 251])
    points = spark.createDataFrame([(i, 0, 700.0 * i, -900.0 * i, float(np.cos(t)), float(np.sin(t)), float(-np.sin(t)), float(np.cos(t)), 300.0, 800.0, 10.0) for i, t in enumerate(angles)], "leg_id long, dir_idx int, tx double, ty double, dx double, dy double, nx double, ny double, mean_m double, std_m double, speed_kn double")
    edges = edges_of(spark, random_boxes(60))
    hits = lambda: sorted(tuple(r) for r in W.ray_hits(points, edges).select("leg_id", "ray", "obstacle_id", F.round("along_m", 4)).collect())
    got = hits()
    plan = W.ray_hits(points, edges)._jdf.queryExecution().optimizedPlan().toString()
    assert "cell_x" in plan and "Join Cross" not in plan
    monkeypatch.setattr(W, "near", crossed)
    assert len(got) > 1000 and got == hits()


def test_grid_cells_lose_no_edge_that_drift_carries_to(spark):
    angles = np.radians([0, 17, 90, 133, 251])
    legs = spark.createDataFrame([(1, i, 0.0, 0.0, float(9000 * np.cos(t)), float(9000 * np.sin(t))) for i, t in enumerate(angles)], "scenario_id long, leg_id long, s_x double, s_y double, e_x double, e_y double")
    lateral = spark.createDataFrame([(1, i, 0, 300.0, 800.0) for i in range(5)], "scenario_id long, leg_id long, dir_idx int, mean_m double, std_m double")
    edges = edges_of(spark, random_boxes(60)).withColumn("scenario_id", F.lit(1).cast("long")).withColumn("edge", F.monotonically_increasing_id())
    at = K.frames(legs, lateral).withColumn("reach_m", F.lit(30_000.0))
    holes = lambda facing: {(r.leg_id, r.direction, r.obstacle_id): round(r.hole, 9) for r in D.holes(D.edge_intervals(facing, 3), 3).collect()}
    facing = K.facing_edges(at, edges)
    assert "Join Cross" not in facing._jdf.queryExecution().optimizedPlan().toString()
    every = at.join(edges.drop("scenario_id"))
    for p in "ab":
        every = every.withColumn(f"x{p}", F.expr(f"({p}_x - s_x) * ex + ({p}_y - s_y) * ey")).withColumn(f"c{p}", F.expr(f"ex * ({p}_y - s_y) - ey * ({p}_x - s_x)"))
    got, want = holes(facing), holes(every)
    assert len(want) > 150 and got == want


def test_queries_of_obstacles_read_all_of_part(spark):
    for name in ("pow_summaries", "drf_holes", "pow_accidents", "drf_cascade_objects"):
        assert registry.QUERIES[name](spark, SF).where("obstacle_id > 60").count() > 0


def test_each_ship_meets_the_first_obstacle_of_its_own_kind_and_depth(spark):
    points = spark.createDataFrame([(1, 0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 100.0, 10.0)], "leg_id long, dir_idx int, tx double, ty double, dx double, dy double, nx double, ny double, mean_m double, std_m double, speed_kn double")
    # From the leg's end on: an object, a deep contour, a shoal, another object.
    boxes = [("object", 20.0, 1000.0), ("depth", 12.0, 2000.0), ("depth", 4.0, 3000.0), ("object", 5.0, 4000.0)]
    edges = edges_of(spark, [(k, v, x, -500.0, x + 100.0, 500.0) for k, v, x in boxes])
    cells = spark.createDataFrame([(1, 0, 1, s, 100.0, 10.0, d, h) for s, (d, h) in enumerate([(3.0, 10.0), (6.0, 10.0), (13.0, 30.0)])], "leg_id long, dir_idx int, ship_type int, size_bin int, freq double, speed_kn double, draught_m double, height_m double")
    depths = edges.where("kind = 'depth'").select("value_m")
    got = {(r.accident, r.size_bin, r.obstacle_id): r.frequency for r in W.accidents(cells, W.ray_hits(points, edges), points, depths, {"grounding": 1.6e-4, "allision": 1.9e-4}).collect()}
    assert set(got) == {("grounding", 1, 2), ("grounding", 2, 1), ("allision", 2, 0)}
    for (kind, _, obstacle), value in got.items():
        want = {"grounding": 1.6e-4, "allision": 1.9e-4}[kind] * 100 * np.exp(-boxes[obstacle][2] / (180 * 10 * 1852 / 3600))
        assert abs(value / want - 1) < 1e-3


def test_scenarios_meet_their_own_charts_alone(spark):
    row = "leg_id long, dir_idx int, tx double, ty double, dx double, dy double, nx double, ny double, mean_m double, std_m double, speed_kn double, scenario_id long"
    point = (1, 0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 100.0, 10.0)
    points = spark.createDataFrame([(*point, 1), (*point, 2), (*point, 3)], row)
    chart = lambda k, boxes: edges_of(spark, [(kind, v, x, -500.0, x + 100.0, 500.0) for kind, v, x in boxes]).withColumn("scenario_id", F.lit(k).cast("long"))
    edges = chart(1, [("depth", 4.0, 1000.0), ("object", 5.0, 4000.0)]).unionByName(chart(2, [("depth", 12.0, 2000.0), ("depth", 4.0, 3000.0)]))
    cell = "scenario_id long, leg_id long, dir_idx int, ship_type int, size_bin int, freq double, speed_kn double, draught_m double, height_m double"
    cells = spark.createDataFrame([(k, 1, 0, 1, 0, 100.0, 10.0, 6.0, 30.0) for k in (1, 2, 3)], cell)
    depths = edges.where("kind = 'depth'").select("scenario_id", "value_m")
    factors = {"grounding": 1.6e-4, "allision": 1.9e-4}
    together = W.accidents(cells, W.ray_hits(points, edges), points, depths, factors)
    got = {(r.scenario_id, r.accident, r.obstacle_id): round(r.frequency, 12) for r in together.collect()}
    alone = {}
    for k in (1, 2):
        mine = lambda df: df.where(F.col("scenario_id") == k).drop("scenario_id")  # noqa: B023, E731
        for r in W.accidents(mine(cells), W.ray_hits(mine(points), mine(edges)), mine(points), mine(depths), factors).collect():
            alone[k, r.accident, r.obstacle_id] = round(r.frequency, 12)
    assert got == alone and set(got) == {(1, "grounding", 0), (1, "allision", 1), (2, "grounding", 1)}


def test_copies_on_one_box_make_no_more_hits_and_the_same_accidents(spark):
    rng = np.random.default_rng(5)
    spots = [(float(x), float(y)) for x, y in rng.uniform((0.02, -0.004), (0.2, 0.004), (6, 2))]
    rows = [(i, "depth" if i % 2 else "object", float(rng.integers(1, 9)), x, y, x + 2e-3, y + 3e-3) for i, (x, y) in enumerate([spots[k] for k in rng.integers(0, 6, 240)])]
    obstacles = spark.createDataFrame(rows, "obstacle_id long, kind string, value_m double, x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([(1, 0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 100.0, 10.0)], "leg_id long, dir_idx int, tx double, ty double, dx double, dy double, nx double, ny double, mean_m double, std_m double, speed_kn double")
    cells = spark.createDataFrame([(1, 0, 1, s, 100.0, 10.0, s + 0.5, 3.0 * s) for s in range(10)], "leg_id long, dir_idx int, ship_type int, size_bin int, freq double, speed_kn double, draught_m double, height_m double")
    hits = lambda some: W.ray_hits(points, W.projected(W.box_edges(some), 0.0, 0.0, a=("a_lon", "a_lat"), b=("b_lon", "b_lat")))
    summed = lambda some: {(r.obstacle_id, r.kind, r.value_m): (round(r.mass, 9), round(r.mean_m, 6)) for r in W.summaries(W.first_hits(hits(some)), points).collect()}
    assert summed(W.foremost(obstacles)) == summed(obstacles) != {}
    every = [r.asDict() for r in hits(obstacles).collect()]
    assert hits(W.foremost(obstacles)).count() * 20 < len(every) and hits(W.foremost_by_depth(obstacles)).count() * 5 < len(every)
    found = W.accidents(cells, hits(W.foremost_by_depth(obstacles)), points, obstacles.where("kind = 'depth'").select("value_m"), {"grounding": 1.0, "allision": 1.0}).collect()
    got = {(r.accident, r.size_bin, r.obstacle_id) for r in found}
    first = lambda some: min(some, key=lambda h: (h["along_m"], h["obstacle_id"]), default=None)
    want = set()
    for ray in {h["ray"] for h in every}:
        of = {kind: [h for h in every if h["ray"] == ray and h["kind"] == kind] for kind in ("depth", "object")}
        ahead = first(of["object"])
        for s in range(10):
            shoal = first([h for h in of["depth"] if h["value_m"] <= s + 0.5])
            want |= {("grounding", s, shoal["obstacle_id"])} if shoal else set()
            want |= {("allision", s, ahead["obstacle_id"])} if ahead and 3.0 * s >= ahead["value_m"] else set()
    assert got == want and {k[0] for k in got} == {"grounding", "allision"}
