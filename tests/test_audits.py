"""Audits, the junction registry, sources and track rules against small tables and brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairway.functions import expr as X
from fairway.operators import audits as A
from fairway.operators import passages as P
from fairway.operators import tracks as T
from fairway.sources import tables as S


def test_consequence_inputs_know_the_default_levels(spark):
    levels = spark.createDataFrame([(1, "Minor", 50.0), (1, "Major", 500.0), (1, "Catastrophic", 5000.0), (2, "Minor", 60.0), (2, "Major", 500.0)], "scenario_id long, name string, quantity_m3 double")
    matrix = spark.createDataFrame([(1, "a", 0)] * 32, "scenario_id long, kind string, level int")
    oil = spark.createDataFrame([(2, 0, 0, 1.0)] * 6, "scenario_id long, ship_type int, size_bin int, oil_m3 double")
    got = {r.scenario_id: (r.levels, r.default_levels, r.spill_cells, r.oil_cells) for r in A.consequence_inputs(matrix, levels, oil, {"Minor": 50.0, "Major": 500.0, "Catastrophic": 5000.0}).collect()}
    assert got == {1: (3, True, 32, 0), 2: (2, False, 0, 6)}


def test_route_findings(spark):
    legs = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 0.0, 1.0, 1.0, 0.0), (3, 1.0005, 1.0, 2.0, 1.0)], "leg_id long, lon1 double, lat1 double, lon2 double, lat2 double")
    got = Counter(r.check for r in A.route_findings(legs).collect())
    assert got == {"close_waypoints": 1, "crossing_legs": 1}


def test_depth_texts(spark):
    texts = ["12", "-12.5", "10-20", "-20--10", "deep", None]
    rows = spark.createDataFrame([(1, t) for t in texts], "scenario_id long, depth string")
    assert [r.d for r in rows.select(S.depth_m(F.col("depth")).alias("d")).collect()] == [12.0, 12.5, 20.0, 20.0, None, None]
    steps = spark.createDataFrame([(1, t) for t in ("3", "6", "-9", "9", "20", "0-3")] + [(2, "5")], "scenario_id long, depth string")
    assert {r.scenario_id: r.bin_m for r in S.depth_bin_width(steps).collect()} == {1: 3.0, 2: 0.0}


def test_runs_and_years(spark):
    runs = spark.createDataFrame([(1, "a"), (3, "c"), (2, "b")], "run_id long, name string")
    assert [r.run_id for r in S.list_runs(runs).collect()] == [3, 2, 1]
    assert S.get_run(runs, 2).first().name == "b" and {r.run_id for r in S.without_run(runs, 2).collect()} == {1, 3}
    marks = spark.sql("SELECT 1 AS mmsi, timestamp'2024-06-01' AS last_t UNION ALL SELECT 2, timestamp'2025-01-01'")
    rows, left = S.without_year(spark.createDataFrame([(2024, 1), (2025, 2)], "year int, x int"), marks, 2024)
    assert [r.x for r in rows.collect()] == [2] and [r.mmsi for r in left.collect()] == [2]


def anchored(visits, window_s):
    """The rule by a plain loop: the leg that a vessel came by stays until it times out."""
    first = {}
    for junction, mmsi, leg, t in visits:
        first[junction, mmsi, leg] = min(t, first.get((junction, mmsi, leg), t))
    counts = Counter()
    per = {}
    for (junction, mmsi, leg), t in first.items():
        per.setdefault((junction, mmsi), []).append((t, leg))
    for (junction, _), seen in per.items():
        at, came = None, None
        for t, leg in sorted(seen):
            if came is not None and t - at <= window_s:
                counts[junction, came, leg] += leg != came
            else:
                at, came = t, leg
    return {k: n for k, n in counts.items() if n}


def test_transitions_keep_the_first_leg_until_it_times_out(spark):
    rng = random.Random(5)
    visits = [(f"j{rng.randrange(3)}", rng.randrange(12), rng.randrange(5), float(rng.randrange(0, 40_000))) for _ in range(400)]
    rows = spark.createDataFrame(visits, "junction_id string, mmsi long, leg_id long, t_s double")
    got = {(r.junction_id, r.in_leg, r.out_leg): r.n for r in P.transitions(rows).collect()}
    assert got == anchored(visits, 7200.0)


def kept_by_recursion(t, x, y, sog, a, b):
    if b - a < 2:
        return set()
    worst, at = 0.0, None
    for i in range(a + 1, b):
        s = (t[i] - t[a]) / max(t[b] - t[a], 1e-9)
        off = np.hypot(x[i] - (x[a] + s * (x[b] - x[a])), y[i] - (y[a] + s * (y[b] - y[a])))
        speed = np.hypot(x[b] - x[a], y[b] - y[a]) / max(t[b] - t[a], 1e-9) * X.MS_KNOT_AIS
        v = max(off / 30.0, abs(sog[i] - speed) / 0.3)
        if v > worst:
            worst, at = v, i
    if worst <= 1:
        return set()
    return {at} | kept_by_recursion(t, x, y, sog, a, at) | kept_by_recursion(t, x, y, sog, at, b)


def test_compression_keeps_what_the_recursive_rule_keeps(spark):
    rng = np.random.default_rng(2)
    rows, want = [], set()
    for mmsi in range(4):
        n = 60
        t = np.cumsum(rng.integers(20, 60, n)).astype(float)
        heading = np.cumsum(rng.normal(0, 0.15, n))
        step = np.diff(t, prepend=t[0]) * 5.0
        lon, lat = 14 + np.cumsum(step * np.sin(heading)) / 63_000, 55 + np.cumsum(step * np.cos(heading)) / 111_000
        sog = 9.7 + rng.normal(0, 0.2, n)
        x, y = np.radians(lon) * np.cos(np.radians(lat.mean())) * X.EARTH_M, np.radians(lat) * X.EARTH_M
        want |= {(mmsi, i) for i in {0, n - 1} | kept_by_recursion(t, x, y, sog, 0, n - 1)}
        rows += [(mmsi, 0, i, float(t[i]), float(lon[i]), float(lat[i]), float(sog[i]), 0.0) for i in range(n)]
    table = spark.createDataFrame(rows, "mmsi long, sub_id long, seq long, t_s double, lon double, lat double, sog double, cog double")
    got = {(r.mmsi, r.seq) for r in T.compress(table).collect()}
    assert got == want and 8 < len(want) < len(rows)


@pytest.mark.parametrize("times, covered", [([0.0, 3600.0, 90_000.0], 3600.0), ([0.0], 0.0), ([0.0, 43_200.0, 86_400.0], 86_400.0), ([10.0, 43_210.1], 0.0)])
def test_coverage_leaves_out_long_gaps(spark, times, covered):
    got = P.coverage(spark.createDataFrame([(t,) for t in times], "t_s double")).first()
    assert got.covered_s == pytest.approx(covered, abs=1e-6) and (got.multiplier is None) == (covered <= 0)


def test_compression_walks_sub_tracks_over_the_ends_of_batches(spark):
    rows = [(m, s, 10 * s + k, 60.0 * k, 14.0 + 0.001 * k, 55.0 + (0.002 if (k + (m or 0)) % 3 == 0 else 0.0), 5.0, 90.0) for m in (1, 2, None) for s in (0, 1) for k in range(1, 9)]
    table = spark.createDataFrame(rows, "mmsi long, sub_id long, seq long, t_s double, lon double, lat double, sog double, cog double")
    kept = lambda: sorted(map(str, T.compress(table).collect()))
    whole = kept()
    assert "FlatMapGroups" not in T.compress(table)._jdf.queryExecution().toString()  # a group for each would cost more than its work
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (1, 3, 7):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            assert kept() == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert 12 < len(whole) <= len(rows) and sum("mmsi=None" in r and ("seq=1," in r or "seq=8," in r) for r in whole) == 2


def test_opposite_courses_have_the_mean_that_the_c_library_gives(spark):
    pairs = [(c, (c + 180) % 360) for c in range(360)] + [(10, 20), (350, 10)]
    rows = [(i, 0, k, float(k), 14.0, 55.0, 5.0, float(c)) for i, pair in enumerate(pairs) for k, c in enumerate(pair)]
    found = T.segments(spark.createDataFrame(rows, "mmsi long, sub_id long, seq long, t_s double, lon double, lat double, sog double, cog double"))
    got = {r.mmsi: round(r.cog, 6) for r in found.collect()}
    for i, pair in enumerate(pairs):
        a, b = map(math.radians, pair)
        assert got[i] == round((math.degrees(math.atan2(math.sin(a) + math.sin(b), math.cos(a) + math.cos(b))) + 360) % 360, 6)
