"""Versions, joins as of a time, passages to transitions, and sinks that are written twice or break."""

import random

import pytest
from pyspark.sql import functions as F

from fairway.operators import passages as P
from fairway.operators import voyages as V
from fairway.sources import sinks as S

REPORT = "mmsi long, seq long, t_s double, told boolean, imo long, dim_a long, dim_b long, dim_c long, dim_d long, draught_m double, ship_code int, destination string"


def report(mmsi, seq, t, told=True, imo=1, draught=5.0, to="x"):
    return (mmsi, seq, t, told, imo, 1, 2, 3, None, draught, 70, to)


def test_silent_reports_reuse_or_stand_for_the_unknown(spark):
    rows = [report(1, 1, 10.0, told=False), report(1, 2, 20.0), report(1, 3, 20.0), report(1, 4, 30.0, told=False), report(1, 5, 40.0, imo=2), report(1, 6, 1e7, imo=2), report(2, 1, 5.0), report(None, 1, 5.0), report(3, 1, None)]
    got = V.statics(spark.createDataFrame(rows, REPORT), F.col("told")).orderBy("mmsi", "t_s").collect()
    assert [(r.mmsi, r.seq, r.imo) for r in got] == [(1, 1, None), (1, 2, 1), (1, 5, 2), (2, 1, 1)]
    assert len({r.version_id for r in got}) == 4


def test_a_new_identity_alone_makes_a_state(spark):
    rows = spark.createDataFrame([report(1, 1, 10.0, to="  a long name of a far harbour "), report(1, 2, 20.0, to="a long name of a far"), report(1, 3, 30.0, imo=9, to="a long name of a far")], REPORT)
    states = V.states(rows, V.statics(rows)).orderBy("t_s").collect()
    assert [(r.seq, r.destination) for r in states] == [(1, "a long name of a far"), (3, "a long name of a far")] and states[0].static_id != states[1].static_id


def test_versions_and_joins_do_not_depend_on_blocks(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, float(rng.randrange(60)), rng.choice(["a", "b", None])) for i in range(300)]
    told = spark.createDataFrame(rows, "mmsi long, seq long, t_s double, name string")
    asked = spark.createDataFrame([(m, float(t)) for m in (1, 2, 3) for t in range(-2, 70, 3)] + [(None, 5.0), (1, None)], "mmsi long, t_s double")
    seen = set()
    for block_s in (1.0, 7.0, 1e9):
        kept = V.versions(told, ["name"], block_s=block_s)
        met = V.as_of(asked, kept, {"name": "name", "seq": "seq"}, block_s=block_s)
        seen.add((tuple(sorted((r.mmsi, r.seq) for r in kept.collect())), tuple(sorted(((r.mmsi, r.t_s, r.name, r.seq) for r in met.collect()), key=str))))
    assert len(seen) == 1
    kept, met = seen.pop()
    want, was = [], {}
    for m, i, t, name in sorted((r for r in rows if r[0]), key=lambda r: (r[0], r[2], r[1])):
        if m not in was or was[m] != name:
            want.append((m, t, i, name))
        was[m] = name
    assert kept == tuple(sorted((m, i) for m, _, i, _ in want)) and len(met) == asked.count()
    for m, t, name, seq in met:
        last = [w for w in want if w[0] == m and t is not None and w[1] <= t]
        assert (name, seq) == ((last[-1][3], last[-1][2]) if last else (None, None))


def test_empty_tables_and_reports_without_a_time(spark):
    none = spark.createDataFrame([], REPORT)
    assert V.states(none, V.statics(none)).count() == 0
    pings = spark.createDataFrame([(1, 7.0), (1, 3.0)], "mmsi long, t_s double")
    assert [r.t_s for r in V.dated(spark.createDataFrame([report(1, 1, None)], REPORT), pings).collect()] == [3.0]
    assert V.as_of(pings, V.statics(none), {"imo": "imo"}).where("imo is null").count() == 2


def test_crossings_become_transitions(spark):
    crossed = spark.createDataFrame([(1, 9, 0.0), (1, 9, 0.0), (2, 9, 60.0), (3, 9, 90000.0), (2, None, 1.0)], "leg_id long, mmsi long, t1 double")
    junctions = spark.createDataFrame([(5, 1), (5, 2), (5, 3), (6, 3)], "junction_id long, leg_id long")
    visits = P.junction_visits(P.leg_passages(crossed), junctions)
    assert visits.count() == 4
    assert [(r.junction_id, r.in_leg, r.out_leg, r.n) for r in P.transitions(visits).collect()] == [(5, 1, 2, 1)]


def test_runs_written_twice_or_half(spark, tmp_path):
    path = str(tmp_path / "runs")
    table = lambda *v: spark.createDataFrame([(x,) for x in v], "freq double")
    shown = lambda name: sorted((r.run_id, r.freq) for r in S.read_run(spark, path, name).collect())
    whole = {"drifting_allision": table(1.0, 2.0), "collision_lines": table(3.0), "powered_allision": table()}
    assert S.write_run(whole, path, 1) == {"drifting_allision": 2, "collision_lines": 1} == S.write_run(whole, path, 1)
    S.write_run({"drifting_allision": table(9.0)}, path, 2)
    assert shown("drifting_allision") == [(1, 1.0), (1, 2.0), (2, 9.0)] and shown("collision_lines") == [(1, 3.0)]
    broken = {"drifting_allision": table(7.0), "collision_lines": table(3.0).withColumn("freq", F.raise_error(F.lit("lost")).cast("double"))}
    with pytest.raises(Exception, match="lost"):
        S.write_run(broken, path, 1)
    assert shown("drifting_allision") == [(2, 9.0)] and shown("collision_lines") == []
    S.write_run({"drifting_allision": table(7.0)}, path, 1)
    assert shown("drifting_allision") == [(1, 7.0), (2, 9.0)] and shown("collision_lines") == []
    S.withdraw(spark, path, "run_id", 2)
    assert shown("drifting_allision") == [(1, 7.0)]
    with pytest.raises(ValueError):
        S.write_run({"other": table(1.0)}, path, 3)


def test_a_batch_replayed_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "seg")
    batch = spark.createDataFrame([(1, 1704067200.0), (2, 1709251200.0)], "mmsi long, t1 double")
    for name in ("a", "b", "a"):
        S.write_segments(batch, path, name)
    assert S.read_segments(spark, path, 2024, [3]).count() == 2 and S.read_segments(spark, path).count() == 4
    S.write_segments(batch.where("mmsi = 1"), path, "a")
    assert sorted((r.batch, r.month) for r in S.read_segments(spark, path).collect()) == [("a", 1), ("b", 1), ("b", 3)]
