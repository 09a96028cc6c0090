"""Whole project files: present, old and broken ones."""

import json

import pytest

from fairway.operators.collision import CAUSATION
from fairway.sources import projects as J

NEW = {
    "pc": {"headon": 1e-4, "bend": "2e-4", "p_pc": 1},
    "drift": {"anchor_p": 70, "anchor_depth": 7, "speed": 1.5, "rose": {"0": 0.5, "45": 0.5, "up": 1}, "repair": {"use_lognormal": True, "combi": "Mean, Std", "param_0": 2, "param_1": 0}, "blackout_by_ship_type": {"18": "0.1", "x": 1}},
    "segment_data": {"1": {"Dirs": ["N going", "S going"], "mean1_1": 5, "std1_1": 100, "weight1_1": 60, "mean1_2": -5.5, "std1_2": 50, "weight1_2": "40", "weight2_1": 0}},
    "traffic_data": {
        "1": {
            "S going": {"Frequency (ships/year)": [[0, 10], ["20", None]], "Speed (knots)": [[8, 9], [10, "x"]], "Draught (meters)": [[1, 2], [3, 4]], "Ship heights (meters)": [[5, 6], [7, 8]], "Scaling (%)": [[50, 50, 50]]},
            "N going": {"Frequency (ships/year)": [[3]], "Speed (knots)": [[8]], "Draught (meters)": [], "Ship heights (meters)": [[]], "Ship Beam (meters)": [[30]]},
        }
    },
    "consequence": {"oil_onboard": [[0, 5.5]], "spill_probability": [[0.25, 0]], "spill_fraction": [[0.5]], "catastrophe_levels": [{"name": "Minor", "quantity": 50}]},
    "junctions": {"j1": {"point": [14.0, 55.0], "legs": {"1": "end", "2": "start"}, "transitions": {"1": {"2": 1.0}}}},
}


@pytest.fixture(scope="module")
def projects(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("projects")
    for name, text in (("new", json.dumps(NEW, indent=1)), ("old", "{}"), ("broken", "{not json"), ("none", "")):
        (home / name).write_text(text)
    got = J.parsed(J.read_texts(spark, str(home))).where("scenario_id <> 'broken'").cache()
    yield got
    got.unpersist()


def test_traffic_with_missing_matrices(projects):
    got = {(r.dir_idx, r.ship_type, r.size_bin): (r.own_freq, r.freq, r.speed_kn, r.draught_m, r.beam_m) for r in J.traffic(projects).collect()}
    assert got == {(1, 0, 1): (10.0, 5.0, 9.0, 2.0, 0.0), (1, 1, 0): (20.0, 20.0, 10.0, 3.0, 0.0), (0, 0, 0): (3.0, 3.0, 8.0, None, 30.0)}


def test_mixtures(projects):
    assert sorted((r.leg_id, r.dir_idx, r.component, r.mean_m, r.std_m, r.weight) for r in J.lateral(projects).collect()) == [("1", 0, 1, 5.0, 100.0, 60.0), ("1", 0, 2, -5.5, 50.0, 40.0)]


def test_causation_and_drift(projects):
    got = {(r.scenario_id, r.kind): r.factor for r in J.causation(projects).collect()}
    assert got["new", "headon"] == 1e-4 and got["new", "bend"] == 2e-4 and got["new", "crossing"] == CAUSATION["crossing"]
    assert all(got["old", k] == v for k, v in CAUSATION.items())
    settings = {r.scenario_id: r for r in J.drift_settings(projects).collect()}
    new, old = settings["new"], settings["old"]
    assert (new.anchor_p, new.anchor_d, new.speed_kn, new.repair_kind, new.repair_mean_h, new.repair_std_h) == (0.7, 7.0, 1.5, "normal", 2.0, 1e-6)
    assert (old.anchor_p, old.anchor_d, old.start_from, old.squat_mode, old.repair_kind) == (0.7, 0.0, "leg_center", "average_speed", "function")
    assert sorted((r.direction, r.weight) for r in J.rose(projects).collect()) == [(0.0, 0.5), (45.0, 0.5)]
    assert [(r.ship_type, r.per_year) for r in J.blackouts(projects).collect()] == [(18, 0.1)]


def test_consequences_and_junctions(projects):
    assert [(r.ship_type, r.size_bin, r.oil_m3) for r in J.oil_onboard(projects).collect()] == [(0, 1, 5.5)]
    assert [(r.kind, r.level, r.probability, r.fraction) for r in J.spill_matrix(projects).collect()] == [(0, 0, 0.25, 0.5)]
    assert [(r.name, r.quantity_m3) for r in J.catastrophe_levels(projects).collect()] == [("Minor", 50.0)]
    assert sorted((r.junction_id, r.leg_id, r.end, r.lon, r.source) for r in J.junction_legs(projects).collect()) == [("j1", "1", "end", 14.0, "geometry"), ("j1", "2", "start", 14.0, "geometry")]
    assert [(r.in_leg, r.out_leg, r.share) for r in J.junction_shares(projects).collect()] == [("1", "2", 1.0)]
