import gzip
import json

from pyspark.sql import functions as F

from fairway.operators import tracks
from fairway.plans.adapters import view
from fairway.sources import sinks, tables
from fairway.streaming import reports

SF = "/root/testdata/sf0.001"


def test_reports_of_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,lon,lat,mmsi,sog,cog\n2024-01-01 00:00:00,1.5,2.5,7,3,4\nbad,1,2,7,3,4\n")
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("MMSI,BaseDateTime,LAT,LON,SOG,COG\n8,2024-01-02T00:00:00,55,14,10,90\n")
    got = tables.read_reports(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv.gz")]).orderBy("mmsi").collect()
    assert [(r.mmsi, r.lon, r.lat) for r in got] == [(7, 1.5, 2.5), (8, 14.0, 55.0)]
    assert tables.read_reports(spark, []).count() == 0


def test_segments_are_read_from_their_partitions(spark, tmp_path):
    s = spark.createDataFrame([(1, 1704067200.0), (2, 1709251200.0), (2, 1709251200.0)], "mmsi long, t1 double")
    sinks.write_segments(s, str(tmp_path / "s"), "b1")
    march = sinks.read_segments(spark, str(tmp_path / "s"), 2024, [3])
    assert [r.mmsi for r in march.collect()] == [2, 2] and "PartitionFilters: [isnotnull" in march._jdf.queryExecution().toString()


def test_projects(spark, tmp_path):
    project = {
        "segment_data": {"1": {"Start Point": "14.0 55.2", "End_Point": "POINT(14.2 55.2)", "line_length": 0.0, "Width": "500"}},
        "drift": {"anchor_p": 70.0, "anchor_d": 7.0, "speed": 1.0, "rose": {"0": 1.0}},
        "depths": [["d1", "10-20", "MULTIPOLYGON(((0 0, 1 0, 1 1, 0 0)),((5 5, 6 5, 6 6, 5 5)))"], ["d2", "5", "nonsense"]],
        "objects": [["s1", "20", "POLYGON((0 0, 2 0, 2 2, 0 0))"]],
    }
    (tmp_path / "p1.json").write_text(json.dumps(project))
    got = tables.read_projects(spark, str(tmp_path))
    assert got.first().anchor_p == 0.7
    leg = tables.project_legs(got).first()
    assert (leg.lon1, leg.lat2, leg.width_m) == (14.0, 55.2, 500.0)
    edges = tables.project_obstacles(got).collect()
    assert len(edges) == 9 and {(r.obstacle_id, r.part, r.value_m) for r in edges} == {("d1", 0, 20.0), ("d1", 1, 20.0), ("s1", 0, 20.0)}
    assert not any(r.hole for r in edges)


def test_single_depths_of_a_project_are_bins(spark, tmp_path):
    shape = "POLYGON((0 0, 1 0, 1 1, 0 0))"
    (tmp_path / "p").write_text(json.dumps({"depths": [["a", "3", shape], ["b", "6", shape], ["c", "-9", shape], ["d", "10-20", shape]], "objects": [["s", "6", shape]]}))
    got = tables.project_obstacles(tables.read_projects(spark, str(tmp_path))).collect()
    assert {r.obstacle_id: r.value_m for r in got} == {"a": 6.0, "b": 9.0, "c": 12.0, "d": 20.0, "s": 6.0}


def test_rings_are_shells_or_holes(spark):
    texts = ["POLYGON((0 0, 9 0, 9 9, 0 0), (1 1, 2 1, 2 2, 1 1))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 9 5, 9 9, 5 5), (6 6, 7 6, 7 7, 6 6)))", "POINT(1 2)", None]
    got = tables.ring_edges(spark.createDataFrame(list(enumerate(texts)), "id int, wkt string")).select("id", "part", "hole").distinct().collect()
    assert {(r.id, r.part): r.hole for r in got} == {(0, 0): False, (0, 1): True, (1, 0): False, (1, 1): False, (1, 2): True}


def run(df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streamed_splits_are_those_of_the_batch(spark, tmp_path):
    pings = tracks.one_per_time(view(spark, SF, "pings")).withColumn("t", F.col("t").cast("timestamp")).select("mmsi", "t", "t_s", "seq", "lon", "lat", "sog", "cog")
    half = pings.agg(F.avg("t_s")).first()[0]
    pings.where(F.col("t_s") < half).coalesce(1).write.parquet(str(tmp_path / "in"))
    pings.where(F.col("t_s") >= half).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pings.schema).parquet(str(tmp_path / "in"))
    got = run(reports.split(stream, 43200.0), "split_stream")
    want = tracks.split(pings, 43200.0)
    key = lambda df: sorted((r.mmsi, r.t, r.is_break, r.sub_id) for r in df.collect())
    assert key(got) == key(want)


def test_streamed_changes_and_counts(spark, tmp_path):
    rows = [(1, f"2024-01-0{d} 00:00:00", v, 5) for d, v in ((1, "a"), (2, "a"), (3, "b"), (4, None), (8, "b"))]
    spark.createDataFrame(rows, "mmsi long, t string, destination string, leg_id int").withColumn("t", F.to_timestamp("t")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("mmsi long, t timestamp, destination string, leg_id int").parquet(str(tmp_path / "in"))
    assert sorted(str(r.destination) for r in run(reports.changes(stream, ["destination"]), "changes_stream").collect()) == ["None", "a", "b", "b"]
    assert {r.n for r in run(reports.daily_counts(stream), "counts_stream").collect()} <= {1}
    assert run(reports.one_per_time(stream), "once_stream").count() == 5
