"""Pinned small cases of single operators."""

import pytest
from pyspark.sql import functions as F

from touchline.functions import seq
from touchline.operators import events, identity, possession, running, tracks
from touchline.sources import mot
from touchline.streaming import windows


def path(spark, xs, gid=1, first=0):
    return spark.createDataFrame([(gid, first + k, float(x), 0.0) for k, x in enumerate(xs)], "gid int, frame int, x double, y double")


def alternating(spark, gap, team="a"):
    players = [(f, 1, 0.0, 0.0) for f in range(3)] + [(f, 2, gap - 0.5 if gap > 5 else gap, 0.0) for f in range(3, 6)]
    ball = [(f, 0.5 if gap > 5 else 0.0, 0.0) for f in range(3)] + [(f, gap, 0.0) for f in range(3, 6)]
    m = possession.nearest_player(spark.createDataFrame(players, "frame int, gid int, x double, y double"), spark.createDataFrame(ball, "frame int, bx double, bz double"), 1.5)
    iv = possession.intervals(m, 3)
    teams = spark.createDataFrame([(1, "a"), (2, team)], "gid int, team string")
    return iv, possession.classified(possession.transitions(iv, 15), teams, 0.5)


@pytest.mark.parametrize(("gap", "team", "kind"), [(10.5, "a", "directed"), (0.1, "a", "short"), (10.5, "b", "opponent")])
def test_transition_kinds(spark, gap, team, kind):
    iv, tr = alternating(spark, gap, team)
    assert [r.gid for r in iv.orderBy("start_frame").collect()] == [1, 2]
    assert [r.kind for r in tr.collect()] == [kind]
    assert possession.passes(tr, 10.0).count() == (kind == "directed")


def test_grey_zone_and_strict_reach(spark):
    assert possession.grey_zone(alternating(spark, 0.3)[1], 0.25, 0.5).count() == 1
    p = spark.createDataFrame([(0, 1, 1.5, 0.0)], "frame int, gid int, x double, y double")
    b = spark.createDataFrame([(0, 0.0, 0.0)], "frame int, bx double, bz double")
    assert possession.nearest_player(p, b, 1.5).count() == 0


def test_transitions_across_blocks(spark):
    iv = spark.createDataFrame([(k % 2, 5 * k, 5 * k + 3, 4, 0.0, 0.0, 0.0, 0.0, 5 * k + 1) for k in range(30)], "gid int, start_frame int, end_frame int, n int, sbx double, sby double, ebx double, eby double, confirmed_frame int")
    assert possession.transitions(iv, 15, block=7).count() == possession.transitions(iv, 15).count() == 29


def test_median_removes_a_spike(spark):
    t = running.timeseries(path(spark, [0.0] * 10 + [100.0] + [0.0] * 10), 10.0)
    assert [r.x_smooth for r in t.collect()] == [0.0] * 21


def test_constant_speed(spark):
    s = running.summary(running.timeseries(path(spark, [0.2 * k for k in range(61)]), 30.0)).first()
    assert (s.distance_m, s.high_speed_m, s.p95_speed) == (12.0, 12.0, 6.0)


def test_short_runs_are_left_out_and_gaps_split(spark):
    assert running.timeseries(path(spark, range(10)), 10.0).count() == 0
    two = path(spark, range(11)).unionByName(path(spark, range(11), first=20))
    assert running.summary(running.timeseries(two, 10.0)).first().segments == 2


def test_bouts(spark):
    s = path(spark, [1.0] * 5 + [5.2] * 6 + [3.0] * 5).withColumnRenamed("x", "speed")
    b = running.bouts(s, 4.5, 1, 5).collect()
    assert [(r.start_frame, r.end_frame, r.peak) for r in b] == [(5, 10, 5.2)]


def test_gap_filling(spark):
    t = spark.createDataFrame([(0, 0.0), (2, 2.0), (8, 8.0)], "frame int, x double")
    got = {r.frame: (r.x, r.source) for r in seq.fill_gaps(t, [], "frame", ["x"], 3).collect()}
    assert got == {0: (0.0, "observed"), 1: (1.0, "interpolated"), 2: (2.0, "observed"), 8: (8.0, "observed")}


def test_switch_and_segments(spark):
    rows = spark.createDataFrame([(1, k, m) for k, m in enumerate([0] * 20 + [-1] * 3 + [1] * 22)], "gid int, frame int, mode int")
    cuts = identity.switches(rows, "gid", "frame", "mode", 8, 5, 0.8)
    assert [r.cut_frame for r in cuts.collect()] == [23]
    assert identity.segments(rows, cuts, "gid", "frame").where("segment = 1").count() == 22


def test_best_per_frame(spark):
    d = spark.createDataFrame([(1, 1, 0.2, 10.0), (1, 1, 0.9, 11.0)], "frame int, gid int, conf double, x double")
    assert [r.x for r in tracks.best_per_frame(d, ["frame", "gid"], ["conf"]).collect()] == [11.0]
    assert tracks.violations(d, ["frame", "gid"]).count() == 1


def test_round_robin_and_suppression(spark):
    d = spark.createDataFrame([("b", 1.0, 1), ("a", 2.0, 2), ("a", 3.0, 3), ("b", 4.0, 4), ("c", 5.0, 5)], "t string, s double, id int")
    assert sorted(r.id for r in seq.round_robin(d, "t", [F.col("s").desc()], 4).collect()) == [2, 3, 4, 5]
    p = spark.createDataFrame([(1, 10, 5.0), (1, 12, 9.0), (1, 30, 1.0)], "gid int, frame int, x double")
    assert sorted(r.frame for r in events.peaks(p, "gid", "frame", "x", 5).collect()) == [12, 30]


def test_mot_files(spark, tmp_path):
    src = tmp_path / "a.txt"
    src.write_text("1,3,1.0,2.0,3.0,4.0,0.5,-1,-1,-1\n\n2,3.0,1,2,3,4,0.25,-1,-1,-1\n")
    df = mot.read_mot(spark, str(src), strict=True)
    assert [(r.frame_proc, r.global_id) for r in df.orderBy("frame_proc").collect()] == [(0, 3), (1, 3)]
    mot.write_mot(df, str(tmp_path / "out"))
    assert sorted(spark.read.text(str(tmp_path / "out")).collect())[0][0] == "1,3,1.0,2.0,3.0,4.0,0.500,-1,-1,-1"
    src.write_text("1,3,1,2,3,4,0.5,-1,-1,-1\n1,3,1,2,3,4,0.5,-1,-1,-1\n")
    with pytest.raises(Exception, match="more than once"):
        mot.read_mot(spark, str(src), strict=True).collect()


def test_stream_agrees_with_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = windows.tumbling(s).writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("tumbled").collect()) == sorted(windows.tumbling(e).collect())
