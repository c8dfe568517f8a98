"""Files of several splits, the track data source, and the best detection on a stream."""

import json
import random

import pytest

from touchline.operators import tracks
from touchline.sources import documents, lines, mot, track_files
from touchline.streaming import best

from .test_streaming import collect, write


@pytest.fixture
def short_splits(spark):
    """Splits of a few hundred bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "8"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def detections(n, seed):
    rng = random.Random(seed)
    return [(rng.randint(1, 40), rng.randint(1, 5), round(rng.random() * 40, 1), round(rng.random() * 9, 1), 1.0, 2.0, rng.choice([0.25, 0.5, 0.75])) for _ in range(n)]


def text(rows):
    return "".join(",".join(map(str, r)) + ",-1,-1,-1\n" for r in rows)


def test_lines_keep_their_order_over_splits(spark, tmp_path, short_splits):
    rows = detections(400, 1)
    folder = tmp_path / "t"
    folder.mkdir()
    (folder / "a.txt").write_text(text(rows[:250]))
    (folder / "b.txt").write_text(text(rows[250:]) + "x,y\n\n")
    assert spark.read.text(str(folder)).rdd.getNumPartitions() > 4
    got = lines.numbered(lines.read_lines(spark, str(folder))).collect()
    assert sorted((r._file[-5:], r.line, r.value) for r in got)[:250] == [("a.txt", k + 1, text([r])[:-1]) for k, r in enumerate(rows[:250])]
    assert [v for _, v in sorted((r.line, r.value) for r in documents.numbered_lines(spark, str(folder / "a.txt")).collect())] == text(rows[:250]).splitlines()
    last = {(r[1], r[0]): r[2:6] for r in rows}
    assert {(r.global_id, r.frame): (r.x, r.y, r.w, r.h) for r in documents.read_boxes(spark, str(folder)).collect()} == last
    first: dict = {}
    for r in rows:
        k = (r[0] - 1, r[1])
        if k not in first or r[6] > first[k][6]:
            first[k] = r
    got = documents.read_best(spark, str(folder)).collect()
    assert {(r.frame_proc, r.global_id): (r.x, r.y, r.confidence) for r in got} == {k: (r[2], r[3], r[6]) for k, r in first.items()} and sum(r.removed for r in got) == 400 - len(first)


def test_ball_of_several_splits(spark, tmp_path, short_splits):
    rng = random.Random(2)
    rows = [(rng.randint(0, 30), k + 0.5, rng.choice(["1", "true", "0", ""])) for k in range(300)]
    (tmp_path / "ball.csv").write_text("frame_proc,ball_x_px,ball_y_px,observed\n" + "".join(f"{f},{x},2,{o}\n" for f, x, o in rows))
    want = {f: x for f, x, o in rows if o != "0"}
    assert {r.frame_proc: r.ball_x_px for r in mot.read_ball(spark, str(tmp_path / "ball.csv")).collect()} == want
    (tmp_path / "none.csv").write_text("frame_proc,ball_x_px,ball_y_px,observed\n1,2,2,0\n")
    with pytest.raises(ValueError):
        mot.read_ball(spark, str(tmp_path / "none.csv"))


def test_strict_reading_refuses_any_broken_line(spark, tmp_path):
    p = tmp_path / "t.txt"
    for bad in ("x,1,1,1,1,1,1", "1,1,1,1,1,1", "0,1,1,1,1,1,1", "1,1,1,1,1,1,high"):
        p.write_text(text(detections(3, 1)[:1]) + bad + "\n")
        with pytest.raises(Exception, match="seven numbers"):
            mot.read_mot(spark, str(p), strict=True).collect()


# ---- the data source ----


@pytest.fixture
def source(spark):
    track_files.register(spark)
    return spark


def read(spark, path, **options):
    return spark.read.format("tracks").options(**options).load(str(path))


@pytest.mark.parametrize("split", [17, 300, 1 << 20])
def test_each_line_is_read_once(source, tmp_path, split):
    rows = detections(200, 3)
    (tmp_path / "a.txt").write_text(text(rows[:120]) + "\n")
    (tmp_path / "b.txt").write_text(text(rows[120:])[:-1])  # no newline at the end
    got = read(source, tmp_path, split=split)
    assert sorted((r.frame_proc + 1, *r[1:]) for r in got.collect()) == sorted(rows)
    assert read(source, tmp_path / "a.txt", split=split).count() == 120


def test_filters_reach_the_reader(source, tmp_path, capsys):
    rows = detections(300, 4)
    (tmp_path / "a.txt").write_text(text(rows))
    df = read(source, tmp_path / "a.txt", split=500).where("global_id in (2, 4) and frame_proc >= 10 and frame_proc < 30 and x > 5")
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(frame_proc), In(global_id, [2,4]), GreaterThanOrEqual(frame_proc,10), LessThan(frame_proc,30)]" in plan
    conditions = [line for line in plan.splitlines() if line.startswith("Condition")]
    assert conditions and not any("frame_proc" in line or "global_id" in line for line in conditions)  # Spark itself tests x only
    assert sorted((r.frame_proc + 1, *r[1:]) for r in df.collect()) == sorted(r for r in rows if r[1] in (2, 4) and 11 <= r[0] < 31 and r[2] > 5)
    empty = tmp_path / "none.txt"
    empty.write_text("")
    assert read(source, empty).count() == 0


def test_broken_lines_are_named_or_left_out(source, tmp_path):
    rows = detections(100, 5)
    for bad in ("1,2,3", "x,1,1,1,1,1,0.5,-1,-1,-1", "0,1,1,1,1,1,0.5,-1,-1,-1"):
        p = tmp_path / "bad.txt"
        p.write_text(text(rows[:70]) + bad + "\n" + text(rows[70:]))
        with pytest.raises(Exception, match="bad.txt, line 71"):
            read(source, p, split=400).collect()
        assert read(source, p, split=400, strict="false").count() == 100


def test_a_write_counts_as_a_whole(source, tmp_path):
    df = source.createDataFrame([(f - 1, *r) for f, *r in detections(90, 6)], track_files.SCHEMA).repartition(4)
    at = str(tmp_path / "out")
    df.write.format("tracks").mode("append").save(at)
    assert sorted(read(source, at).collect()) == sorted(df.collect())
    df.limit(5).write.format("tracks").mode("append").save(at)
    assert read(source, at).count() == 95
    # a task that fails aborts the write: what was there stays
    broken = df.selectExpr("frame_proc", "global_id", "x", "y", "w", "h", "if(frame_proc > 30, raise_error('lost'), confidence) confidence")
    with pytest.raises(Exception):
        broken.write.format("tracks").mode("overwrite").save(at)
    assert read(source, at).count() == 95
    # a pointer that was cut off doesn't count
    (tmp_path / "out" / track_files.VERSIONS / "00000009.json").write_text('{"files": ["a')
    assert read(source, at).count() == 95
    df.limit(3).write.format("tracks").mode("overwrite").save(at)
    assert read(source, at).count() == 3
    assert len(json.loads((tmp_path / "out" / track_files.VERSIONS / "00000001.json").read_text())["files"]) >= 1
    with pytest.raises(Exception, match="lacking"):
        df.drop("x").write.format("tracks").mode("append").save(at)


# ---- streams ----


def test_the_best_detection_of_a_stream_is_that_of_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", best.STORE)
    try:
        rng = random.Random(7)
        rows = []
        for k in range(240):
            frame = k // 6
            rows.append((frame, rng.randint(1, 3), rng.choice([None, 0.25, 0.5, 0.75]), k, f"2024-01-01 00:{frame // 60:02d}:{frame % 60:02d}"))
        for k in range(0, 236, 4):  # late ones, but within the watermark
            rows[k], rows[k + 3] = rows[k + 3], rows[k]
        end = [(10_000, 9, 0.1, 999, "2024-01-02 00:00:00")]
        schema = "frame int, gid int, conf double, line int, ts string"
        folder = str(tmp_path / "in")
        write(spark, rows, schema, folder, 5)
        write(spark, end, schema, folder, 1)
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        got = collect(spark, best.best_seen(s, ["frame", "gid"], "ts", "conf", "line"), "best_of_stream")
        want = best.best_seen(spark.createDataFrame(rows, schema), ["frame", "gid"], "ts", "conf", "line").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr) and len(want) > 60
        plain = tracks.best_by_line(spark.createDataFrame(rows, schema), ["frame", "gid"], "conf", "line").collect()
        assert {(r.frame, r.gid, r.line) for r in got} == {(r.frame, r.gid, r.line) for r in plain}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_audits_and_calibrations_are_refused_if_they_lack_something(spark, tmp_path):
    p = tmp_path / "audit.csv"
    p.write_text("﻿global_id, verdict\n1,same\n,\n2,\n", encoding="utf-8")
    assert sorted(tuple(r) for r in documents.read_audit(spark, str(p), ["global_id", "verdict"]).collect()) == [("1", "same"), ("2", None)]
    with pytest.raises(ValueError, match="reviewer"):
        documents.read_audit(spark, str(p), ["reviewer"])
    h = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    c = tmp_path / "cal.json"
    for passed, frames in ((True, [{"proc_idx": 0, "accepted": True, "H_image_to_pitch_m": h}]), (False, [{"proc_idx": 0, "accepted": True, "H_image_to_pitch_m": h}]), (True, [])):
        c.write_text(json.dumps({"validation": {"passed": passed}, "frames": frames}))
        if passed and frames:
            assert mot.read_homographies(spark, str(c), strict=True).count() == 1
        else:
            with pytest.raises(ValueError):
                mot.read_homographies(spark, str(c), strict=True)
