"""Readers and writers on small files."""

import json

import pytest

from touchline.sources import documents, mot, sinks


@pytest.fixture
def tracks(tmp_path):
    p = tmp_path / "tracks.txt"
    p.write_text("1,7,1,2,3,4,0.9,-1,-1,-1\n1,7,5,6,7,8,0.5,-1,-1,-1\n2,7,1,1,1,1,0.8,-1,-1,-1\n\n3,9,2,2,2,2,0.7,-1,-1,-1\nx,y\n")
    return str(p)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_tracks_by_ids_and_frames(spark, tracks):
    assert rows(documents.read_mot_part(spark, tracks, [7], 1, 5), "frame_proc", "global_id") == [(1, 7)]
    assert rows(documents.read_mot_part(spark, tracks), "frame_proc", "global_id") == [(0, 7), (0, 7), (1, 7), (2, 9)]
    assert rows(documents.read_boxes(spark, tracks), "global_id", "frame", "x") == [(7, 1, 5.0), (7, 2, 1.0), (9, 3, 2.0)]
    assert rows(documents.track_ids(spark, tracks), "global_id") == [(7,), (9,)]


def test_ball_and_calibration(spark, tmp_path):
    ball = tmp_path / "ball.csv"
    ball.write_text("frame_proc,ball_x_px,ball_y_px,observed\n1,1.5,2,1\n1,2.5,2,true\n2,9,9,0\n3,4,4,\n")
    assert rows(mot.read_ball(spark, str(ball)), "frame_proc", "ball_x_px") == [(1, 2.5), (3, 4.0)]
    cal = tmp_path / "cal.json"
    h = [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    cal.write_text(json.dumps({"frames": [{"proc_idx": 0, "accepted": True, "H_image_to_pitch_m": h}, {"proc_idx": 1, "accepted": False, "H_image_to_pitch_m": h}, {"proc_idx": 2, "H_image_to_pitch_m": h[:2]}]}))
    assert rows(mot.read_homographies(spark, str(cal)), "frame_proc") == [(0,)]
    team = tmp_path / "team.csv"
    team.write_text("global_id,team_id\n3,team_1\n")
    assert rows(mot.read_team_map(spark, str(team)), "global_id", "team_id") == [(3, "team_1")]


def test_json_documents(spark, tmp_path):
    p = tmp_path / "meta.json"
    assert documents.read_metadata(spark, str(p)).count() == 0
    p.write_text('﻿{"fps": 30, "name": "x"}', encoding="utf-8")
    assert rows(documents.read_metadata(spark, str(p)), "key", "value") == [("fps", "30"), ("name", "x")]
    assert documents.read_json(spark, str(p), "fps int").first().fps == 30
    p.write_text("{broken")
    assert documents.read_json(spark, str(p), "fps int").count() == 0
    assert documents.read_json(spark, str(tmp_path / "none.json"), "fps int").count() == 0
    for text in ('[{"id": 1}, {"id": 2}]', '{"events": [{"id": 1}, {"id": 2}]}'):
        p.write_text(text)
        assert rows(documents.read_events(spark, str(p), "id:int"), "id") == [(1,), (2,)]


def test_eligibility(spark, tmp_path):
    p = tmp_path / "e.json"
    item = lambda g, t, n=None, c=0.5, **k: {"global_id": g, "team": t, "predicted_number": n, "confidence": c, **k}
    doc = {"eligible_confirmed": [item(1, "Blue", 7, 0.9), item(2, "blue", 7, 0.6), item(3, "green", 1)], "excluded_conflict": [item(4, " ")], "excluded_tentative": [item(4, "White"), item(5, "", is_player=False)], "excluded_non_player": [item(6, "x")]}
    p.write_text(json.dumps(doc))
    assert rows(documents.confirmed_players(spark, str(p)), "player", "gids", "confidence") == [("blue_7", [1, 2], 0.6)]
    assert rows(documents.unresolved_players(spark, str(p)), "global_id", "team", "bucket") == [(4, "white", "excluded_tentative")]
    assert rows(documents.read_team_hints(spark, str(p)), "global_id", "team") == [(1, "blue"), (2, "blue"), (3, "green"), (4, "white"), (6, "x")]
    c = tmp_path / "t.csv"
    c.write_text("global_id,team_id\n1,Blue\n2, \n")
    assert rows(documents.read_team_hints(spark, str(c)), "global_id", "team") == [(1, "blue")]


def test_roster_and_assignments(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("姓名,号码,Team\nAnn,7,a\n,8,b\n", encoding="utf-8")
    assert rows(documents.read_roster(spark, str(p)), "name", "jersey_number", "team") == [("Ann", "7", "a")]
    j = tmp_path / "r.json"
    j.write_text('[{"player": "Bo", "no": 3}]')
    assert rows(documents.read_roster(spark, str(j)), "name", "jersey_number") == [("Bo", "3")]
    a = tmp_path / "a.json"
    a.write_text('{"5": 2, "6": {"player_id": 3, "team": "blue"}}')
    assert rows(documents.read_assignments(spark, str(a), 5), "global_id", "player_id") == [(5, 2), (6, 3)]
    for bad in ('{"5": 9}', '{"5": {"player_id": 1, "team": " "}}', '{"5": "x"}'):
        a.write_text(bad)
        with pytest.raises(Exception, match="not a player or team"):
            documents.read_assignments(spark, str(a), 5).collect()


def test_crops_and_catalogue(spark, tmp_path):
    for g, f in ((3, 10), (4, 2)):
        (tmp_path / f"gid_{g}").mkdir()
        (tmp_path / f"gid_{g}" / f"frame_{f}.jpg").write_bytes(b"abc")
    (tmp_path / "gid_4" / "other.txt").write_text("x")
    assert rows(documents.crop_files(spark, str(tmp_path)), "global_id", "frame") == [(3, 10), (4, 2)]
    assert rows(sinks.catalogue(spark, str(tmp_path)), "folder", "name", "length") == [("gid_3", "frame_10.jpg", 3), ("gid_4", "frame_2.jpg", 3), ("gid_4", "other.txt", 1)]
    assert sorted((r.files, r.bytes) for r in sinks.folder_totals(mot.manifest(spark, str(tmp_path))).collect()) == [(1, 3), (2, 4)]


def lines(path):
    return sorted({x for f in path.glob("part-*") for x in f.read_text().splitlines()})


def test_writers(spark, tmp_path, tracks):
    df = spark.createDataFrame([(1, "a", 5)], "x int, y string, z int")
    sinks.write_table(df, str(tmp_path / "t"), ["y", "x", "more"])
    assert lines(tmp_path / "t") == ["a,1,", "y,x,more"]
    sinks.write_table(df.limit(0), str(tmp_path / "none"), ["y"])
    assert lines(tmp_path / "none") == ["y"]
    sinks.write_ball(spark.createDataFrame([(2, 1.23456, 2.0)], "frame_proc int, ball_x_px double, ball_y_px double"), str(tmp_path / "b"))
    assert lines(tmp_path / "b") == ["2,1.235,2.000,1", "frame_proc,ball_x_px,ball_y_px,observed"]
    sinks.write_report(spark.createDataFrame([(1, None)], "n int, why string"), str(tmp_path / "j"))
    assert [json.loads(x) for x in lines(tmp_path / "j")] == [{"n": 1, "why": None}]
    det = mot.read_mot(spark, tracks).dropDuplicates(["frame_proc", "global_id"])
    seg = spark.createDataFrame([(0, 7, 0, 7), (1, 7, 1, 10), (2, 9, 0, 9)], "frame_proc int, global_id int, segment int, new_global_id int")
    sinks.write_split_mot(det, seg, str(tmp_path / "m"), str(tmp_path / "map"))
    assert [x.split(",")[:2] for x in lines(tmp_path / "m")] == [["1", "7"], ["2", "10"], ["3", "9"]]
    assert "7,1,10,1,1,1" in lines(tmp_path / "map")


def test_publication_is_whole_or_not_at_all(spark, tmp_path):
    df, out = spark.range(3), tmp_path / "out"
    with pytest.raises(ZeroDivisionError):
        sinks.publish(spark, str(out), lambda p: df.write.parquet(p) or 1 / 0)
    assert not out.exists() and len(list(tmp_path.glob("out.work-*"))) == 1
    sinks.publish(spark, str(out), df.write.parquet)
    assert spark.read.parquet(str(out)).count() == 3
    with pytest.raises(FileExistsError):
        sinks.publish(spark, str(out), df.write.parquet)
