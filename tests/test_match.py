"""Candidates, lasting changes, fields, compilations, event tables and packages: planted cases and plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import seq
from touchline.operators import candidates, clusters, events, field, identity, reviews, timeline, transitions

# ---- order ----


def test_places_in_an_order_with_ties_and_nulls(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, "a", "b"]), rng.choice([None, 1.0, 1.0, 2.5, rng.random()])) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, key string, v double").repartition(5)
    for down in (False, True):
        got = {r.k: r.place for r in seq.row_index(df, ["key"], "v", ["k"], "place", descending=down).collect()}
        for key in (None, "a", "b"):
            own = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] is None, (-r[2] if down else r[2]) if r[2] is not None else 0, r[0]))
            assert [got[r[0]] for r in own] == list(range(len(own)))
    assert seq.row_index(df.limit(0), [], "v", ["k"], "place").count() == 0


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(4)
    per = {"small": rng.random(7), "ties": np.repeat([0.0, 1.0, 2.0], [4000, 2500, 1]), "wide": rng.normal(size=9001), "one": np.array([3.0])}
    rows = [(k, float(x)) for k, v in per.items() for x in v] + [("small", None), ("none", None)]
    df = spark.createDataFrame(rows, "key string, v double")
    for part in (0.0, 0.5, 0.95, 0.97, 1.0):
        got = {r.key: r.p for r in seq.percentile(df, ["key"], "v", part, "p").collect()}
        assert got.keys() == per.keys()
        for k, v in per.items():
            assert abs(got[k] - np.percentile(v, 100 * part)) < 1e-12
        everything = np.concatenate(list(per.values()))
        assert abs(seq.percentile(df, [], "v", part, "p").first().p - np.percentile(everything, 100 * part)) < 1e-12


# ---- candidates ----


def greedy(rows, distance):
    kept = []
    for f, s in sorted(rows, key=lambda r: (-r[1], r[0])):
        if all(abs(f - k) >= distance for k, _ in kept):
            kept.append((f, s))
    return sorted(kept)


@pytest.mark.parametrize("kind", ["noise", "ramp", "ties", "far"])
def test_suppression_is_the_greedy_one(spark, kind):
    rng = random.Random(kind)
    score = {"noise": lambda f: rng.random(), "ramp": lambda f: float(f), "ties": lambda f: float(rng.randint(0, 2)), "far": lambda f: math.sin(f / 7)}[kind]
    rows = [(k, f, score(f)) for k in (0, 1) for f in sorted(rng.sample(range(-50, 3000), 900))]
    df = spark.createDataFrame(rows, "key int, frame int, score double")
    got = candidates.suppressed(df, ["key"], "frame", "score", 12, block=64)
    assert got.dtypes == [("key", "int"), ("frame", "int"), ("score", "double")]
    back = got.collect()
    for k in (0, 1):
        assert sorted((r.frame, r.score) for r in back if r.key == k) == greedy([r[1:] for r in rows if r[0] == k], 12)


def plain_actions(ball, players, total, fps, longest, margin, apart, part):
    at = np.arange(total)
    seen = sorted(ball)
    score, kinds = np.zeros(total), [candidates.OTHER] * total
    sure = np.ones(total, bool)
    smooth = lambda a: np.convolve(a, np.ones(5) / 5, mode="same")
    z = lambda a: (a - a.mean()) / a.std() if a.std() > 1e-6 else a * 0
    if len(seen) > 1:
        sure[:] = False
        for a, b in zip(seen, seen[1:]):
            if b - a <= longest:
                sure[a : b + 1] = True
        sure[seen] = True
        x, y = (smooth(np.interp(at, seen, [ball[f][k] for f in seen])) for k in (0, 1))
        vx, vy = np.gradient(x) * fps, np.gradient(y) * fps
        v, acc = np.hypot(vx, vy), np.hypot(np.gradient(vx), np.gradient(vy))
        turn = np.zeros(total)
        for k in range(1, total):
            if v[k - 1] > 1 and v[k] > 1:
                turn[k] = math.degrees(math.acos(max(-1, min(1, (vx[k - 1] * vx[k] + vy[k - 1] * vy[k]) / (v[k - 1] * v[k])))))
        score = z(acc) + z(turn * v)
        kick = np.percentile(acc[sure], 95)
        kinds = [candidates.OTHER if not sure[k] else candidates.KICK if acc[k] > kick else candidates.TURN if turn[k] > 90 else candidates.OTHER for k in range(total)]
    fast = np.zeros(total)
    for track in players.values():
        fs = sorted(track)
        for a, b in zip(fs, fs[1:]):
            if b - a <= 3:
                fast[b] = max(fast[b], math.dist(track[a], track[b]) / (b - a) * fps)
    score = score + 0.5 * z(smooth(fast))
    good = [k for k in range(margin, total - margin) if sure[k]]
    lim = np.percentile(score[good], 100 * part)
    return [(k + 1, f, kinds[f], round(s, 3)) for k, (f, s) in enumerate(greedy([(f, score[f]) for f in good if score[f] >= lim], 2 * apart))]


def test_action_candidates(spark):
    rng = random.Random(11)
    total, rows, boxes, want = 400, [], [], {}
    for m in range(3):
        ball = {f: (rng.random() * 40, rng.random() * 20) for f in rng.sample(range(total), 120)} if m < 2 else {5: (1.0, 1.0)}
        players = {g: {f: (f / 9 + rng.random(), rng.random() * 9) for f in rng.sample(range(total), 200)} for g in range(3)}
        rows += [(m, f, *p) for f, p in ball.items()]
        boxes += [(m, g, f, *p) for g, t in players.items() for f, p in t.items()]
        want[m] = plain_actions(ball, players, total, 25.0, 6, 10, 7, 0.9)
    got = candidates.action_candidates(
        spark.createDataFrame(rows, "m int, frame int, x double, y double"), spark.createDataFrame(boxes, "m int, gid int, frame int, x double, y double"), ["m"], total, 25.0, 6, 10, 7, 0.9, block=64
    ).collect()
    for m in range(3):
        mine = sorted((r.event_id, r.frame, r.event_type, r.score) for r in got if r.m == m)
        assert [r[:3] for r in mine] == [r[:3] for r in want[m]] and len(mine) > 2
        assert all(abs(a[3] - b[3]) < 2e-3 for a, b in zip(mine, want[m]))


# ---- lasting changes ----

CASES = {
    "after an occlusion": ([(1, 20, 0, 0.95), (21, 23, None, 0.0), (24, 45, 1, 0.93)], [(24, 0, 1)]),
    "flicker": ([(1, 14, 0, 0.95), (15, 15, 1, 0.99), (16, 30, 0, 0.95)], []),
    "the same after a gap": ([(1, 20, 2, 0.91), (21, 25, None, 0.0), (26, 45, 2, 0.92)], []),
    "not trusted": ([(1, 20, 0, 0.95), (21, 40, 1, 0.20), (41, 60, 0, 0.95)], []),
    "an excursion": ([(1, 30, 0, 0.95), (31, 50, 1, 0.95), (51, 90, 0, 0.95)], []),
    "there and back later": ([(1, 30, 0, 0.9), (31, 80, 1, 0.9), (81, 120, 0, 0.9)], [(31, 0, 1), (81, 1, 0)]),
    "too far away": ([(1, 20, 0, 0.9), (60, 80, 1, 0.9)], []),
    "little evidence": ([(1, 4, 0, 0.9), (5, 9, 1, 0.9)], []),
}


def plain_transitions(rows, window=8, least=5, purity=0.75, trust=0.35, span=24, cooldown=12, horizon=30):
    rows = sorted(rows)
    seen = [r for r in rows if r[1] is not None and r[2] >= trust]
    if len(seen) < 2 * least:
        return []

    def majority(side):
        modes = [m for _, m, _ in side]
        best = max(dict.fromkeys(modes), key=modes.count, default=None)
        return best, modes.count(best) / len(modes) if modes else 0, len(modes)

    found = []
    for at, _, _ in rows[1:]:
        left = [r for r in seen if at - span <= r[0] < at][-window:]
        right = [r for r in seen if at <= r[0] <= at + span][:window]
        (b, bp, bn), (a, ap, an) = majority(left), majority(right)
        if b is not None and a is not None and a != b and min(bn, an) >= least and min(bp, ap) >= purity:
            found.append((next(f for f, m, _ in right if m == a), b, a))
    taken = []
    for c in found:
        if not taken or (c[0] - taken[-1][0] >= cooldown and c[1:] != taken[-1][1:]):
            taken.append(c)
    out, k = [], 0
    while k < len(taken):
        if k + 1 < len(taken) and taken[k + 1][0] - taken[k][0] <= horizon and taken[k][1:] == taken[k + 1][:0:-1]:
            k += 2
        else:
            out.append(taken[k])
            k += 1
    return out


def test_lasting_changes(spark):
    rows, want = [], {}
    for n, (ranges, cuts) in CASES.items():
        own = [(f, m, c) for a, b, m, c in ranges for f in range(a, b + 1)]
        rows += [(n, *r) for r in own]
        want[n] = cuts
        assert plain_transitions(own) == cuts
    rng = random.Random(6)
    for k in range(25):
        mode, own = 0, []
        for f in sorted(rng.sample(range(400), 220)):
            mode = rng.choice([0, 1, 2]) if rng.random() < 0.03 else mode
            own.append((f, rng.choice([mode] * 9 + [None, 1]), rng.choice([0.9, 0.9, 0.9, 0.1])))
        rows += [(f"random {k}", *r) for r in own]
        want[f"random {k}"] = plain_transitions(own)
    got = transitions.persistent(spark.createDataFrame(rows, "key string, frame int, mode int, confidence double"), ["key"]).collect()
    back = {n: sorted((r.cut_frame, r.before_mode, r.after_mode) for r in got if r.key == n) for n in want}
    assert back == want and sum(map(len, want.values())) > 10


def test_appearance_by_blocks_is_that_of_the_whole_track(spark):
    rng = np.random.default_rng(5)
    rows = []
    for gid in range(4):
        at = np.cumsum(rng.integers(1, 3, 300))
        main = np.repeat(rng.integers(0, 3, 10), 30)
        rows += [(gid, int(f), (np.eye(4)[m] + rng.normal(0, 0.12, 4)).tolist()) for f, m in zip(at, main)]
    df = spark.createDataFrame(rows, "gid int, frame int, feature array<double>")
    whole, parts = (sorted((r.gid, r.cut_frame, round(r.ratio, 9)) for r in identity.local_changes(df, block=b).collect()) for b in (10_000, 17))
    assert whole == parts and len(whole) > 10


# ---- fields ----


def plain_signed(p, polygon):
    def far(a, b):
        d = (b[0] - a[0], b[1] - a[1])
        n = d[0] ** 2 + d[1] ** 2
        t = max(0, min(1, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / n)) if n else 0
        return math.hypot(a[0] + t * d[0] - p[0], a[1] + t * d[1] - p[1])

    edges = list(zip(polygon, polygon[1:] + polygon[:1]))
    odd = sum((a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0] for a, b in edges) % 2
    return min(far(a, b) for a, b in edges) * (1 if odd else -1)


def test_polygons_between_key_frames(spark):
    square, shifted, five = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(4.0, 0.0), (14.0, 0.0), (14.0, 10.0), (4.0, 10.0)], [(0.0, 0.0), (5.0, -5.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    keys = [("a", 10, square), ("a", 20, shifted), ("a", 30, five), ("b", 0, five), ("c", 7, square[:2])]
    k = spark.createDataFrame(keys, "m string, frame int, points array<struct<x:double,y:double>>")
    at = {("a", f): square for f in (0, 10)} | {("a", 15): [(x + 2, y) for x, y in square], ("a", 25): shifted, ("a", 26): five, ("a", 99): five, ("b", 50): five}
    rng = random.Random(1)
    rows = [(m, f, rng.uniform(-3, 16), rng.uniform(-6, 13)) for m, f in at for _ in range(20)] + [("a", 15, 1.5, 5.0), ("a", 15, 2.5, 5.0), ("a", 15, 2.0, 5.0), ("c", 7, 1.0, 1.0), ("none", 1, 1.0, 1.0)]
    got = field.on_field(spark.createDataFrame(rows, "m string, frame int, x double, y double"), k, ["m"], F.col("x"), F.col("y"), 0.6, "frame").collect()
    assert len(got) == len(rows)
    for r in got:
        polygon = at.get((r.m, r.frame))
        if polygon is None:
            assert r.inside_by is None and not r.on_field
        else:
            d = plain_signed((r.x, r.y), polygon)
            assert abs(r.inside_by - d) < 1e-9 and (abs(d + 0.6) < 1e-9 or r.on_field == (d >= -0.6))
    edge = {r.x: r.inside_by for r in got if r.m == "a" and r.frame == 15 and r.y == 5.0}
    assert edge[1.5] == -0.5 and edge[2.5] == 0.5 and edge[2.0] == 0


def test_reprojection_and_segments(spark):
    eye = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    flat = [*eye[:8], 0.0]
    points = [(f, float(x), float(y), x + (1.0 if f == 3 and x else 0.1), float(y)) for f in range(8) for x in (0, 5) for y in (0, 5) if not (f == 6 and x)]
    h = [(f, flat if f == 4 else eye) for f in range(8) if f != 5]
    got = reviews.reprojection(spark.createDataFrame(points, "frame int, x double, y double, wx double, wy double"), spark.createDataFrame(h, "frame int, h array<double>"), [])
    back = {r.frame: r for r in got.collect()}
    assert [back[f].reason for f in range(8)] == [None, None, None, "reprojection_error", "point_at_infinity", "no_matrix", "too_few_points", None]
    assert back[0].rmse == 0.1 and back[3].max_error == 1.0 and back[3].rmse == round(math.sqrt((2 * 1.0 + 2 * 0.01) / 4), 6)
    spans = sorted((r.start_frame, r.end_frame, r.frames) for r in reviews.accepted_segments(got, []).collect())
    assert spans == [(0, 2, 3), (7, 7, 1)]


# ---- identity ----


def test_ids_apart_and_those_that_may_merge(spark):
    rows = [(7, g, f, float(x), 0.0) for g, x in ((1, 0), (2, 3), (3, 1)) for f in range(10)] + [(7, 4, f, 9.0, 0.0) for f in range(2)] + [(8, 5, f, 0.0, 0.0) for f in range(10)]
    got = identity.apart(spark.createDataFrame(rows, "number int, gid int, frame int, x double, y double"), ["number"], 5, 2.0).collect()
    assert [(r.number, r.a, r.b, r.frames, r.separation) for r in got] == [(7, 1, 2, 10, 3.0)]
    ids = spark.createDataFrame([(1, "red", "p1", "7"), (2, "red", None, ""), (3, "blue", "p2", "7"), (4, " ", "p1", "8")], "gid int, team string, person string, number string")
    seen = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 5), (3, 9), (4, 7)], "gid int, frame int")
    got = {(r.gid, r.candidate): (r.compatible, r.linked, r.reasons) for r in identity.merge_candidates(ids, seen, ids.where("gid in (1, 2)")).collect()}
    assert got == {
        (1, 2): (False, False, "together:1"), (1, 3): (False, False, "team;person"), (1, 4): (False, True, "number"),
        (2, 1): (False, False, "together:1"), (2, 3): (False, False, "team"), (2, 4): (True, False, ""),
    }


def test_two_modes_and_an_open_rest(spark):
    rng = np.random.default_rng(2)
    centres = {"red": [1.0, 0, 0], "blue": [0, 1.0, 0], "keeper": [0, 0, 1.0]}
    rows = [(n, (np.array(c) + rng.normal(0, 0.03, 3)).tolist()) for n, c in centres.items() for _ in range({"red": 120, "blue": 90, "keeper": 12}[n])]
    df = spark.createDataFrame(rows, "who string, v array<double>")
    model = clusters.open_modes(df, "v", 3)
    m = model.orderBy("mode").collect()
    assert [r.n for r in m] == [120, 90] and np.allclose([r.centre for r in m], [centres["red"], centres["blue"]], atol=0.02)
    far = np.array([np.linalg.norm(np.array(v) - m[0].centre) for n, v in rows if n == "red"])
    assert abs(m[0].radius - np.quantile(far, 0.97)) < 1e-9
    got = {(r.who, r.mode): r["count"] for r in clusters.assigned(df, "v", model).groupBy("who", "mode").count().collect()}
    assert got["red", 0] >= 115 and got["blue", 1] >= 85 and got["keeper", -1] == 12 and ("red", 1) not in got
    one = df.where("who <> 'blue'")
    assert clusters.open_modes(one, "v", 2).count() == 0  # the second mode is too small
    assert {r.mode for r in clusters.assigned(df, "v", clusters.open_modes(one, "v", 2)).collect()} == {-1}
    with pytest.raises(ValueError):
        clusters.open_modes(df.limit(29), "v", 3)


# ---- compilations and event tables ----


def test_boxes_in_a_compilation(spark):
    frames = [(1, f) for f in [*range(0, 30), *range(200, 230)]]
    line = events.compilation(events.seen_times(spark.createDataFrame(frames, "person int, frame int"), "person", 30.0), "person").orderBy("source_start").collect()
    assert [(round(r.source_start, 4), round(r.source_end, 4), round(r.compilation_start, 4)) for r in line] == [(0.0, 1.35, 0.0), (round(200 / 30 - 0.35, 4), round(230 / 30 + 0.35, 4), 1.35)]
    boxes = spark.createDataFrame([(1, f, 5.0) for f in (0, 1, 40, 42, 100, 190, 210, 240)] + [(2, 0, 1.0)], "person int, frame int, x double")
    got = sorted((r.frame, r.source_time, r.time) for r in events.retimed(boxes, spark.createDataFrame(line), "person", 30.0).collect())
    assert got == [(0, 0.0, 0.0), (40, 1.333, 1.333), (190, 6.333, 1.367), (210, 7.0, 2.033), (240, 8.0, 3.033)]


def test_actors_are_sure_only_if_close_or_ahead(spark):
    e = spark.createDataFrame([(1, 100), (2, 200), (3, 300), (4, 400)], "event_id int, frame int")
    ball = spark.createDataFrame([(100, 5.0, 5.0, True), (200, 5.0, 5.0, True), (300, 5.0, 5.0, True), (400, 5.0, 5.0, False)], "frame int, bx double, by double, reliable boolean")
    box = lambda f, g, away: (f, g, 5.0 + 0.2 + away * 2, 3.0, 1.0, 2.0)
    boxes = spark.createDataFrame([box(100, 1, 0.0), box(100, 2, 0.05), box(200, 1, 0.5), box(200, 2, 0.55), box(300, 1, 2.0), box(400, 1, 0.0)], "frame int, gid int, x double, y double, w double, h double")
    got = {r.event_id: r for r in timeline.attributed(e, ball, boxes, 10.0).collect()}
    assert [(got[k].primary_global_id, got[k].actor_status, got[k].actor_reason) for k in (1, 2, 3, 4)] == [
        (1, "auto", "nearest_player_before_event_peak"), (1, "review", "nearest_player_before_event_peak"), (None, "review", "nearest_player_too_far_from_ball"), (None, "review", "no_reliable_ball_player_overlap"),
    ]
    assert [c.global_id for c in got[2].actor_candidates] == [1, 2] and got[2].actor_candidates[0].attribution_score == round(math.exp(-0.5), 4) and got[4].actor_candidates == []


def test_a_ledger_meets_the_nearest_event_within_its_tolerance(spark):
    ledger = spark.createDataFrame([(1, "00:10", "射门", 1), (2, "0:30", "护球", 1), (3, "bad", "x", 1), (4, "100", "传球", 1), (5, "10", "", 2)], "event_id int, anchor string, tags string, m int").withColumn("start", F.col("anchor")).withColumn("end", F.col("anchor"))
    found = spark.createDataFrame([(1, 0, 9.0, 4, [4, 6], 50.0), (1, 1, 11.0, 5, [5], 80.0), (1, 2, 31.0, None, [8], 70.0), (1, 3, 31.0, 9, [9], 20.0)], "m int, order int, at double, primary int, candidates array<int>, score double")
    who = spark.createDataFrame([(4, "red_10", 10)], "gid int, player_id string, number int")
    got = {r.event_id: (r.anchor_time, r.event_type, r.primary_global_id, r.secondary_global_id, r.confidence, r.delta, r.actor_status[:5], r.identity_status, r.jersey_number) for r in timeline.annotated(ledger, found, who, 2.0, ["m"]).collect()}
    assert got == {
        1: (10.0, "shot", 4, 6, 0.5, 1.0, "provi", "eligible_confirmed", 10), 2: (30.0, "ball_protection", None, 8, 0.7, 1.0, "provi", "not_confirmed", None), 3: (None, "key_action", None, None, 0.0, None, "unass", "not_confirmed", None),
        4: (100.0, "pass_or_distribution", None, None, 0.0, None, "unass", "not_confirmed", None), 5: (10.0, "key_action", None, None, 0.0, None, "unass", "not_confirmed", None),
    }


# ---- packages ----

GOOD = {
    "players": [("a",), ("b",)], "identities": [("a", 1, "eligible_confirmed", 7), ("b", 2, "unreadable", None)], "summaries": [("a", 7.0, 900.0, 3), ("b", 14.9, 0.0, 0)], "events": [("a", 1, "a1.mp4", 1), ("b", 1, "b1.mp4", 2), ("b", 2, "b1.mp4", 2)],
    "files": [(p, f"{p}.png", "heatmap", 9, f"{p}p", 600, 400, None) for p in "ab"] + [(p, f"{p}1.mp4", "clip", 9, f"{p}c", None, None, 7.75) for p in "ab"], "listed": [("a", "a.png", "ap"), ("b", "b1.mp4", "bc")],
}
SCHEMAS = {
    "players": "player string", "identities": "player string, global_id int, status string, number int", "summaries": "player string, max_speed double, distance double, sprints int", "events": "player string, event_id int, file string, total int",
    "files": "player string, file string, kind string, length int, sha256 string, width int, height int, seconds double", "listed": "player string, file string, sha256 string",
}
BROKEN = {
    "identity": {"identities": [("a", 1, "eligible_confirmed", None), ("b", 2, "unreadable", None)]}, "running": {"summaries": [("a", 15.0, 900.0, 3), ("b", 1.0, 0.0, 0)]}, "heatmap": {"files": [("a", "a.png", "heatmap", 9, "ap", 600, 399, None), *GOOD["files"][1:]]},
    "clips": {"files": [*GOOD["files"][:3], ("b", "b1.mp4", "clip", 9, "bc", None, None, 8.5)]}, "events": {"events": [("a", 1, "lost.mp4", 1), *GOOD["events"][1:]]}, "manifest": {"listed": [("a", "a.png", "other")]}, "folders": {"players": []},
}


@pytest.mark.parametrize("rule", [None, *BROKEN])
def test_each_rule_is_broken_by_its_package(spark, rule):
    t = GOOD | BROKEN.get(rule, {})
    got = reviews.package(*[spark.createDataFrame(t[n], SCHEMAS[n]) for n in SCHEMAS]).collect()
    assert len(got) == 7 and {r.rule for r in got if not r.passed} == ({rule} - {None}) and all((r.failures == 0) == r.passed == (r.examples == "") for r in got)


# ---- many matches in one table ----


def test_two_copies_of_a_match_have_their_own_results(spark):
    from touchline.operators import possession, running

    rng = random.Random(8)
    players = [(g, f, 20 + 6 * math.sin(f / 9 + g), 10 + 4 * math.cos(f / 7 + 2 * g)) for g in range(4) for f in range(300) if rng.random() < 0.97]
    ball = [(f, 20 + 6 * math.sin(f / 23), 10 + 4 * math.cos(f / 17)) for f in range(300) if rng.random() < 0.9]
    p = spark.createDataFrame(players, "gid int, frame int, x double, y double")
    b = spark.createDataFrame(ball, "frame int, bx double, bz double")
    t = spark.createDataFrame([(g, f"t{g % 2}") for g in range(4)], "gid int, team string")
    two = lambda d: d.withColumn("match", F.lit(1)).unionByName(d.withColumn("match", F.lit(2)))

    def chain(p, b, t, keys):
        iv = possession.intervals(possession.nearest_player(p, b, 5.0, keys), 2, keys)
        tr = possession.classified(possession.transitions(iv, 15, keys=keys), t, 0.5, keys)
        back = events.counterpress(tr.select(*keys, F.col("end_frame").alias("frame"), "from_team", "to_team"), 100, keys)
        path = running.timeseries(p, 10.0, 5, keys)
        return [iv.drop("mean_d"), tr, back, possession.team_summary(tr, keys), possession.owners(iv, keys), path, running.summary(path, 2.0, keys), running.bouts(path, 2.0, 2, 2, keys), running.rolling_peak(path.where("speed is not null"), 3, keys)]

    one, many = chain(p, b, t, ()), chain(two(p), two(b), two(t), ("match",))
    for x, y in zip(one, many):
        want = sorted(map(tuple, x.collect()), key=repr)
        for m in (1, 2):
            got = sorted(map(tuple, y.where(F.col("match") == m).select(x.columns).collect()), key=repr)
            assert got == want and len(want) > 1, x.columns


def test_small_rules(spark):
    from touchline.functions import geom, scalars
    from touchline.operators import tracks

    row = spark.range(1)
    with pytest.raises(Exception, match="infinity"):
        row.select(geom.project(F.lit(1.0), F.lit(1.0), [F.lit(v) for v in (1.0, 0, 0, 0, 1, 0, 0, 0, 0.0)], strict=True)[0]).collect()
    said = {"con?nus:*a/ ": "con_nus_a_", " . ": "new_venue", "x": "x", "a\\b": "a_b"}
    got = spark.createDataFrame([(k,) for k in said], "t string").select("t", scalars.venue(F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == said
    e = events.goal_zone(F.col("x"), F.col("y"), 105.0, 68.0)
    points = [(2.6, 34.0), (2.7, 34.0), (102.5, 30.4), (102.5, 30.3), (0.0, 37.6)]
    assert [r[0] for r in spark.createDataFrame(points, "x double, y double").select(e).collect()] == [True, False, True, False, True]
    det = spark.createDataFrame([(1, 1), (1, 2), (9, 3)], "gid int, k int")
    assert tuple(tracks.remap_counts(det, det.where("gid = 1").select("gid")).first()) == (2, 1)
