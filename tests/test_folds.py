"""Order-dependent operators against plain versions, on tables made here."""

import numpy as np

from touchline.operators import clusters, identity, tracklets


def merged(own, pairs, floor, target):
    root = {g: g for g, _, _ in own}
    group = {g: ({g}, set(f), {t} - {None}) for g, t, f in own}
    for s, a, b in sorted(pairs, reverse=True):
        if len(group) <= target or s < floor:
            break
        a, b = root[a], root[b]
        if a == b or group[a][1] & group[b][1] or len(group[a][2] | group[b][2]) > 1:
            continue
        if len(group[a][1]) < len(group[b][1]):
            a, b = b, a
        gone = group.pop(b)
        group[a] = tuple(x | y for x, y in zip(group[a], gone))
        root |= {g: a for g in gone[0]}
    return root


def test_merge(spark):
    rng = np.random.default_rng(2)
    tracks, links, want = [], [], {}
    for m in range(4):
        own = [(g, [None, 0, 1][int(rng.integers(0, 3))], sorted({int(f) for f in rng.integers(0, 40, rng.integers(1, 6))})) for g in range(m * 100, m * 100 + 14)]
        pairs = [(round(float(rng.random()), 2), a[0], b[0]) for k, b in enumerate(own) for a in own[:k] if not set(a[2]) & set(b[2])]
        tracks += [(m, *t) for t in own]
        links += [(m, a, b, s) for s, a, b in pairs]
        want |= merged(own, pairs, 0.2, 3)
    t = spark.createDataFrame(tracks, "match long, gid long, team int, frames array<int>")
    p = spark.createDataFrame(links, "match long, a long, b long, similarity double")
    got = {r.gid: r.root for r in tracklets.merged(t, p, 0.2, 3).collect()}
    assert got == want and len(set(got.values())) < len(got)


def test_a_change_of_appearance_is_cut_where_it_lasts(spark):
    rng = np.random.default_rng(0)
    base, other = np.array([1.0, 0, 0, 0]), np.array([0, 1.0, 0, 0])
    rows = []
    for gid, at in ((1, 40), (2, None)):
        for f in range(80):
            x = (other if at is not None and f >= at else base) + rng.normal(0, 0.01, 4)
            rows.append((gid, f, x.tolist()))
    for f in range(80):  # an excursion that comes back within the horizon
        rows.append((3, f, ((other if 30 <= f < 45 else base) + rng.normal(0, 0.01, 4)).tolist()))
    rows += [(4, 0, None), (4, 1, [0.0] * 4), (4, 2, [float("nan")] * 4)]
    df = spark.createDataFrame(rows, "gid int, frame int, feature array<double>")
    got = identity.local_changes(df).collect()
    assert [(r.gid, r.cut_frame) for r in got] == [(1, 40)] and got[0].distance > 1.2


def test_modes_are_the_clusters(spark):
    rng = np.random.default_rng(1)
    centres = np.array([[0.0, 0.0], [10.0, 0.0], [0.0, 10.0]])
    rows = [(k, (centres[k % 3 if k % 4 else 0] + rng.normal(0, 0.3, 2)).tolist()) for k in range(240)] + [(999, None)]
    got = clusters.modes(spark.createDataFrame(rows, "k int, v array<double>"), "v", 3).orderBy("mode").collect()
    assert [r.mode for r in got] == [0, 1, 2] and sum(r.n for r in got) == 240 and abs(sum(r.share for r in got) - 1) < 1e-5
    assert np.allclose(sorted(r.centre for r in got), sorted(centres.tolist()), atol=0.3)
