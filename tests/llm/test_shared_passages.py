"""Passages of over 50 words that documents share, against a plain version."""

import random

import pytest

from touchline.llm import suffixes


def plain(rows, words=51):
    seen = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - words + 1):
            seen.setdefault(tuple(w[k : k + words]), set()).add(i)
    many = {g for g, ids in seen.items() if len(ids) > 1}
    return {i for i, t in rows if any(tuple((t or "").encode().split()[k : k + words]) in many for k in range(len((t or "").split()) - words + 1))}


@pytest.mark.parametrize("group", [2, 500])
def test_shared_passages(spark, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP", group)
    rng = random.Random(6)
    word = lambda: f"w{rng.randint(0, 4000)}"
    text = lambda n: [word() for _ in range(n)]
    a, b = text(51), text(50)  # one passage long enough, one not
    rows = [text(120) for _ in range(6)]
    rows += [text(rng.randint(0, 60)) + a + text(rng.randint(0, 60)) for _ in range(7)]
    rows += [text(30) + b + text(30) for _ in range(4)]
    line = text(20)
    rows += [line * 8, ["the"] * 90, text(49), [], text(51) * 2]
    rows = [(i, (" " if i % 2 else "\n").join(w)) for i, w in enumerate(rows)] + [(90, None), (91, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    assert want == set(range(6, 13))
    got = suffixes.op6_suffixes(df).collect()
    assert {r.doc_id for r in got if r.shared_passage} == want and len(got) == len(rows)


@pytest.mark.parametrize("rows", [1, 3, 7, 1000])
def test_meetings_over_batches(spark, rows):
    """Groups that go over several Arrow batches, of one document or of many."""
    rng = random.Random(rows)
    found = [(k, c, w, rng.randint(0, 9)) for k in range(12) for c in range(rng.randint(1, 6)) for w in {k * 100 + rng.randint(0, 1 + k // 3) for _ in range(rng.randint(1, 12))}]
    found += [(50, 7, 5, n) for n in range(15)] + [(51, c, 5, c) for c in range(9)] + [(52, c, 5 + c // 8, c) for c in range(9)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        got = suffixes.meetings(spark.createDataFrame(found, "key long, ctx long, who long, at long")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    many = lambda same: len({r[2] for r in found if same(r)}) > 1
    want = [(k, w, at, many(lambda r: r[:2] == (k, c))) for k, c, w, at in found if many(lambda r: r[0] == k)]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("rows", [1, 4, 1000])
def test_contexts_are_weighed_over_batches(spark, monkeypatch, rows):
    """Sums of contexts, also of keys with so many that they don't wait."""
    monkeypatch.setattr(suffixes, "GROUP", 3)
    rng = random.Random(rows)
    runs = [(rng.choice([None, d]), 1, 2, 3, 4, 5, k, c, rng.randint(1, 2)) for k in range(9) for c in range(k) for d in range(rng.randint(1, 4))]
    runs += [(7, 1, 2, 3, 4, 5, 40, c, 1) for c in range(60)] + [(None, 1, 2, 3, 4, 5, 41, 0, 1)] * 30 + [(8, 1, 2, 3, 4, 5, 42, 0, 1)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        df = spark.createDataFrame(runs, "doc_id long, row long, s long, n int, core long, core_len int, key long, ctx long, w long")
        got = {(r.key, r.ctx): (r.w, r.kinds, r.least) for r in suffixes.weighed(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    w: dict = {}
    for *_, k, c, x in runs:
        w.setdefault(k, {}).setdefault(c, 0)
        w[k][c] += x
    want = {(k, c): (x, len(v), min(v.values())) for k, v in w.items() for c, x in v.items() if sum(v.values()) > 1}
    assert got.keys() == want.keys() and (42, 0) not in got
    for at, (x, kinds, least) in want.items():
        assert got[at] == (x, kinds, least) or (kinds > 3 and got[at] == (x, 4, 1)), at
