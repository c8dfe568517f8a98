"""What op6 leaves out before it sorts suffixes, and texts that are hashed together, against plain versions."""

import random

import numpy as np
import pytest

from touchline.llm import suffixes


def context(rng, key, number, core, left, right, length=40):
    """A row as sorted_hits() gets it: left and right are the bytes around the core."""
    text = left + core + right
    return key, number, 0, len(left), len(core), len(text) - length + 1, text


def repeated(rows, length):
    """(key, ctx, window) of the windows that another context of the key has, at any place."""
    where = {}
    for key, ctx, _, _, _, n, text in rows:
        for s in range(n):
            where.setdefault((key, text[s : s + length]), set()).add(ctx)
    return {(key, ctx, s) for key, ctx, _, _, _, n, text in rows for s in range(n) if len(where[key, text[s : s + length]]) > 1}


@pytest.mark.parametrize("step", [1, 3, 8])
def test_only_windows_that_may_repeat_are_sorted(monkeypatch, step):
    monkeypatch.setattr(suffixes, "STEP", step)
    rng = random.Random(step)
    some = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    rows, far = [], []
    for key in range(-20, 60):
        core = some(20)
        sides = [(some(20), some(20)) for _ in range(rng.randint(1, 3))]
        for number in range(rng.randint(2, 6)):
            (a, _), (_, b) = rng.choice(sides), rng.choice(sides)
            # like another one's for some bytes from the core on, on either side
            k, m = rng.randint(0, 20), rng.randint(0, 20)
            a, b = some(20 - k) + a[20 - k :], b[:m] + some(20 - m)
            rows.append(context(rng, key, number, core, a[rng.randint(0, 5) :], b[: rng.randint(15, 20)]))
    rows = [r for r in rows if r[5] > 0]
    for key in range(100, 120):
        core = some(20)
        far += [context(rng, key, number, core, bytes([65 + number]) * 20, bytes([65 + number]) * 20) for number in range(4)]
    got = suffixes.trimmed(rows + far, 40)
    assert {r[0] for r in got} <= set(range(-20, 60))  # contexts that share their core only aren't sorted
    kept = {(r[0], r[1], r[7] + s) for r in got for s in range(r[5])}
    want = repeated(rows, 40)
    assert want and want <= kept and (step > 1 or len(kept) < sum(r[5] for r in rows) // 2)
    of = {r[:2]: r for r in rows}
    for key, ctx, _, core, width, n, text, first in got:
        whole = of[key, ctx]
        assert text == whole[6][first : first + n - 1 + 40] and core == whole[3] - first and width == whole[4]
    assert suffixes.trimmed(far, 40) == []


@pytest.mark.parametrize("step", [1, 8])
def test_hits_of_hot_cores(spark, monkeypatch, step):
    """Windows of contexts in part alike, trimmed and sorted, are those of the plain version."""
    monkeypatch.setattr(suffixes, "STEP", step)
    rng = random.Random(9)
    some = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    rows = []
    for key in range(30):
        core, left, right = b"-" * 20, some(20), some(20)
        for number in range(rng.randint(1, 5)):
            k, m = rng.randint(5, 20), rng.randint(5, 20)
            rows.append(context(rng, key, number, core, some(20 - k) + left[20 - k :], right[:m] + some(20 - m)))
    df = spark.createDataFrame(rows, "key long, ctx long, kinds long, core int, core_len int, n int, bytes binary")
    got = {(r.key, r.ctx, s) for r in suffixes.sorted_hits(df, 40).collect() for s in range(r.a, r.b)}
    assert got and got == repeated(rows, 40)


def anchors_of(x, bounds, length, k):
    """(text, window) -> anchor's place and hash, of each window."""
    of, s, n, c, key, _ = suffixes.anchored(x, bounds, length, k)
    out = {}
    for j, a, m, core, h in zip(of.tolist(), s.tolist(), n.tolist(), c.tolist(), key.tolist()):
        for w in range(a, a + m):
            assert (j, w) not in out
            out[j, w] = core, h
    return out


@pytest.mark.parametrize("part", [60, 100, 1 << 20])
def test_texts_are_hashed_together(monkeypatch, part):
    """Windows of joined texts have the anchors that each text alone gives them, and none goes over an end; short texts need few calls."""
    rng = random.Random(part)
    texts = [bytes(rng.choice(b"xyz ") for _ in range(n)) for n in (0, 5, 39, 40, 41, 0, 0, 300, 12, 90, 700, 1, 40, 0)]
    texts += [texts[7], texts[10], b"x" * 120]
    alone = {}
    for j, t in enumerate(texts):
        got = anchors_of(np.frombuffer(t, dtype=np.uint8), np.array([0, len(t)]), 40, 20)
        assert sorted(w for _, w in got) == list(range(max(len(t) - 39, 0)))
        alone |= {(j, w): v for (_, w), v in got.items()}
    monkeypatch.setattr(suffixes, "BYTES", part)
    for stretch in (1, 100, 1 << 17):
        monkeypatch.setattr(suffixes, "STRETCH", stretch)
        together = {}
        for first, x, bounds in suffixes.joined(texts):
            together |= {(first + j, w): v for (j, w), v in anchors_of(x, bounds, 40, 20).items()}
        assert together == alone
        words = [len(t.split()) for t in texts]
        for first, x, bounds in suffixes.joined(texts, b" "):
            codes, start = suffixes.word_codes(x)
            per = np.diff(np.searchsorted(start, bounds)).tolist()
            assert per == words[first : first + len(per)]
            assert codes.tobytes() == b"".join(suffixes.word_codes(t)[0].tobytes() for t in texts[first : first + len(per)])
    assert len(list(suffixes.joined([b"a short text"] * 1000))) == 1
