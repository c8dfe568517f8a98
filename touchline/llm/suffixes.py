"""Removal of long repeated substrings, exact to the byte, by suffix arrays of candidate contexts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batched, cut, sized

#: Distinct contexts of one core that are sorted in one task at most; cores with more are split into longer ones.
GROUP = 500
#: Contexts' symbols sorted (and bytes trimmed) at once in a task, bytes of text hashed at once.
SYMBOLS, BYTES = 400_000, 1 << 20
#: Bytes from which short texts are hashed together.
STRETCH = 1 << 17
#: Bytes by which trimmed() looks further away from a core.
STEP = 8
#: Words of a text hashed at once.
WORDS = 1 << 17
#: Strings below which they are emitted one by one.
FEW = 200
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:8], "little") | 1 for b in range(256)], dtype=np.uint64)


# ---- suffix arrays ----


def suffix_arrays(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sa, rank start) of many strings at once: text[starts[k]:starts[k + 1]] holds string k, sa the places of its suffixes in order.

    Grouping in linear time. A group holds suffixes that share a prefix, and groups are ordered. First, groups are taken from
    the last to the first: each suffix's previous smaller suffix (the nearest on its left in a lower group) is found along
    the pointers already known, and those suffixes, which have the group's prefix after their own, leave their groups for new ones
    just above; the more often one is pointed at, the higher. At the end each group shares one Lyndon prefix. Then each group's
    order is emitted from the first suffix on: what stands before a placed suffix, and what that points to, takes the next place of its group.
    All strings take their steps at the same time, one group or place each; nothing is renamed or sorted again.
    """
    n, m = len(text), len(starts) - 1
    owner = np.repeat(np.arange(m), np.diff(starts))
    # a string's own first place in sa stands for a border below all symbols, on the left of its first suffix
    sa = np.lexsort((text, owner))
    pos = np.empty(n, dtype=np.int64)
    pos[sa] = np.arange(n)
    head = np.concatenate(([True], (text[sa][1:] != text[sa][:-1]) | (owner[sa][1:] != owner[sa][:-1])))
    first = np.flatnonzero(head)
    size = np.zeros(n, dtype=np.int64)
    size[first] = np.diff(np.append(first, n))
    group = np.empty(n, dtype=np.int64)
    group[sa] = first[np.cumsum(head) - 1]
    prev, moved = np.full(n + 1, -1, dtype=np.int64), np.zeros(n, dtype=bool)
    border = starts[:-1]
    low = np.append(group, -1)  # place -1 is every border
    at = low[sa[starts[1:] - 1]]  # each string's current group
    base = border.copy()
    while len(at):
        k = size[at]
        order = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        i = sa[np.repeat(at, k) + order]
        mine = np.repeat(at, k)
        to = i - 1
        to[i == np.repeat(base, k)] = -1
        prev[i] = to
        while True:
            up = low[to] >= mine
            if not up.any():
                break
            to = np.where(up, prev[to], to)
            prev[i] = to
        to = np.sort(to[to >= 0])
        if len(to):
            new = np.concatenate(([True], to[1:] != to[:-1]))
            u = to[new]
            count = np.diff(np.append(np.flatnonzero(new), len(to)))
            by = np.lexsort((count, low[u]))
            u, count = u[by], count[by]
            g = low[u]
            edge = np.concatenate(([True], g[1:] != g[:-1]))
            heads = np.flatnonzero(edge)
            parts = np.diff(np.append(heads, len(g)))
            gone = np.repeat(parts, parts)
            spot = g + size[g] - gone + np.arange(len(g)) - np.repeat(heads, parts)
            was, moved[u] = pos[u], True
            stay = sa[spot]
            stay = stay[~moved[stay]]
            free = was[was < g + size[g] - gone]
            # both follow the groups' order, and there are as many of each in a group
            free = free[np.argsort(free, kind="stable")]
            sa[free], pos[stay] = stay, free
            sa[spot], pos[u] = u, spot
            moved[u] = False
            run = edge | np.concatenate(([True], count[1:] != count[:-1]))
            r = np.flatnonzero(run)
            size[g[heads]] -= parts
            size[spot[r]] = np.diff(np.append(r, len(g)))
            low[u] = np.repeat(spot[r], np.diff(np.append(r, len(g))))
        more = at > base
        at, base = low[sa[at[more] - 1]], base[more]
    # emission
    fill = low[:n].copy()  # by place: where the group begins
    if m < FEW:
        return _emit(fill.tolist(), prev.tolist(), starts.tolist()), fill
    out = np.full(n, -1, dtype=np.int64)
    nxt = np.arange(n)  # by group: next free place
    done = np.zeros(n + 1, dtype=bool)
    done[-1] = True
    last = starts[1:] - 1
    out[nxt[fill[last]]] = last
    nxt[fill[last]] += 1
    done[last] = True
    read, end, base = border.copy(), starts[1:].copy(), border.copy()
    j = np.where(out[read] > base, out[read] - 1, -1)
    while len(read):
        put = ~done[j]
        if put.any():
            q = j[put]
            out[nxt[fill[q]]] = q
            nxt[fill[q]] += 1
            done[q] = True
            j[put] = prev[q]
        step = ~put
        if step.any():
            read[step] += 1
            live = read < end
            if not live.all():
                read, end, base, j, step = read[live], end[live], base[live], j[live], step[live]
            s = out[read[step]]
            j[step] = np.where(s > base[step], s - 1, -1)
    return out, fill


def _emit(fill: list[int], prev: list[int], starts: list[int]) -> np.ndarray:
    """suffix_arrays()' emission, string by string: faster where few strings could take their steps together."""
    n = starts[-1]
    out, nxt, done = [-1] * n, list(range(n)), [False] * n
    for base, end in zip(starts, starts[1:]):
        j = end - 1
        for read in range(base, end):
            while j >= base and not done[j]:
                q = fill[j]
                out[nxt[q]] = j
                nxt[q] += 1
                done[j] = True
                j = prev[j]
            j = out[read] - 1
        while j >= base and not done[j]:
            out[nxt[fill[j]]] = j
            nxt[fill[j]] += 1
            done[j] = True
            j = prev[j]
    return np.array(out)


def shared_prefix(text: np.ndarray, sa: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """Whether each place's suffix shares its first `least` symbols with a suffix next to it in its string's order."""
    n = len(text)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    end = starts[1:][owner]
    a, b = sa[:-1], sa[1:]
    ok = (owner[a] == owner[b]) & (a + least <= end[a]) & (b + least <= end[b])
    a, b = a[ok], b[ok]
    # places where both go on alike for `least` symbols: compared in steps, most pairs part early
    for k in range(0, least, 8):
        if not len(a):
            break
        w = np.arange(k, min(k + 8, least))
        same = (text[a[:, None] + w] == text[b[:, None] + w]).all(axis=1)
        a, b = a[same], b[same]
    hit = np.zeros(n, dtype=bool)
    hit[a] = hit[b] = True
    return hit


# ---- windows and their anchors ----


class Powers:
    """Powers of BASE and of its inverse, and hashes of stretches of one byte string by prefix sums."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> None:
        if len(cls.up) < n:
            n = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                cls.up = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, BASE, dtype=np.uint64))))
                cls.down = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, _INVERSE, dtype=np.uint64))))


class Hashed:
    def __init__(self, x: np.ndarray):
        Powers.upto(len(x) + 1)
        self.sums = np.zeros(len(x) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[x] * Powers.up[: len(x)], out=self.sums[1:])

    def of(self, a, b) -> np.ndarray:
        """64-bit hashes of x[a:b], by content and length."""
        return self._mixed((self.sums[b] - self.sums[a]) * Powers.down[a], b - a)

    def all(self, k: int) -> np.ndarray:
        """of() each stretch of k bytes, from the first on."""
        n = len(self.sums) - k
        return self._mixed((self.sums[k:] - self.sums[:n]) * Powers.down[:n], k)

    @staticmethod
    def _mixed(h: np.ndarray, size) -> np.ndarray:
        h ^= (np.atleast_1d(size).astype(np.uint64) + np.uint64(1)) * BASE
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        h *= BASE
        return h ^ (h >> np.uint64(32))


def slide_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of w."""
    m, k = v, 1
    while 2 * k <= w:
        m, k = np.minimum(m[:-k], m[k:]), 2 * k
    return np.minimum(m[: len(v) - w + 1], m[w - k : w - k + len(v) - w + 1])


def joined(texts: Iterable[bytes], between: bytes = b"") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, bounds) of about STRETCH bytes of texts at once, `between` after each but the last: numpy's calls would take longer than their work on one short text."""
    held: list[bytes] = []
    first = total = 0
    for k, t in enumerate(texts):
        held.append(t)
        total += len(t)
        if total >= STRETCH:
            yield first, np.frombuffer(between.join(held), dtype=np.uint8), np.cumsum([0, *(len(t) + len(between) for t in held)])
            held, first, total = [], k + 1, 0
    if held:
        yield first, np.frombuffer(between.join(held), dtype=np.uint8), np.cumsum([0, *(len(t) + len(between) for t in held)])


def anchored(x: np.ndarray, bounds: np.ndarray, length: int, k: int) -> list[np.ndarray]:
    """(text, s, n, core start, core hash, context hash) of runs of windows of the texts x[bounds[j]:bounds[j + 1]]: the n windows of `length` bytes from s on whose anchor is the same.

    A window's anchor is the stretch of k bytes in it with the least hash, the first one on ties; equal windows have
    equal anchors at the same place. The context is what the run's windows cover. Places count from a text's start. Long texts are taken in parts; runs
    may then be cut in two, which changes no window's anchor. Windows that go over a text's end don't count.
    """
    w = length - k + 1
    out = [[np.empty(0, dtype=t) for t in (np.int64,) * 4 + (np.uint64,) * 2]]
    for p in range(0, len(x) - length + 1, BYTES):
        y = x[p : p + BYTES + length - 1]
        h = Hashed(y)
        value = h.all(k)
        best = slide_min((value >> np.uint64(23) << np.uint64(23)) | np.arange(len(value), dtype=np.uint64), w)
        inside = np.ones(len(best), dtype=bool)
        for end in (bounds[1:] - p).tolist():
            inside[max(end - length + 1, 0) : max(end, 0)] = False
        place = np.flatnonzero(inside)
        if not len(place):
            continue
        at = (best[place] & np.uint64((1 << 23) - 1)).astype(np.int64)
        head = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        s, n, at = place[head], np.diff(np.append(head, len(at))), at[head]
        of = np.searchsorted(bounds, s + p, side="right") - 1
        out.append([of, s + p - bounds[of], n, at + p - bounds[of], value[at], h.of(s, s + n - 1 + length)])
    return [np.concatenate(c) for c in zip(*out)]


RUN = "doc_id long, row long, s long, n int, core long, core_len int, key long, ctx long"


def _runs(doc_ids, rows, got: list) -> pa.RecordBatch:
    """got: (index of the document or of each run's, s, n, core start, core length, key, ctx)."""
    if got:
        k = np.concatenate([np.full(len(g[1]), g[0]) for g in got])
        s, n, c, w, key, ctx = (np.concatenate([np.broadcast_to(g[j], len(g[1])) for g in got]) for j in range(1, 7))
    else:
        k = s = n = c = w = np.empty(0, dtype=np.int64)
        key = ctx = np.empty(0, dtype=np.uint64)
    return pa.RecordBatch.from_arrays(
        [doc_ids.take(pa.array(k)), rows.take(pa.array(k)), pa.array(s, type=pa.int64()), pa.array(n.astype(np.int32)), pa.array((c - s).astype(np.int64)), pa.array(w.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64))],
        names=["doc_id", "row", "s", "n", "core", "core_len", "key", "ctx"],
    )


def data(text: str | bytes | None) -> bytes:
    return text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")


def runs(docs: DataFrame, length: int, core: int) -> DataFrame:
    """Anchored runs of every document (doc_id, row, text)."""

    def run(batches):
        for b in batches:
            got = []
            for k, x, bounds in joined(data(t.as_py()) for t in b.column(2)):
                of, s, n, c, key, ctx = anchored(x, bounds, length, core)
                got.append((k + of, s, n, c, core, key, ctx))
            yield _runs(b.column(0), b.column(1), got)

    return docs.mapInArrow(run, RUN)


def halved(s: np.ndarray, n: np.ndarray, core: np.ndarray, core_len: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(index, s, n, core start, core length) of runs' halves: windows with at least half of their free bytes on the core's left, and the others.

    core counts from the text's start. A half's core is longer by the bytes that all its windows have on that side; equal windows with equal cores at the same place stay in the same half.
    """
    free = length - core_len
    h = (free + 1) // 2
    edge = core - h  # the last window of the left half
    left, right = np.minimum(n, edge - s + 1), np.maximum(s, edge + 1)
    k = np.arange(len(s))
    a, b = left > 0, right < s + n
    return tuple(
        np.concatenate(x)
        for x in ((k[a], k[b]), (s[a], right[b]), (left[a], (s + n - right)[b]), (edge[a], core[b]), ((core_len + h)[a], (core_len + free - h + 1)[b]))
    )


def split_runs(held: DataFrame, length: int) -> DataFrame:
    """Runs of (doc_id, row, text, runs) cut in halves, each with a longer core."""

    def run(batches):
        for b in batches:
            got, weights = [], []
            for k, (t, rs) in enumerate(zip(b.column(2), b.column(3).to_pylist())):
                h = Hashed(np.frombuffer(data(t.as_py()), dtype=np.uint8))
                s, n, core, width, w = (np.array([r[c] for r in rs], dtype=np.int64) for c in ("s", "n", "core", "core_len", "w"))
                of, s, n, c, width = halved(s, n, s + core, width, length)
                got.append((k, s, n, c, width, h.of(c, c + width), h.of(s, s + n - 1 + length)))
                weights.append(w[of])
            out = _runs(b.column(0), b.column(1), got)
            yield out.append_column("w", pa.array(np.concatenate(weights) if weights else [], type=pa.int64()))

    return held.mapInArrow(run, f"{RUN}, w long")


# ---- the operator ----


def _same(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.row") == F.col(f"{b}.row"))


def with_text(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc_id, row, text, runs): the documents that have runs. Few runs are broadcast, by their counted number; else both sides are shuffled."""
    per = runs.groupBy("doc_id", "row").agg(F.collect_list(F.struct(*[c for c in runs.columns if c not in ("doc_id", "row")])).alias("runs"))
    return docs.alias("a").join(sized(per, 50_000).alias("b"), _same("a", "b")).select("a.doc_id", "a.row", "a.text", "b.runs")


def contexts(held: DataFrame, length: int) -> DataFrame:
    """(key, ctx, kinds, core, core_len, n, bytes) of the runs held."""

    def run(batches):
        for b in batches:
            rows = []
            for t, rs in zip(b.column(2), b.column(3).to_pylist()):
                x = data(t.as_py())
                rows += [(r["key"], r["ctx"], r["kinds"], r["core"], r["core_len"], r["n"], x[r["s"] : r["s"] + r["n"] - 1 + length]) for r in rs]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)], names=["key", "ctx", "kinds", "core", "core_len", "n", "bytes"])

    return held.mapInArrow(run, "key long, ctx long, kinds long, core long, core_len int, n int, bytes binary")


def trimmed(rows: list[tuple], length: int) -> list[tuple]:
    """Contexts (key, ctx, kinds, core, core length, n, bytes) of whole keys, each followed by the number of windows left off at its start: without the windows that no other context can have.

    How far from its core a context goes on like some other one of its key, to the left and to the right, is bounded in steps, by hashes. A window that reaches beyond either bound has no
    equal, and a context without other windows is left out. Which of the rest are repeated is for the suffix array to say: what is shared on the left and on the right may be shared with different contexts.
    """
    key, core, width, n, size = (np.array(c, dtype=np.int64) for c in zip(*((r[0], r[3], r[4], r[5], len(r[6])) for r in rows)))
    h = Hashed(np.frombuffer(b"".join(r[6] for r in rows), dtype=np.uint8))
    a = np.cumsum(size) - size + core
    salt = key.view(np.uint64) * BASE

    def bound(room: np.ndarray, stretch) -> np.ndarray:
        most, k, g = np.zeros(len(room), dtype=np.int64), np.arange(len(room)), STEP
        while True:
            k = k[room[k] >= g]
            if not len(k):
                return most + STEP - 1
            _, same, count = np.unique(stretch(k, g) ^ salt[k], return_inverse=True, return_counts=True)
            k = k[count[same] > 1]
            most[k] = g
            g += STEP

    left = bound(core, lambda k, g: h.of(a[k] - g, a[k]))
    right = bound(size - core - width, lambda k, g: h.of(a[k] + width[k], a[k] + width[k] + g))
    first, last = np.maximum(core - left, 0), np.minimum(core - (length - width) + right, n - 1)
    live = np.flatnonzero(first <= last)
    _, same, count = np.unique(key[live], return_inverse=True, return_counts=True)
    live = live[count[same] > 1]
    out = []
    for k, s, e in zip(live.tolist(), first[live].tolist(), last[live].tolist()):
        key_, ctx, kinds, c, w, _, text = rows[k]
        out.append((key_, ctx, kinds, c - s, w, e - s + 1, text[s : e + length], s))
    return out


def sorted_hits(ctx: DataFrame, length: int) -> DataFrame:
    """(key, ctx, a, b): windows a..b-1 of the context (counted from its start) that some other context of its key has, too.

    The contexts of one key, trimmed, become one string: what stands before the core, one symbol for the core (they share it), what
    comes after, and a border. Its suffix array tells which windows occur twice. A window holds the whole core, so its place in the other context is the same.
    """

    def one(rows: list[tuple]) -> list[tuple]:
        parts, starts, where, at = [], [0], [], 0
        for k, (key, _, _, core, width, n, data, _) in enumerate(rows):
            x = np.frombuffer(data, dtype=np.uint8).astype(np.int64) + 3
            parts += [x[:core], np.array([2]), x[core + width :], np.array([1])]
            where.append((at, n, length - width + 1))
            at += len(x) - width + 2
            if k + 1 == len(rows) or rows[k + 1][0] != key:
                parts.append(np.array([0]))
                at += 1
                starts.append(at)
        text, bounds = np.concatenate(parts), np.array(starts)
        sa, _ = suffix_arrays(text, bounds)
        out = []
        least = sorted({w[2] for w in where})
        hits = {m: shared_prefix(text, sa, bounds, m) for m in least}
        for (s, n, m), r in zip(where, rows):
            hit = np.concatenate(([0], hits[m][s : s + n].astype(np.int8), [0]))
            edge = np.flatnonzero(np.diff(hit))
            out += [(r[0], r[1], r[7] + a, r[7] + b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
        return out

    def keys(batches):
        """Rows of whole keys, about SYMBOLS bytes at once."""
        held: list[tuple] = []
        total = 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("key", "ctx", "kinds", "core", "core_len", "n", "bytes"))):
                if total >= SYMBOLS and held[-1][0] != r[0]:
                    yield held
                    held, total = [], 0
                held.append(r)
                total += len(r[6])
        if held:
            yield held

    def run(batches):
        held: list[tuple] = []
        total = 0

        def flush(rows):
            got = one(rows)
            return pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], type=t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["key", "ctx", "a", "b"])

        for rows in keys(batches):
            rows = trimmed(rows, length)
            held += rows
            total += sum(len(r[6]) - r[4] + 2 for r in rows)
            if total >= SYMBOLS:
                yield flush(held)
                held, total = [], 0
        if held:
            yield flush(held)

    # strings of like sizes take their steps together
    return ctx.repartition("key").sortWithinPartitions("kinds", "key", "ctx").mapInArrow(run, "key long, ctx long, a int, b int")


def weighed(runs: DataFrame) -> DataFrame:
    """(key, ctx, w, kinds, least, doc_id, row, s, n, core, core_len): a run of each context of the keys that have two runs or more, with the context's weight, and the key's number of contexts and least weight.

    Runs are sorted by key and context and summed as they come. A key waits until all its contexts are known, but one of more than a few times GROUP doesn't: its contexts go out with GROUP + 1 as their
    number and 1 as the least weight, which is all that a key to be split needs. So neither copies nor contexts of a key fill a task.
    """
    place = ["doc_id", "row", "s", "n", "core", "core_len"]
    cols = ["key", "ctx", "w", *place]

    def run(batches):
        held, hot = None, None  # sums of the last key's contexts so far; the key that didn't wait

        def summed(t: pa.RecordBatch) -> pa.RecordBatch:
            key, ctx, w = (t.column(k).to_numpy() for k in range(3))
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])))
            start = np.flatnonzero(new)
            return t.take(pa.array(start)).set_column(2, "w", pa.array(np.add.reduceat(w, start)))

        def told(t: pa.RecordBatch) -> pa.RecordBatch:
            """Contexts of whole keys, or of the hot one."""
            key, w = t.column(0).to_numpy(), t.column(2).to_numpy()
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            n = np.diff(np.append(start, len(key)))
            total, least = np.add.reduceat(w, start), np.minimum.reduceat(w, start)
            kinds = n.astype(np.int64)
            if hot is not None:
                kinds, least, total = (np.where(key[start] == hot, v, x) for v, x in ((GROUP + 1, kinds), (1, least), (2, total)))
            keep = np.repeat(total > 1, n)
            t = t.filter(pa.array(keep))
            return pa.RecordBatch.from_arrays([*t.columns[:3], pa.array(np.repeat(kinds, n)[keep]), pa.array(np.repeat(least, n)[keep]), *t.columns[3:]], names=[*cols[:3], "kinds", "least", *place])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([x for x in (held, b) if x is not None]).combine_chunks().to_batches()[0] if held is not None and held.num_rows else b
            t = summed(t)
            key = t.column(0).to_numpy()
            at = 0 if key[0] == key[-1] else len(key) - int((key[::-1] != key[-1]).argmax())
            if len(key) - at > 4 * GROUP:
                # the last context may go on
                hot, at = key[-1], len(key) - 1
            if at:
                out = told(t.slice(0, at))
                if out.num_rows:
                    yield out
            held = t.slice(at)
        if held is not None and held.num_rows:
            out = told(held)
            if out.num_rows:
                yield out

    schema = "key long, ctx long, w long, kinds long, least long, doc_id long, row long, s long, n int, core long, core_len int"
    # the least document stands for a context: so few documents' texts are looked at again
    return runs.select(cols).repartition("key").sortWithinPartitions("key", "ctx", "doc_id", "row").mapInArrow(run, schema)


def repeated(docs: DataFrame, length: int = 400, core: int | None = None) -> DataFrame:
    """(doc_id, row, a, b): stretches [a, b) of bytes of docs (doc_id, row, text), each covered by repeated strings of `length` bytes.

    Windows are routed by their anchors. Equal contexts meet by their hashes (twice 64 bits) and count as one text with a weight: of two or more,
    every window is repeated. Contexts that differ but share a core are compared by suffix arrays; a core with more than GROUP
    of them is first split: one run of each of its contexts, with the weight, goes on as two with longer cores, down to single windows, so that no group of any size meets in a task.
    Anchors have `core` bytes, half of a window's by default.
    """
    found, now = [], cut(runs(docs, length, core or length // 2).withColumn("w", F.lit(1).cast("long")), "runs")
    while True:
        cand = cut(weighed(now), "candidates")
        whole = cand.where("w > 1").select("key", "ctx", F.lit(0).alias("a"), F.col("n").alias("b"))
        mixed = cand.where("kinds > 1 and least = 1")
        small = mixed.where(F.col("kinds") <= GROUP).drop("w", "least")
        apart = cut(sorted_hits(contexts(with_text(docs, small), length).dropDuplicates(["key", "ctx"]), length), "apart")
        hits = whole.unionByName(apart)
        found.append(now.join(hits, ["key", "ctx"]).select("doc_id", "row", (F.col("s") + F.col("a")).alias("a"), (F.col("s") + F.col("b") - 1 + length).alias("b")))
        # a context of a weight over 1 is a hit as a whole: where its copies lie needs no further look
        hot = mixed.where(F.col("kinds") > GROUP).select("doc_id", "row", "s", "n", "core", "core_len", "w")
        if hot.isEmpty():
            break
        now = cut(split_runs(with_text(docs, hot), length), "runs")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    # maximal stretches
    order = Window.partitionBy("doc_id", "row").orderBy("a", "b")
    out = out.distinct().withColumn("before", F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    out = out.withColumn("k", F.sum(F.when(F.col("before") >= F.col("a"), 0).otherwise(1)).over(order))
    return out.groupBy("doc_id", "row", "k").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("k")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, text); row is a hash that tells texts of the same id apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return batched(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def deduplicated(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, n_bytes, n_removed, n_spans, kept) per row: kept are the bytes that no repeated string covers.

    Null texts are empty; a repeated row is a copy like any other, so that long ones lose all their bytes.
    """
    rows = keyed(docs, id_col, text_col)
    cuts = cut(repeated(rows, length), "spans").groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("cuts"))
    held = rows.alias("a").join(sized(cuts, 100_000).alias("b"), _same("a", "b"), "left").select("a.doc_id", "a.row", "a.text", "b.cuts")

    def run(batches):
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for t, cs in zip(b.column(2), b.column(3).to_pylist()):
                x = t.as_py().encode("utf-8", "surrogatepass")
                kept, at, gone = [], 0, 0
                for c in cs or ():
                    kept.append(x[at : c["a"]])
                    gone += c["b"] - c["a"]
                    at = c["b"]
                for col, v in zip(cols, (len(x), gone, len(cs or ()), b"".join([*kept, x[at:]]))):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, type=pa.int64()) for c in cols[:3]], pa.array(cols[3], type=pa.binary())], names=["doc_id", "row", "n_bytes", "n_removed", "n_spans", "kept"])

    return held.mapInArrow(run, "doc_id long, row long, n_bytes long, n_removed long, n_spans long, kept binary")


def word_codes(text: bytes | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a byte of each word's hash, where the word starts); words are parted by ASCII white space."""
    x = np.frombuffer(text, dtype=np.uint8)
    word = np.concatenate(([False], (x != 32) & ((x < 9) | (x > 13)), [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    out = [np.empty(0, dtype=np.uint8)]
    for k in range(0, len(start), WORDS):
        a, b = start[k : k + WORDS], end[k : k + WORDS]
        out.append((Hashed(x[a[0] : b[-1]]).of(a - a[0], b - a[0]) >> np.uint64(56)).astype(np.uint8))
    return np.concatenate(out), start


def anchors(docs: DataFrame, words: int, core: int) -> DataFrame:
    """(key, ctx, who, at): anchored runs of windows of so many words of (who, text), each of a document's different contexts once. `at` holds a run's start and, in its last eight bits, its windows."""

    def run(batches):
        for b in batches:
            who = b.column(0).to_numpy()
            for k, x, bounds in joined((data(t.as_py()) for t in b.column(1)), b" "):
                codes, start = word_codes(x)
                of, s, n, _, key, ctx = anchored(codes, np.searchsorted(start, bounds), words, core)
                order = np.lexsort((ctx, of))
                new = np.ones(len(order), dtype=bool)
                new[1:] = (ctx[order][1:] != ctx[order][:-1]) | (of[order][1:] != of[order][:-1])
                first = order[new]
                cols = (key[first].view(np.int64), ctx[first].view(np.int64), who[k + of[first]], s[first] << 8 | n[first])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "ctx", "who", "at"])

    return docs.select("who", "text").mapInArrow(run, "key long, ctx long, who long, at long")


def meetings(found: DataFrame) -> DataFrame:
    """(key, who, at, whole): the runs of keys that two documents have; `whole` where two have the whole context.

    Runs are sorted by key and context, and what a task holds is settled from group to group: of a group that one document alone has so far, its rows wait; once there is a second one, rows go out as
    they come. So a passage that very many documents share costs no memory.
    """

    def runs_of(*cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group of each row, whether the group has two documents) of rows sorted by cols[:-1]; the last column is the document."""
        new = np.zeros(len(cols[0]), dtype=bool)
        for c in cols[:-1]:
            new[1:] |= c[1:] != c[:-1]
        new[:1] = True
        start, group = np.flatnonzero(new), np.cumsum(new) - 1
        lo, hi = (f.reduceat(cols[-1], start) for f in (np.minimum, np.maximum))
        return group, lo != hi

    def run(batches):
        held = [np.empty(0, dtype=np.int64)] * 4
        known = (None, None, False, False)  # the last key and context that went out, and whether two documents have them

        def settle(k: list[np.ndarray], last: bool):
            """Rows that can go out, and those that wait for more of their key or context."""
            nonlocal known
            key, ctx, who, at = k
            if not len(key):
                return None, k
            kg, k2 = runs_of(key, who)
            cg, c2 = runs_of(key, ctx, who)
            if known[0] == key[0]:
                k2[0] |= known[2]
                if known[1] == ctx[0]:
                    c2[0] |= known[3]
            wait = np.zeros(len(key), dtype=bool)
            if not last:
                # the last group may go on: its rows wait unless it has two documents already
                wait |= (kg == kg[-1]) & ~k2[-1]
                wait |= (cg == cg[-1]) & ~c2[-1]
            out = k2[kg] & ~wait
            known = (key[-1], ctx[-1], bool(k2[-1]), bool(c2[-1]))
            batch = pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(who[out]), pa.array(at[out]), pa.array(c2[cg][out])], names=["key", "who", "at", "whole"])
            return batch, [c[wait] for c in k]

        for b in batches:
            held = [np.concatenate([h, b.column(c).to_numpy()]) for h, c in zip(held, ("key", "ctx", "who", "at"))]
            out, held = settle(held, False)
            if out is not None and out.num_rows:
                yield out
        out, _ = settle(held, True)
        if out is not None and out.num_rows:
            yield out

    return found.repartition("key").sortWithinPartitions("key", "ctx").mapInArrow(run, "key long, who long, at long, whole boolean")


def windows(held: DataFrame, words: int) -> DataFrame:
    """(who, window): hashes of the windows of the runs that (who, text, runs) holds, each once a document."""

    def run(batches):
        for b in batches:
            for who, t, rs in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                h, r = Hashed(word_codes(data(t.as_py()))[0]), rs.values.to_numpy()
                at = np.unique(np.concatenate([np.arange(a >> 8, (a >> 8) + (a & 255)) for a in r.tolist()]))
                got = np.unique(h.of(at, at + words)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), who)), pa.array(got)], names=["who", "window"])

    return held.mapInArrow(run, "who long, window long")


def shared_passages(docs: DataFrame, words: int = 51) -> DataFrame:
    """(doc_id, row) of the documents that hold a passage of so many words that another one holds, too, whatever white space parts them.

    Texts become one byte a word, so many of which are as good as a long hash. Windows are routed by anchors as those of bytes are, and only keys that two documents have go on. Equal contexts
    settle most documents; of the others, and of what shares a key with them, the single windows are compared by their hashes.
    """
    named = docs.withColumn("who", F.xxhash64("doc_id", "row"))
    cand = cut(meetings(anchors(named, words, words // 3)), "meetings")
    same = cut(cand.where("whole").select("who").distinct(), "same")
    open_keys = cut(cand.join(sized(same), "who", "left_anti").select("key").distinct(), "open")
    rest = cand.join(sized(open_keys), "key", "left_semi").groupBy("who").agg(F.collect_list("at").alias("runs"))
    w = cut(windows(named.select("who", "text").join(sized(cut(rest, "rest"), 50_000), "who").select("who", "text", "runs"), words), "windows")
    two = w.groupBy("window").agg(F.min("who").alias("lo"), F.max("who").alias("hi")).where("lo <> hi").select("window")
    more = w.join(sized(cut(two, "shared")), "window", "left_semi").select("who")
    return named.join(sized(cut(same.union(more).distinct(), "flagged")), "who", "left_semi").select("doc_id", "row").distinct()


def op6_suffixes(docs: DataFrame) -> DataFrame:
    """The contract's row per document, and whether it shares a passage of over 50 words with another one. Such a passage may have less than 400 bytes, so that nothing is removed.

    Null texts are empty; rows of null or repeated ids are returned each, and repeated rows are copies of each other; extra columns are ignored.
    """
    out = deduplicated(docs, 400).select("doc_id", "row", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    flagged = cut(shared_passages(keyed(docs)), "passages").withColumn("shared", F.lit(True))
    out = out.alias("a").join(sized(flagged).alias("b"), _same("a", "b"), "left")
    return out.select("a.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("shared", F.lit(False)).alias("shared_passage"))
