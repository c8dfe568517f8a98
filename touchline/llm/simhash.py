"""Near duplicates by SimHash: fingerprints of word shingles, linked by a binary-trie self-join; near copies are confirmed by their exact similarity."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batched, connected_components, cut, local_stars, sized, unused
from .suffixes import Hashed

#: Lower-cases A-Z only.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Fingerprints of one trie node that are traversed in one task at most; larger nodes are split.
CELL = 4096
#: Rows and node pairs held at once in a task, words of a text hashed at once.
ROWS, PAIRS, PART = 200_000, 1_000_000, 1 << 17
#: Near copies are alike in at least NUM / DEN of their different shingles; of the pairs just as alike, at least RECALL are to meet.
NUM, DEN, RECALL = 4, 5, 0.995
#: 64-bit words of a wide fingerprint that each candidate pair is tested on, besides the one that is traversed.
FAR = 4
#: Documents of one candidate component whose shingles are compared in one task at most; larger components are split into cells. Members that each cell of a component meets first.
SETS, PIVOTS = 256, 8


# ---- fingerprints ----


def shingles(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 values of the text's word shingles in turn, repeats included.

    A-Z are lower-cased; words are runs without ASCII white space. Fewer words than a shingle: the whole sequence is one. No word (or null): none.
    """
    w = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not w:
        return np.empty(0, dtype="<u8")
    flat = b" ".join(w)
    end = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    n = max(1, len(w) - words + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(flat[a:b], seed) for a, b in zip(start[:n].tolist(), end[len(w) - n :].tolist())), dtype="<u8", count=n)


def majority(h: np.ndarray) -> np.ndarray:
    """Per column of 64-bit values: a bit is 1 if it is 1 in over half of the rows; no rows: 0."""
    ones = np.zeros(64 * h.shape[1], dtype=np.int64)
    for k in range(0, len(h), 255):  # so many fit a byte
        bits = np.unpackbits(h[k : k + 255].view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view("<u8")


def fingerprint(text: str | None, words: int, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles, repeats included. No word (or null): 0."""
    return int(majority(shingles(text, words, seed)[:, None])[0])


def plain_shingles(text: str | None, words: int) -> np.ndarray:
    """As shingles(), by hashes that numpy takes from prefix sums of the whole text, and each different one once, ascending."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    out = [np.empty(0, dtype=np.uint64)]
    for k in range(0, max(1, len(w) - words + 1) if w else 0, PART):
        part = w[k : k + PART + words - 1]
        end = np.cumsum(np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 1) - 1
        n = max(1, len(part) - words + 1)
        start = np.concatenate(([0], end[:-1] + 1))[:n]
        out.append(Hashed(np.frombuffer(b" ".join(part), dtype=np.uint8)).of(start, end[len(part) - n :]))
    return np.unique(np.concatenate(out))


def wide(sets: np.ndarray, count: int) -> np.ndarray:
    """The fingerprint of a set of shingles in `count` words, each by other 64-bit values of the same shingles."""
    with np.errstate(over="ignore"):
        h = sets[:, None] + np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return majority(h ^ (h >> np.uint64(31)))


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long. One row per row of docs; a null text counts as empty."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array([fingerprint(t.as_py(), words) for t in b.column(1)], dtype=np.uint64).view(np.int64))],
                names=["id", "fp"],
            )

    return batched(docs).select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, fp long")


# ---- the trie join ----


@dataclass(frozen=True)
class Turn:
    """A fingerprint word to traverse from bit `at` on (as a ring): its first `width` bits must be equal, and after d bits allow[d] may differ."""

    word: int
    at: int
    width: int
    allow: tuple[int, ...]

    def split(self) -> int:
        """Bits after the first `width` in which one may differ at most."""
        d = self.width
        while d < 64 and self.allow[d + 1] <= 1:
            d += 1
        return d - self.width


def blocks(budget: int) -> list[int]:
    """Widths of budget + 1 blocks of the 64 bits."""
    m = budget + 1
    return [64 // m + (k < 64 % m) for k in range(m)]


def budgets(r: int, budget: int) -> np.ndarray:
    """Most differing bits after each depth 0..64 of rotation r."""
    widths = blocks(budget)
    out = [0]
    for k in range(len(widths)):
        out += [k] * widths[(r + k) % len(widths)]
    return np.array(out)


def exact_turns(budget: int) -> list[Turn]:
    """Turns that find all pairs of 64-bit fingerprints within `budget` bits.

    If two fingerprints differ in at most `budget` of 64 bits, then in a ring of budget + 1 blocks there is a
    block to start from such that, after each l blocks, they differ in l - 1 bits at most (cycle lemma): they
    share the first block, and a traversal that starts there may prune by these growing budgets.
    """
    widths = blocks(budget)
    return [Turn(0, sum(widths[:r]), w, tuple(budgets(r, budget).tolist())) for r, w in enumerate(widths)]


def bit_rate() -> float:
    """Chance that a bit differs for sets of one size that share NUM / DEN of their union: the angle between their sums."""
    return math.acos(2 * NUM / (NUM + DEN)) / math.pi


def slack(bits: int) -> int:
    """Differing bits that pairs just similar enough exceed in less than one of a thousand cases."""
    p = bit_rate()
    return math.floor(bits * p + 3.5 * math.sqrt(bits * p * (1 - p)))


def similar_turns(n: int) -> list[Turn]:
    """Turns that find at least RECALL of the pairs that are just similar enough (more of the others) among n wide fingerprints.

    A turn wants one block of a 64-bit word equal and at most one differing bit in the next block, and prunes by slack()
    beyond. Blocks widen with the logarithm of n, so that a trie node keeps its size, and the number of words follows from RECALL.
    """
    block = min(16, max(8, math.ceil(math.log2(max(n, 1) / CELL))))
    p, ring = bit_rate(), 64 // block
    hit = (1 - p) ** block * ((1 - p) ** block + block * p * (1 - p) ** (block - 1))
    words = math.ceil(math.log(1 - RECALL) / (ring * math.log(1 - hit)))
    allow = tuple([0] * (block + 1) + [1] * block + [1 + slack(d) for d in range(1, 65 - 2 * block)])
    return [Turn(w, b * block, block, allow) for w in range(words) for b in range(ring)]


def trie_join(bits: np.ndarray, left: np.ndarray, allow: np.ndarray, depth: int, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray):
    """Pairs (i, j) of fingerprints within allow[64] bits, from binary tries traversed two nodes at a time.

    bits: sorted within each trie; equal ones are a pair, too. A node is a range of them that shares its first `depth` bits. Where left
    holds, the pair's nodes are [lo, mid) and [mid, hi), two tries; else the trie [lo, hi) is joined with itself.
    Each step takes both nodes' children, adds a differing bit where they part, and prunes pairs beyond allow[depth].
    """
    shift, one = np.uint64(1), ~left
    stack = [
        (depth, lo[one], hi[one], lo[one], hi[one], np.zeros(int(one.sum()), dtype=np.int64)),
        (depth, lo[left], mid[left], mid[left], hi[left], np.zeros(int(left.sum()), dtype=np.int64)),
    ]
    ones: dict[int, np.ndarray] = {}
    limit = int(allow[64])
    while stack:
        d, a0, a1, b0, b1, diff = stack.pop()
        if len(a0) > PAIRS:
            for k in range(0, len(a0), PAIRS):
                stack.append((d, *(x[k : k + PAIRS] for x in (a0, a1, b0, b1, diff))))
            continue
        own = a0 == b0
        keep = ~(own & (a1 - a0 < 2))
        a0, a1, b0, b1, diff, own = (x[keep] for x in (a0, a1, b0, b1, diff, own))
        leaf = ~own & (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            near = np.bitwise_count(bits[i] ^ bits[j]) <= limit
            if near.any():
                yield i[near], j[near]
            a0, a1, b0, b1, diff, own = (x[~leaf] for x in (a0, a1, b0, b1, diff, own))
        if not len(a0):
            continue
        if d == 64:  # equal fingerprints of each node
            yield from _products(a0, a1, b0, b1, own)
            continue
        if d not in ones:
            ones[d] = np.concatenate(([0], np.cumsum((bits >> np.uint64(63 - d)) & shift, dtype=np.int64)))
        c = ones[d]
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        two = ~own
        parts = [
            (a0, am, b0, bm, diff),
            (am, a1, bm, b1, diff),
            (a0, am, bm, b1, diff + 1),
            (am[two], a1[two], b0[two], bm[two], diff[two] + 1),
        ]
        nxt = [np.concatenate([p[k] for p in parts]) for k in range(5)]
        ok = (nxt[0] < nxt[1]) & (nxt[2] < nxt[3]) & (nxt[4] <= allow[d + 1])
        stack.append((d + 1, *(x[ok] for x in nxt)))


def _products(a0, a1, b0, b1, own):
    """Pairs of equal fingerprints: as many as tie each pair of nodes together."""
    for p, q, r, s, o in zip(a0.tolist(), a1.tolist(), b0.tolist(), b1.tolist(), own.tolist()):
        if o:
            yield np.arange(p, q - 1), np.arange(p + 1, q)
        else:
            a, b = np.arange(p, q), np.arange(r, s)
            yield np.concatenate([a, np.full(len(b), p)]), np.concatenate([np.full(len(a), r), b])


def _far(near: int | None) -> list[str]:
    return [] if near is None else [f"far{k}" for k in range(FAR)]


def join_groups(cols: dict[str, np.ndarray], turns: list[Turn], near: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (u, v) of the nodes linked within the groups of these rows, which are sorted by (turn, block, a, b, i, j, side, bits)."""
    key = np.stack([cols[k].astype(np.int64) for k in ("turn", "block", "a", "b", "i", "j")])
    new = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0))))
    end = np.append(new[1:], key.shape[1])
    ones = np.concatenate(([0], np.cumsum(cols["side"])))
    mid = end - (ones[end] - ones[new])
    two = ((key[2] != key[3]) | (key[4] != key[5]))[new]
    found = [(np.empty(0, dtype=np.int64),) * 2]
    for t in np.unique(key[0]):
        pick = key[0][new] == t
        turn = turns[int(t)]
        for i, j in trie_join(cols["bits"], two[pick], np.array(turn.allow), turn.width, new[pick], mid[pick], end[pick]):
            if near is not None:
                ok = sum(np.bitwise_count(cols[f][i] ^ cols[f][j]).astype(np.int64) for f in _far(near)) <= near
                i, j = i[ok], j[ok]
            found.append((i, j))
    a, b = (np.concatenate(x) for x in zip(*found))
    ids, at = np.unique(cols["node"], return_inverse=True)
    item, root = local_stars(len(ids), at[a], at[b])
    return ids[item], ids[root]


def turned(fp: DataFrame, turns: list[Turn], far: list[str]) -> DataFrame:
    """(node, far..., turn, bits, block): each row of (node, far array, words) once for each turn, its word turned so that it starts at the turn's bit."""

    def one(k: int, t: Turn):
        word = F.get("words", F.lit(t.word))
        bits = F.shiftleft(word, t.at).bitwiseOR(F.shiftrightunsigned(word, 64 - t.at)) if t.at else word
        return F.struct(F.lit(k).alias("turn"), bits.alias("bits"), F.shiftrightunsigned(bits, 64 - t.width).alias("block"))

    tests = [F.get("far", F.lit(k)).alias(f) for k, f in enumerate(far)]
    return fp.select("node", *tests, F.explode(F.array(*[one(k, t) for k, t in enumerate(turns)])).alias("t")).select("node", *far, "t.*")


def links(fp: DataFrame, turns: list[Turn], near: int | None = None) -> DataFrame:
    """(node, words), one row per distinct fingerprint -> edges (u, v) whose components are those of all pairs that the turns allow.

    With near, a pair's FAR words of the array `far` may differ in so many bits at most. A trie node is what shares a turn's first block. One of over CELL fingerprints
    is split by its next bits, of which one may differ: a child meets itself and the children one bit away, no others. Where bits don't part a node (its fingerprints are alike), its
    children are split into cells by a hash, and each pair of cells is traversed as two tries. A task gives a spanning forest of what it finds, not every pair.
    """
    far = _far(near)
    rot = turned(fp, turns, far)
    split = F.array(*[F.lit(t.split()) for t in turns])
    width = F.array(*[F.lit(t.width) for t in turns])
    more = F.least(F.get(split, F.col("turn")), F.greatest(F.lit(0), F.ceil(F.log2(F.col("count") / CELL)).cast("int")))
    # only nodes beyond CELL need their children's sizes; there are at most as many of them as CELL goes into the rows, so they alone are joined, and rows are shuffled once
    n = rot.groupBy("turn", "block").count().where(F.col("count") > CELL).withColumn("more", more)
    child = lambda: F.when(F.col("more") > 0, F.expr("shiftrightunsigned(shiftleft(bits, w), 64 - more)")).otherwise(F.lit(0)).cast("int")
    at = lambda d: d.withColumn("w", F.get(width, F.col("turn"))).withColumn("child", child())
    n = cut(n, "nodes")
    big = sized(n.where("more > 0").select("turn", "block", "more"))
    size = at(rot.join(big, ["turn", "block"])).groupBy("turn", "block", "child").count()
    cells = size.groupBy("turn", "block").agg(F.ceil(F.max("count") / CELL).cast("int").alias("cells"))
    # a node of a few children that bits can't part has more == 0 and cells by its whole count
    n = n.select("turn", "block", "count", "more").join(cells, ["turn", "block"], "left")
    n = cut(n.select("turn", "block", "more", F.coalesce("cells", F.ceil(F.col("count") / CELL).cast("int")).alias("cells")), "large")
    rows = rot.join(sized(n), ["turn", "block"], "left").withColumn("more", F.coalesce("more", F.lit(0))).withColumn("cells", F.coalesce("cells", F.lit(1)))
    rows = at(rows)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("cells")).cast("int"))
    rows = rows.withColumn("mate", F.explode(F.expr("concat(array(child), transform(slice(sequence(0, greatest(more, 1)), 1, more), k -> cast(child ^ shiftleft(1, cast(k as int)) as int)))")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    alone, low = F.col("child") == F.col("mate"), F.col("child") < F.col("mate")
    rows = rows.select(
        "turn", "block", F.least("child", "mate").alias("a"), F.greatest("child", "mate").alias("b"),
        F.when(alone, F.least("own", "other")).when(low, F.col("own")).otherwise(F.col("other")).alias("i"),
        F.when(alone, F.greatest("own", "other")).when(low, F.col("other")).otherwise(F.col("own")).alias("j"),
        F.when(alone, F.col("own") > F.col("other")).otherwise(~low).cast("int").alias("side"), "bits", *far, "node",
    )
    keys = ["turn", "block", "a", "b", "i", "j"]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> pa.RecordBatch:
            cols = {x: rows.column(x).to_numpy() for x in (*keys, "side", "bits", *far, "node")}
            cols |= {x: cols[x].view(np.uint64) for x in ("bits", *far)}  # signed ones would be counted by their absolute values
            return pa.RecordBatch.from_arrays([pa.array(x) for x in join_groups(cols, turns, near)], names=["u", "v"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= ROWS:
                t = pa.Table.from_batches(held)
                k = np.stack([t.column(x).to_numpy() for x in keys])
                last = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0))
                if len(last):
                    yield flush(t.slice(0, int(last[-1]) + 1))
                    held = t.slice(int(last[-1]) + 1).to_batches()
        if held and (t := pa.Table.from_batches(held)).num_rows:
            yield flush(t)

    unsigned = F.col("bits").bitwiseXOR(F.lit(-(1 << 63)))
    return rows.repartition(*keys).sortWithinPartitions(*keys, "side", unsigned).mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 4, budget: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for each row of docs: components of fingerprints linked at `budget` or fewer differing bits.

    component_id is the smallest id reachable; equal fingerprints are one class, and only classes are joined. Rows with a null id
    keep a null component_id and link with nothing. Extra columns are ignored; repeated rows stay.
    """
    fps = cut(fingerprints(docs, words, id_col, text_col), "fingerprints")
    # many partitions over the hot fingerprint's rows: partial minima first
    reps = cut(fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    # a class is known by its fingerprint, whatever ids its rows repeat
    found = links(reps.select(F.col("fp").alias("node"), F.array("fp").alias("words")), exact_turns(budget))
    comp = connected_components(found)
    named = reps.join(comp, reps["fp"] == comp["id"], "left").select("fp", "rep", F.coalesce("component_id", "fp").alias("c"))
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    out = fps.join(named.join(least, "c").select("fp", "component_id"), "fp", "left")
    return out.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def op2_simhash(docs: DataFrame) -> DataFrame:
    """The contract's row per document. Null texts count as empty: fingerprint zero, linked like any other; rows with a null id link with nothing.

    Repeated rows, also of the same id, each give a row; an empty table gives none; extra columns are ignored.
    """
    out = near_duplicates(docs, words=4, budget=4)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near copies: wide fingerprints, confirmed ----


def signed_sets(docs: DataFrame, words: int, count: int, grams: bool, id_col: str, text_col: str) -> DataFrame:
    """(id, row, node, n, words) per row of docs: `row` hashes the text, `node` the set of its n different shingles, whose fingerprint is in `count` words. With grams: the shingles themselves, too."""

    def run(batches):
        for b in batches:
            sets = [plain_shingles(t.as_py(), words) for t in b.column(2)]
            node = pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets], type=pa.int64())
            n = np.array([len(s) for s in sets], dtype=np.int64)
            got = np.array([wide(s, count) for s in sets], dtype=np.uint64).reshape(-1, count)
            cols = [b.column(0), b.column(1), node, pa.array(n), _lists(np.full(len(n), count), got.ravel())]
            if grams:
                cols.append(_lists(n, np.concatenate([np.empty(0, dtype=np.uint64), *sets])))
            yield pa.RecordBatch.from_arrays(cols, names=["id", "row", "node", "n", "words", *["grams"] * grams])

    schema = "id long, row long, node long, n long, words array<long>" + (", grams array<long>" if grams else "")
    text = F.col(text_col).cast("string")
    return batched(docs).select(F.col(id_col).cast("long"), F.xxhash64(text), text).mapInArrow(run, schema)


def _lists(n: np.ndarray, flat: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(flat.view(np.int64)))


def confirm(sets: list[np.ndarray], words: np.ndarray, group: np.ndarray, side: np.ndarray | None) -> list[tuple[int, int]]:
    """Pairs of similar sets with the components of all such pairs, where sets of a group are known to be in one component; with side only pairs of both sides count.

    Pairs whose fingerprints differ in more bits than slack() allows aren't looked at; nor are those that are in one component by now.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    n, words = np.array([len(s) for s in sets])[order], words[order]
    root = np.unique(group[order], return_index=True, return_inverse=True)
    root = root[1][root[2]]
    flat = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)[1]
    start = np.concatenate(([0], np.cumsum(n)))
    mark, out, most = np.zeros(int(flat.max()) + 1, dtype=bool), [], slack(64 * words.shape[1])
    sides = None if side is None else side[order]
    for a in range(len(n) - 1):
        b = np.arange(a + 1, np.searchsorted(n, n[a] * DEN // NUM, "right"))
        b = b[root[b] != root[a]]
        if sides is not None:
            b = b[sides[b] != sides[a]]
        if len(b):
            b = b[np.bitwise_count(words[b] ^ words[a]).sum(axis=1, dtype=np.int64) <= most]
        if not len(b):
            continue
        own = flat[start[a] : start[a + 1]]
        mark[own] = True
        off = np.cumsum(n[b]) - n[b]
        at = np.repeat(start[b] - off, n[b]) + np.arange(int(n[b].sum()))
        shared = np.add.reduceat(mark[flat[at]], off, dtype=np.int64)
        mark[own] = False
        hit = b[(NUM + DEN) * shared >= NUM * (n[a] + n[b])]
        out += [(int(order[a]), int(order[k])) for k in hit]
        root[np.isin(root, root[hit])] = root[a]
    return out


def compared(rows: DataFrame, keys: list[str], sided: bool) -> DataFrame:
    """rows (keys, side, node, root, words, grams) -> edges (u, v) by confirm() of each key's rows; with sided, keys of two sides compare these only."""

    def run(batches):
        key, held = None, []

        def flush():
            node, root, side, words, grams = zip(*held)
            two = np.array(side) if sided and len(set(side)) > 1 else None
            pairs = confirm(list(grams), np.stack(words).view(np.uint64), np.array(root), two) if len(node) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([node[p[k]] for p in pairs], type=pa.int64()) for k in (0, 1)], names=["u", "v"])

        for b in batches:
            tags = zip(*(b.column(x).to_pylist() for x in keys))
            for now, *item, w, g in zip(tags, *(b.column(x).to_pylist() for x in ("node", "root", "side")), b.column("words"), b.column("grams")):
                if now != key:
                    if held:
                        yield flush()
                    key, held = now, []
                held.append((*item, w.values.to_numpy(), g.values.to_numpy()))
        if held:
            yield flush()

    cols = [*keys, "side", "node", "root", "words", "grams"]
    return rows.select(cols).repartition(*keys).sortWithinPartitions(*keys, "side", "node").mapInArrow(run, "u long, v long")


def confirmed(sets: DataFrame, comp: DataFrame) -> DataFrame:
    """(node, words, grams) and their candidate components (id, component_id) -> edges (u, v) with the components of all pairs that are similar enough.

    First, components are cut into cells by a hash, and each cell is compared in itself and with a few members that all cells of its component meet: that joins what is truly one group. Where a
    component has several groups left, cells are made again, such that those of a large group hold nothing else, and pairs of cells are compared, but not two of one group. So a group of any size costs what it has, not its square.
    """
    sets = batched(sets).select("node", "words", "grams")
    size = comp.groupBy("component_id").agg(F.count("*").alias("n"))
    place = lambda cells: F.pmod(F.xxhash64("node", F.lit(7)), cells)
    member = comp.select(F.col("id").alias("node"), "component_id").join(size, "component_id").select("node", F.col("component_id").alias("c"), "n", F.ceil(F.col("n") / SETS).alias("cells"))
    member = cut(member.withColumn("cell", place(F.col("cells"))), "members")
    # the least hashes of a few parts of a component
    part = F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(PIVOTS))
    pivots = member.where("cells > 1").groupBy("c", "cells", part.alias("p")).agg(F.min(F.struct(F.xxhash64("node"), F.col("node").alias("node")))["node"].alias("node"))
    pivots = pivots.select("node", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("cell"))
    first = member.select("node", "c", "cell").unionByName(pivots).distinct()
    first = first.join(sets, "node").withColumn("side", F.lit(0)).withColumn("root", F.col("node"))
    edges = cut(compared(first, ["c", "cell"], False), "confirmed")
    if member.where("cells > 1").isEmpty():
        return edges
    groups = connected_components(edges).withColumnRenamed("id", "node").withColumnRenamed("component_id", "root")
    named = cut(member.where("cells > 1").select("node", "c").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node")), "groups")
    several = named.groupBy("c").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("c")
    named = named.join(several, "c")
    kinds = named.groupBy("c", "root").agg(F.count("*").alias("m")).withColumn("own", F.when(F.col("m") > SETS, F.col("root")))
    cells = kinds.groupBy("c", "own").agg(F.ceil(F.sum("m") / SETS).alias("cells"))
    # the cells of a component, numbered: a row for each SETS members
    every = cells.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    every = cut(every.withColumn("i", F.row_number().over(Window.partitionBy("c").orderBy("own", "cell"))), "cells")
    named = named.join(kinds.select("c", "root", "own"), ["c", "root"])
    same = named["own"].eqNullSafe(every["own"]) & (named["c"] == every["c"]) & (F.pmod(F.xxhash64(named["node"], F.lit(7)), every["cells"]) == every["cell"])
    mine = cut(named.join(every, same).select(named["c"], "node", "root", named["own"], "i"), "placed")
    other = every.select("c", F.col("own").alias("own2"), F.col("i").alias("i2"))
    # a cell of one group doesn't meet the others of that group; one of small groups meets itself, too
    pairs = every.select("c", "own", "i").join(other, "c").where("own is null or own2 is null or own <> own2").select("c", "i", F.least("i", "i2").alias("a"), F.greatest("i", "i2").alias("b"))
    rows = mine.join(pairs, ["c", "i"]).withColumn("side", (F.col("i") == F.col("b")).cast("int") - (F.col("a") == F.col("b")).cast("int")).join(sets, "node")
    return edges.unionByName(cut(compared(rows, ["c", "a", "b"], True), "confirmed"))


def near_copies(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, first) for each row of docs with words; `row` hashes its text. `first` holds the least (id, row) that a chain of near copies leads to, itself included; null ids come last.

    Candidates are components of wide fingerprints that the trie join links (see similar_turns()). Of those, only pairs that share NUM / DEN of their different shingles or more,
    counted, are links. Equal sets are one class, known by `node`, and only classes are compared; texts without words take no part.
    """
    turns = similar_turns(docs.count())
    count = 1 + max(t.word for t in turns) + FAR
    rows = cut(signed_sets(docs, words, count, False, id_col, text_col).where("n > 0"), "fingerprints")
    key = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    classes = cut(rows.groupBy("node").agg(F.min(F.struct(key.alias("key"), "words")).alias("m")).select("node", "m.*"), "classes")
    comp = cut(connected_components(links(classes.select("node", F.slice("words", count - FAR + 1, FAR).alias("far"), "words"), turns, slack(64 * FAR))), "candidates")
    wanted = cut(classes.join(comp, classes["node"] == comp["id"]).select("node", "key.id", "key.row"), "wanted")
    i, r = unused(docs, "_id"), unused(docs, "_row")
    # shingles are made again for the candidates' own documents only
    same = F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(r))
    held = docs.join(sized(wanted.select(F.col("id").alias(i), F.col("row").alias(r))), same, "left_semi")
    sets = cut(signed_sets(held, words, count, True, id_col, text_col).select("node", "words", "grams").dropDuplicates(["node"]), "sets")
    found = cut(connected_components(confirmed(sets, comp)).withColumnRenamed("id", "node"), "components")
    named = classes.select("node", "key").join(found, "node", "left").withColumn("c", F.coalesce("component_id", "node"))
    least = named.groupBy("c").agg(F.min("key").alias("first"))
    return rows.select("id", "row", "node").join(sized(named.join(least, "c").select("node", "first")), "node").select("id", "row", "first")


def one_of_each(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each group of near copies: the row of the least id stays, ties by the text's hash, then any. Texts without words all stay."""
    near = cut(near_copies(docs, words, id_col, text_col), "near")
    i, r, k = (unused(docs, x) for x in ("_id", "_row", "_k"))
    named = lambda d: sized(d.select(F.col("id").alias(i), F.col("row").alias(r)))
    row = F.xxhash64(F.col(text_col).cast("string"))
    same = F.col(id_col).eqNullSafe(F.col(i)) & (row == F.col(r))
    gone = near.where("not (id <=> first.id and row = first.row)").select("id", "row").distinct()
    kept = docs.join(named(gone), same, "left_anti")
    again = near.where("id <=> first.id and row = first.row").groupBy("id", "row").count().where("count > 1")
    if again.isEmpty():
        return kept
    order = Window.partitionBy(F.col(id_col), row).orderBy(F.lit(0))
    once = kept.join(named(again), same, "left_semi").withColumn(k, F.row_number().over(order)).where(F.col(k) == 1).drop(k)
    return kept.join(named(again), same, "left_anti").unionByName(once)
