"""Best-fit packing of token sequences: patterns of a few lengths, weighted by non-negative least squares."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batched, cut, encoder, tokenizer_path

SIZE = 2048
#: Rows of one (length, bucket) that are numbered in one task, about.
BUCKET = 100_000


def pieces(docs: DataFrame, path: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's token ids, then id 0, cut into pieces of `size` where longer; the first piece takes what is over."""

    def run(batches):
        encode = encoder(path)
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(encode(t.as_py() or ""), np.uint32(0)).astype("<u4")
                n, at, k = len(ids), 0, 0
                first = n % size or size
                while at < n:
                    end = min(n, at + (first if at == 0 else size))
                    rows.append((i, k, at, end - at, zlib.crc32(ids[at:end].tobytes())))
                    at, k = end, k + 1
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], type=t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return batched(docs).select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(lengths: np.ndarray, size: int, most: int = 40_000) -> np.ndarray:
    """Rows of three lengths (0: none) that fill `size` as fully as the lengths allow: each with its best partner, and pairs with their best third.

    Of more than about `most` pairs, which over some 280 lengths make, every so-many-th is taken: the patterns that the fit may choose from are thinned, no length or piece is.
    """
    at = np.sort(lengths)
    pick = lambda room: np.where(room >= at[0], at[np.clip(np.searchsorted(at, room, "right") - 1, 0, None)], 0)
    one = np.stack([at, pick(size - at), np.zeros_like(at)], axis=1)
    step = max(1, int(np.ceil(len(at) ** 2 / 2 / most)))
    a, b = np.triu_indices(len(at))
    a, b = at[a[::step]], at[b[::step]]
    ok = a + b <= size
    two = np.stack([a[ok], b[ok], pick(size - a[ok] - b[ok])], axis=1)
    out = np.unique(np.sort(np.concatenate([one, two]), axis=1), axis=0)
    return out[out.sum(axis=1) >= 0.98 * size]


def nnls(p: np.ndarray, target: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that makes the patterns' summed lengths fit target[length] in least squares, by accelerated projected gradients."""
    n = len(target)
    use = lambda x: np.bincount(p.ravel(), weights=np.repeat(x, p.shape[1]), minlength=n)[:n] * live
    live = np.ones(n)
    live[0] = 0
    scale = 1 / np.maximum(use(np.ones(len(p))), 1)  # each length counts alike for its patterns
    x = np.zeros(len(p))
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        g = ((use(y) - target * live) * scale)[p].sum(axis=1)
        nxt = np.maximum(0, y - g / p.shape[1])
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = nxt + (t - 1) / t2 * (nxt - x), nxt, t2
    return x


def best_fit(fit: np.ndarray, free: np.ndarray, room: int) -> list[int]:
    """The one or two of the lengths `fit` (ascending, at most room, free[n] pieces left of each) that fill room best."""
    k = np.searchsorted(fit, room - fit, "right") - 1
    k -= (k >= 0) & (fit[k] == fit) & (free[fit] < 2)
    pair = np.where(k >= 0, fit + fit[k], 0)
    best = int(pair.argmax())
    return [int(fit[best]), int(fit[k[best]])] if pair[best] > fit[-1] else [int(fit[-1])]


def plan(hist: dict[int, int], size: int = SIZE) -> pd.DataFrame:
    """(length, lo, hi, sequence, offset): pieces of that length numbered lo..hi-1 go to sequences `sequence` onwards, one each, at the offset.

    hist counts pieces by length, so the plan's size depends on the number of lengths only. Patterns are fitted, rounded down
    and used as far as pieces last; residuals are packed best-fit, whole runs of the same pattern at a time.
    """
    left = np.zeros(size + 1, dtype=np.int64)
    for n, c in hist.items():
        left[n] = c
    used, rows, seq = np.zeros(size + 1, dtype=np.int64), [], 0

    def place(lengths: list[int], times: int) -> None:
        nonlocal seq
        off = 0
        for n in lengths:
            rows.append((n, used[n], used[n] + times, seq, off))
            used[n] += times
            left[n] -= times
            off += n
        seq += times

    if left[size]:
        place([size], int(left[size]))
    have = np.flatnonzero(left)
    if len(have):
        p = patterns(have, size)
        if len(p):
            x = nnls(p, left.astype(float))
            for k in np.argsort(-x, kind="stable"):
                if x[k] < 1:
                    break
                n, c = np.unique(p[k][p[k] > 0], return_counts=True)
                if (times := int(min(np.floor(x[k]), (left[n] // c).min()))) > 0:
                    place([int(v) for v in sorted(p[k][p[k] > 0], reverse=True)], times)
        while (have := np.flatnonzero(left)).size:
            chosen, free = [int(have[-1])], left.copy()
            free[have[-1]] -= 1
            while (fit := np.flatnonzero(free[: size - sum(chosen) + 1])).size:
                add = best_fit(fit, free, size - sum(chosen))
                chosen += add
                for n in add:
                    free[n] -= 1
            n, c = np.unique(chosen, return_counts=True)
            place(chosen, int((left[n] // c).min()))
    return pd.DataFrame(rows, columns=["length", "lo", "hi", "sequence", "offset"])


def pack(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """rows (a written table of pieces) with sequence_id and offset. The driver sees the histogram of lengths only."""
    counts = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # at most `size` rows
    laid = plan(counts, size)
    buckets = max(1, sum(counts.values()) // BUCKET)
    named = rows.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    per = named.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = named.withColumn("_rank", rank).join(per, ["length", "_b"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_b", "_before")
    laid = laid.sort_values(["length", "lo"])
    key = laid["length"].to_numpy() * (1 << 48) + laid["lo"].to_numpy()
    lo, seq, off = (laid[c].to_numpy() for c in ("lo", "sequence", "offset"))

    def run(batches):
        for b in batches:
            length, r = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            k = np.searchsorted(key, length * (1 << 48) + r, "right") - 1
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq[k] + r - lo[k]), pa.array(off[k])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def op9_packing(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """One row per piece with its place; null and empty texts are one piece of id 0. Extra columns are ignored, repeated rows packed each."""
    return pack(cut(pieces(docs, path or tokenizer_path(), size), "pieces"), size)
