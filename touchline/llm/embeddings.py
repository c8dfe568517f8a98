"""Near duplicates among embeddings: cover trees traversed two at a time, exact at a cosine threshold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, local_stars

#: Distinct vectors that a cell is meant to hold, and that it holds at most before it is split.
CELL, MOST = 1500, 4000
#: Cells of one label at most; their pivots are a sample of its vectors.
PIVOTS = 256
#: Node pairs whose centres are compared at once.
PAIRS = 200_000
EPS = 1e-7


class CoverTree:
    """Nested centres of unit vectors: level k's are at least 2 / 2**k apart, and each point is within that of its centre; a centre stays one below.

    levels[k] = (centres, covering radii as measured, children: places in the next level's nodes as one array with offsets).
    The last level's nodes are the points.
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        owner = np.zeros(len(x), dtype=np.int64)  # node of each point
        centres = np.zeros(1, dtype=np.int64)
        self.levels = []
        radius = 2.0
        while True:
            self.levels.append([centres, self._radii(centres, owner), None])
            if len(centres) == len(x):
                break
            radius /= 2
            centres2, owner2, parent = [], np.empty_like(owner), []
            order = np.argsort(owner, kind="stable")
            ends = np.cumsum(np.bincount(owner, minlength=len(centres)))
            for k, (c, e) in enumerate(zip(centres, ends)):
                rest = order[ends[k - 1] if k else 0 : e]
                if radius < 0.02:  # what is this close stays together no longer
                    rest = np.concatenate(([c], rest[rest != c]))
                    owner2[rest] = np.arange(len(centres2), len(centres2) + len(rest))
                    centres2 += rest.tolist()
                    parent += [k] * len(rest)
                    continue
                while len(rest):
                    d = np.sqrt(np.maximum(0, 2 - 2 * (x[rest] @ x[c])))
                    near = d <= radius
                    near |= rest == c
                    owner2[rest[near]] = len(centres2)
                    centres2.append(int(c))
                    parent.append(k)
                    rest = rest[~near]
                    if len(rest):
                        c = rest[0]
            first = np.searchsorted(np.array(parent), np.arange(len(centres) + 1))
            self.levels[-1][2] = first
            centres, owner = np.array(centres2), owner2

    def _radii(self, centres: np.ndarray, owner: np.ndarray) -> np.ndarray:
        d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", self.x, self.x[centres[owner]])))
        out = np.zeros(len(centres))
        np.maximum.at(out, owner, d)
        return out

    def level(self, k: int) -> list:
        """Level k; below the last, each node is its own child."""
        return self.levels[min(k, len(self.levels) - 1)]


def below(first: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes' children in turn, and how many each has."""
    n = first[nodes + 1] - first[nodes]
    return np.repeat(first[nodes], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), n


def dual_pairs(a: CoverTree, b: CoverTree, cosine: float):
    """Arrays (i, j) of a's and b's points with that cosine or more; i < j where both are the same tree."""
    reach = np.sqrt(max(0.0, 2 - 2 * cosine)) + EPS
    own = a is b
    u = v = np.zeros(1, dtype=np.int64)
    stack = [(0, u, v)]
    depth = max(len(a.levels), len(b.levels))
    while stack:
        k, u, v = stack.pop()
        if len(u) > PAIRS:
            stack += [(k, u[p : p + PAIRS], v[p : p + PAIRS]) for p in range(0, len(u), PAIRS)]
            continue
        la, lb = a.level(k), b.level(k)
        d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", a.x[la[0][u]], b.x[lb[0][v]])))
        keep = d <= reach + la[1][u] + lb[1][v]
        u, v = u[keep], v[keep]
        if k == depth - 1:
            i, j = la[0][u], lb[0][v]
            if own:
                i, j = i[u < v], j[u < v]
            near = np.einsum("ij,ij->i", a.x[i], b.x[j]) >= cosine
            yield i[near], j[near]
            continue
        if la[2] is not None:
            u, n = below(la[2], u)
            v = np.repeat(v, n)
        if lb[2] is not None:
            v, n = below(lb[2], v)
            u = np.repeat(u, n)
        if own:
            u, v = u[u <= v], v[u <= v]
        stack.append((k + 1, u, v))


def classes(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, label, vec or null) per row, and its distinct usable vectors (label, dim, vec, rep, cnt): equal vectors of a label are one class."""
    vec = F.col(vec_col).cast("array<double>")
    norm = F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x)
    fine = F.col(label_col).isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (norm > 0) & (norm < F.lit(float("inf")))
    rows = cut(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.when(fine & F.col(id_col).isNotNull(), vec).alias("vec")), "vectors")
    return rows, cut(
        rows.where("vec is not null").groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("cnt")).withColumn("dim", F.size("vec")), "classes"
    )


def unit(col: pd.Series) -> np.ndarray:
    x = np.array(col.tolist(), dtype=np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def cells(cls: DataFrame) -> DataFrame:
    """cls with the cell (nearest pivot) of each vector, its distance to the pivot, and the pivot's own vector on the pivot's row.

    A label's pivots are those of its vectors whose hash falls below a rate: about one for CELL vectors, PIVOTS at most. They are the tree's first level
    for all tasks; a task gets a slice of a label's vectors with the pivots of this label.
    """
    n = cls.groupBy("label", "dim").agg(F.count("*").alias("n"), F.min(F.xxhash64("rep", F.lit(11))).alias("low"))
    n = n.withColumn("rate", F.least(F.lit(1.0), F.least(F.ceil(F.col("n") / CELL), F.lit(PIVOTS)) / F.col("n"))).withColumn("slices", F.ceil(F.col("n") / 8192).cast("int"))
    x = cls.join(F.broadcast(n) if n.count() <= 10_000 else n, ["label", "dim"])
    h = F.xxhash64("rep", F.lit(11))
    top = F.pmod(h, F.lit(10**9)) < F.col("rate") * 1e9
    x = x.withColumn("is_pivot", top | (h == F.col("low"))).withColumn("slice", F.pmod(F.xxhash64("rep", F.lit(12)), F.col("slices")).cast("int"))
    pivots = x.where("is_pivot").select(F.col("label").alias("p_label"), F.col("dim").alias("p_dim"), F.col("rep").alias("pivot"), F.col("vec").alias("pvec"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("p_slice"))

    def assign(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=["label", "dim", "rep", "cnt", "vec", "cell", "dist"])
        right = right.sort_values("pivot")
        p, v = right["pivot"].to_numpy(), unit(right["pvec"])
        x = unit(left["vec"])
        c = x @ v.T
        at = c.argmax(axis=1)
        return left[["label", "dim", "rep", "cnt", "vec"]].assign(cell=p[at], dist=np.sqrt(np.maximum(0, 2 - 2 * c[np.arange(len(x)), at])))

    keys = ["label", "dim", "slice"]
    return x.select(*keys, "rep", "cnt", "vec").groupBy(*keys).cogroup(pivots.groupBy("p_label", "p_dim", "p_slice")).applyInPandas(assign, "label string, dim int, rep long, cnt long, vec array<double>, cell long, dist double")


def cell_pairs(x: DataFrame, cosine: float) -> DataFrame:
    """(label, dim, cell, part, other, other_part) with cell <= other: pairs of cells that their covering radii allow to be linked.

    Only cells' pivots and radii meet here, PIVOTS of a label at most. Cells of more than MOST vectors have parts.
    """
    stat = x.groupBy("label", "dim", "cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius"), F.max(F.when(F.col("rep") == F.col("cell"), F.col("vec"))).alias("pvec"))
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)) + EPS)

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell").reset_index(drop=True)
        v = unit(pdf["pvec"])
        d = np.sqrt(np.maximum(0, 2 - 2 * (v @ v.T)))
        r = pdf["radius"].to_numpy()
        i, j = np.nonzero(np.triu(d <= reach + r[:, None] + r[None, :]))
        parts = np.ceil(pdf["n"].to_numpy() / MOST).astype(int)
        rows = [(pdf["label"][a], pdf["dim"][a], pdf["cell"][a], p, parts[a], pdf["cell"][b], q, parts[b]) for a, b in zip(i, j) for p in range(parts[a]) for q in range(p if a == b else 0, parts[b])]
        return pd.DataFrame(rows, columns=["label", "dim", "cell", "part", "parts", "other", "other_part", "other_parts"])

    return stat.groupBy("label", "dim").applyInPandas(pairs, "label string, dim int, cell long, part int, parts int, other long, other_part int, other_parts int")


def linked(cls: DataFrame, cosine: float) -> DataFrame:
    """(rep, other, n): rows with other null count the vectors that rep's class is linked to besides copies; the others are star edges of linked classes."""
    x = cut(cells(cls), "cells")
    stat = x.groupBy("label", "dim", "cell").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / MOST).cast("int")
    x = cut(x.join(stat, ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("rep", F.lit(13)), parts).cast("int")), "parts")
    pairs = cut(cell_pairs(x, cosine), "cell_pairs")
    left = pairs.select("label", "dim", "cell", "part", F.struct("cell", "part", "other", "other_part").alias("pair"), F.lit(0).alias("side"))
    right = pairs.where("cell <> other or part <> other_part").select("label", "dim", F.col("other").alias("cell"), F.col("other_part").alias("part"), F.struct("cell", "part", "other", "other_part").alias("pair"), F.lit(1).alias("side"))
    rows = x.join(left.unionByName(right), ["label", "dim", "cell", "part"]).select("label", "dim", "pair.*", "side", "rep", "cnt", "vec")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "rep"]).reset_index(drop=True)
        n = int((pdf["side"] == 0).sum())
        x, rep, cnt = unit(pdf["vec"]), pdf["rep"].to_numpy(), pdf["cnt"].to_numpy()
        a = CoverTree(x[:n])
        same = bool((pdf["cell"].iloc[0] == pdf["other"].iloc[0]) and (pdf["part"].iloc[0] == pdf["other_part"].iloc[0]))
        b = a if same else CoverTree(x[n:]) if n < len(x) else None
        links, ends = np.zeros(len(x), dtype=np.int64), [(np.empty(0, dtype=np.int64),) * 2]
        for i, j in dual_pairs(a, b, cosine) if b is not None and n else ():
            j = j if same else j + n
            np.add.at(links, i, cnt[j])
            np.add.at(links, j, cnt[i])
            ends.append((i, j))
        order = np.argsort(rep, kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        i, j = (back[np.concatenate(e)] for e in zip(*ends))
        item, root = local_stars(len(x), i, j)
        has = np.flatnonzero(links)
        sorted_rep = rep[order]
        return pd.DataFrame({
            "rep": np.concatenate([rep[has], sorted_rep[item]]),
            "other": pd.array([None] * len(has) + sorted_rep[root].tolist(), dtype="Int64"),
            "n": np.concatenate([links[has], np.zeros(len(item), dtype=np.int64)]),
        })

    return rows.groupBy("label", "dim", "cell", "part", "other", "other_part").applyInPandas(join, "rep long, other long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) per row: links of cosine >= the threshold between vectors of one label, none below it.

    Vectors that are null, empty, zero or hold null or non-finite components, and those of null label or id, link with nothing, as do vectors
    of different lengths. Equal vectors are one class and link with each other; only classes are compared.
    """
    rows, cls = classes(vectors, id_col, vec_col, label_col)
    found = cut(linked(cls, cosine), "linked")
    comp = connected_components(found.where("other is not null").select(F.col("rep").alias("u"), F.col("other").alias("v")))
    more = found.where("other is null").groupBy("rep").agg(F.sum("n").alias("n"))
    named = cls.join(comp.withColumnRenamed("id", "rep"), "rep", "left").join(more, "rep", "left").select(
        "label", "vec", (F.coalesce("n", F.lit(0)) + F.col("cnt") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")
    )
    out = rows.join(named, ["label", "vec"], "left")
    root = F.coalesce("component_id", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), (F.col("id") == root).alias("kept"))


def op4_embeddings(vectors: DataFrame) -> DataFrame:
    """The contract's row per vector. Null labels and ids, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing; rows of repeated ids are returned each, equal vectors link with each other; extra columns are ignored."""
    return near_duplicates(vectors).withColumnRenamed("id", "vec_id")
