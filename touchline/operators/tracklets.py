"""Tracklets: features, similarities, constrained merging, presence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unit(v: Column) -> Column:
    """v over its length; as it is where that is next to nothing."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(n > 1e-6, F.transform(v, lambda x: x / n)).otherwise(v)


def per_dimension(rows: DataFrame, keys: list[str], vec: str, how, name: str = "feature") -> DataFrame:
    """`how` (an aggregate of a column) of each dimension of a key's vectors, over unit length. Dimensions are aggregated apart, so that no key's vectors meet in one row."""
    x = rows.where(F.col(vec).isNotNull()).select(*keys, F.posexplode(F.col(vec).cast("array<double>")).alias("_i", "_v"))
    per = x.groupBy(*keys, "_i").agg(how(F.col("_v")).alias("_v"))
    v = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda s: s["_v"])
    return per.groupBy(*keys).agg(v.alias(name)).withColumn(name, unit(F.col(name)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays; 0 where one of them doesn't vary."""
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    less = lambda v: F.transform(v, lambda x: x - mean(v))
    p, q = less(a), less(b)
    n = F.sqrt(dot(p, p) * dot(q, q))
    return F.when(n > 0, dot(p, q) / n).otherwise(0.0)


def similar_pairs(tracks: DataFrame, frames: DataFrame, w_feature: float = 0.6, w_colour: float = 0.4, least_colour: float = 0.0) -> DataFrame:
    """tracks (match, gid, feature, colour, team), frames (match, gid, frame) -> (match, a, b, similarity) of a match's tracklets that no frame holds both.

    Pairs with two known, different teams or a colour correlation below the bound are left out, and so are tracklets without features. Who is
    seen together comes from an equi-join on frames; pairs are made within a match only.
    """
    a = frames.select("match", "frame", F.col("gid").alias("a"))
    b = frames.select("match", "frame", F.col("gid").alias("b"))
    together = a.join(b, ["match", "frame"]).where("a < b").select("match", "a", "b").distinct()
    known = tracks.where("feature is not null and colour is not null")
    left = known.select("match", *[F.col(c).alias(f"a_{c}" if c != "gid" else "a") for c in ("gid", "feature", "colour", "team")])
    right = known.select("match", *[F.col(c).alias(f"b_{c}" if c != "gid" else "b") for c in ("gid", "feature", "colour", "team")])
    p = left.join(right, "match").where("a < b and coalesce(a_team = b_team, true)").join(together, ["match", "a", "b"], "left_anti")
    p = p.withColumn("_c", correlation(F.col("a_colour"), F.col("b_colour"))).where(F.col("_c") >= least_colour)
    return p.select("match", "a", "b", (w_feature * dot(F.col("a_feature"), F.col("b_feature")) + w_colour * F.col("_c")).alias("similarity"))


def merged(tracks: DataFrame, pairs: DataFrame, floor: float, target: int) -> DataFrame:
    """(match, gid, root): pairs of falling similarity (the larger ids first on ties) join two groups of a match, down to the floor or until `target` groups are left.

    tracks (match, gid, team, frames): groups join only if no frame holds both and their teams agree; the one with more frames takes the other in. The order matters, so that a match's
    tracklets meet in one task; matches are worked on apart.
    """

    def fold(own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        root = {g: g for g in own["gid"]}
        seen = {g: set(f) for g, f in zip(own["gid"], own["frames"])}
        teams = {g: set() if pd.isna(t) else {t} for g, t in zip(own["gid"], own["team"])}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        left = len(root)
        for r in links.sort_values(["similarity", "a", "b"], ascending=False).itertuples():
            if left <= target or r.similarity < floor:
                break
            a, b = find(r.a), find(r.b)
            if a == b or seen[a] & seen[b] or len(teams[a] | teams[b]) > 1:
                continue
            if len(seen[a]) < len(seen[b]):
                a, b = b, a
            root[b] = a
            seen[a] |= seen.pop(b)
            teams[a] |= teams.pop(b)
            left -= 1
        return pd.DataFrame({"match": own["match"], "gid": own["gid"], "root": [find(g) for g in own["gid"]]})

    return tracks.groupBy("match").cogroup(pairs.groupBy("match")).applyInPandas(fold, "match long, gid long, root long")


def presence(rows: DataFrame, person: str, local: str, frame: str, least: float, most: int | None = None, backfill: int = 0) -> DataFrame:
    """Per person: its sorted local ids, frames, first and last one, share of all frames, and a rank by (share, frames, smaller id), counted from 1.

    Those below the least share go, but for the best `backfill`; with most, the first so many stay. The rank spans a row per person.
    """
    total = rows.agg(F.count_distinct(frame).alias("_t"))  # one row
    per = rows.groupBy(person).agg(
        F.array_join(F.array_sort(F.collect_set(local)), ";").alias("local_ids"), F.count_distinct(frame).alias("frames"), F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame")
    )
    per = per.crossJoin(F.broadcast(total)).withColumn("ratio", F.round(F.col("frames") / F.col("_t"), 6)).drop("_t")
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("ratio").desc(), F.col("frames").desc(), person)))
    per = per.where((F.col("ratio") >= least) | (F.col("rank") <= backfill))
    return per if most is None else per.where(F.col("rank") <= most)


def circular_mean(angle: Column, weight: Column, period: float) -> Column:
    """Weighted mean of angles on a circle of that period, as an aggregate; null without weight."""
    turn = angle * (2 * 3.141592653589793 / period)
    d = lambda c: F.sum(c.cast("decimal(28,12)")).cast("double")
    s, c = d(weight * F.sin(turn)), d(weight * F.cos(turn))
    return F.when(d(weight) > 0, F.pmod(F.degrees(F.atan2(s, c)) * (period / 360), F.lit(period)))


def representative_hsv(pixels: DataFrame, key: str) -> DataFrame:
    """(key, hue, saturation, value) of a jersey's pixels (key, h, s, v; OpenCV's bytes): white ones by the medians of their pale pixels, with hue 0; others by the circular mean hue, weighted by saturation, and the medians of
    the colourful ones; all medians where none is colourful. Bytes have 256 values, so that the medians' buffers stay small."""
    pale, white, colourful = (F.col("s") < 55) & (F.col("v") >= 80), (F.col("s") < 45) & (F.col("v") >= 100), F.col("s") >= 45
    middle = lambda c, where=None: F.percentile(F.col(c) if where is None else F.when(where, F.col(c)), F.lit(0.5))
    angle, weight = F.radians(F.col("h") * 2.0), F.col("s") / 255.0
    part = lambda f: F.sum(F.when(colourful, f(angle) * weight).cast("decimal(28,12)")).cast("double")
    t = pixels.groupBy(key).agg(
        (F.count_if(white) / F.count("*")).alias("w"), F.count_if(colourful).alias("c"), part(F.sin).alias("sin"), part(F.cos).alias("cos"), middle("h").alias("h"),
        *[middle(x, cond).alias(f"{x}_{n}") for x in "sv" for n, cond in (("all", None), ("pale", pale), ("col", colourful))],
    )
    turn = F.degrees(F.atan2("sin", "cos"))
    hue = F.pmod(F.when(turn < 0, turn + 360.0).otherwise(turn), F.lit(360.0)) / 2.0
    pick = lambda x: F.when(F.col("w") >= 0.55, F.col(f"{x}_pale")).when(F.col("c") == 0, F.col(f"{x}_all")).otherwise(F.col(f"{x}_col"))
    return t.select(key, F.round(F.when(F.col("w") >= 0.55, 0.0).when(F.col("c") == 0, F.col("h")).otherwise(hue), 6).alias("hue"), pick("s").alias("saturation"), pick("v").alias("value"))
