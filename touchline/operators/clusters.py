"""Colour clusters: k-means modes, how well they part, and a key's best row."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.functions import seq
from touchline.functions.tables import cut


def modes(rows: DataFrame, vec: str, k: int, seed: int = 0) -> DataFrame:
    """(mode, centre, n, share): k-means centres in their own order, so that labels are stable, with their rows' number and share."""
    x = rows.where(F.col(vec).isNotNull()).select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed).fit(x)
    raw = [[float(v) for v in c] for c in model.clusterCenters()]  # k vectors
    names = {raw.index(c): m for m, c in enumerate(sorted(raw))}
    mode = F.element_at(F.create_map(*[F.lit(v) for pair in names.items() for v in pair]), F.col("prediction"))
    n = model.transform(x).groupBy(mode.alias("mode")).agg(F.count("*").alias("n"))
    centres = rows.sparkSession.createDataFrame([(m, c) for m, c in enumerate(sorted(raw))], "mode int, centre array<double>")
    total = n.agg(F.sum("n").alias("_t"))  # one row
    return centres.join(n, "mode").crossJoin(F.broadcast(total)).select("mode", "centre", "n", F.round(F.col("n") / F.col("_t"), 6).alias("share"))


def silhouette(rows: DataFrame, vec: str, label: str, dim: int) -> DataFrame:
    """(silhouette, n) by squared distances, over all rows: a row's mean distance to a cluster follows from the cluster's count, sum vector and sum of squares, so no rows are paired.

    The clusters' sums are one row; there must be few clusters. -1 where fewer than two have rows.
    """
    x = rows.where(F.col(label).isNotNull()).select(F.col(label).alias("l"), F.col(vec).cast("array<double>").alias("v"))
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e)
    per = x.groupBy("l").agg(F.count("*").alias("n"), F.sum(square(F.col("v"))).alias("q"), F.array(*[F.sum(F.get("v", F.lit(k))) for k in range(dim)]).alias("t"))
    all_ = per.agg(F.collect_list(F.struct("l", "n", "q", "t")).alias("c"))

    def total(c: Column) -> Column:
        inner = F.aggregate(F.zip_with("v", c["t"], lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)
        return c["n"] * square(F.col("v")) + c["q"] - 2 * inner

    own = F.get(F.transform(F.filter("c", lambda c: c["l"] == F.col("l")), lambda c: total(c) / F.greatest(c["n"] - 1, F.lit(1))), F.lit(0))
    other = F.array_min(F.transform(F.filter("c", lambda c: c["l"] != F.col("l")), lambda c: total(c) / c["n"]))
    t = x.crossJoin(F.broadcast(all_)).select(own.alias("a"), other.alias("b"))
    return t.agg(F.coalesce(F.round(F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-9))), 4), F.lit(-1.0)).alias("silhouette"), F.count("*").alias("n"))


def canonical(rows: DataFrame, key: str, gid: str, confidence: str) -> DataFrame:
    """Each key's id of the highest confidence (the smaller id on ties), and its ids in order."""
    best = F.max_by(gid, F.struct(F.coalesce(F.col(confidence), F.lit(0.0)), -F.col(gid)))
    return rows.groupBy(key).agg(best.alias("canonical"), F.array_join(F.array_sort(F.collect_set(gid)), ";").alias("gids"))


def bucket_best(rows: DataFrame, key: str, frame: str, buckets: int, order: list[str]) -> DataFrame:
    """Of each key's frames, cut in so many equal spans, the best row of every span: a join with the key's ends and one max of structs."""
    ends = rows.groupBy(key).agg(F.min(frame).alias("_lo"), F.max(frame).alias("_hi"))
    place = F.least(F.floor((F.col(frame) - F.col("_lo")) * buckets / (F.col("_hi") - F.col("_lo") + 1)), F.lit(buckets - 1)).cast("int")
    t = rows.join(ends, key).withColumn("bucket", place)
    return t.groupBy(key, "bucket").agg(F.max(F.struct(*order, (-F.col(frame)).alias("_f"))).alias("m")).select(key, "bucket", *[F.col(f"m.{c}") for c in order], (-F.col("m._f")).alias(frame))


def sampled_silhouette(rows: DataFrame, vec: str, label: str, order: str, most: int = 800) -> DataFrame:
    """(silhouette, n) by plain distances of at most `most` rows, spread evenly over the order: as many as may be paired. Rows alone in their cluster count 0; null where fewer than two clusters have rows."""
    x = rows.where(F.col(label).isNotNull() & F.col(vec).isNotNull())
    total = x.agg(F.count("*").alias("_n"))  # one row
    step = F.ceil(F.col("_n") / most)
    x = seq.row_index(x.select(order, F.col(label).alias("l"), F.col(vec).cast("array<double>").alias("v")), [], order, [], "_k")
    x = cut(x.crossJoin(F.broadcast(total)).where(F.col("_k") % step == 0).select("_k", "l", "v"), "sample")
    y = x.select(F.col("_k").alias("k2"), F.col("l").alias("l2"), F.col("v").alias("v2"))
    dist = F.sqrt(F.aggregate(F.zip_with("v", "v2", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, e: s + e))
    # at most `most` rows on either side
    near = x.crossJoin(F.broadcast(y)).where("_k <> k2").groupBy("_k", "l", "l2").agg(F.avg(dist).alias("d"))
    per = near.groupBy("_k").agg(F.min(F.when(F.col("l") == F.col("l2"), F.col("d"))).alias("a"), F.min(F.when(F.col("l") != F.col("l2"), F.col("d"))).alias("b"))
    s = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.where("b is not null").agg(F.round(F.avg(s), 6).alias("silhouette"), F.count("*").alias("n"))


def open_modes(rows: DataFrame, vec: str, k: int, share: float = 0.12, separation: float = 0.35, part: float = 0.97, seed: int = 0) -> DataFrame:
    """(mode, centre, radius, n, separation): the two largest of k appearance modes, as a table that assigned() reads; no rows where they hold less than `share` of all rows each or are nearer than `separation`.

    Mode 0 is the larger one (the first centre on ties). The radius is the percentile `part` of a mode's distances to its centre. Further modes stay open: what is in none of the two belongs to neither.
    """
    x = cut(rows.where(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("v")), "features")
    if x.limit(k * 10).count() < k * 10:
        raise ValueError("not enough features for so many modes")
    model = KMeans(k=k, seed=seed).fit(x.select(array_to_vector("v").alias("features")))
    centres = [[float(v) for v in c] for c in model.clusterCenters()]  # k vectors
    return radii(x, "v", centres, share, separation, part)


def radii(rows: DataFrame, vec: str, centres: list[list[float]], share: float, separation: float, part: float) -> DataFrame:
    """open_modes() for given centres: each row belongs to the nearest of them."""
    order = sorted(centres)
    table = F.array(*[F.array(*map(F.lit, c)) for c in order])
    square = lambda c: F.aggregate(F.zip_with(F.col(vec), c, lambda p, q: (p.cast("double") - q) * (p.cast("double") - q)), F.lit(0.0), lambda s, e: s + e)
    near = F.array_min(F.transform(table, lambda c, i: F.struct(F.sqrt(square(c)).alias("d"), i.alias("m"))))
    t = cut(rows.where(F.col(vec).isNotNull()).select(near.alias("n")).select("n.m", "n.d"), "nearest")
    sizes = t.groupBy("m").agg(F.count("*").alias("n"))  # a row for each centre
    first = Window.orderBy(F.col("n").desc(), "m")
    total = sizes.agg(F.sum("n").alias("total"))  # one row
    two = sizes.withColumn("mode", F.row_number().over(first) - 1).where("mode < 2").crossJoin(F.broadcast(total)).where(F.col("n") >= share * F.col("total"))
    two = two.join(seq.percentile(t, ["m"], "d", part, "radius"), "m").withColumn("centre", F.get(table, F.col("m")))
    both = two.agg(F.collect_list("centre").alias("c"))  # one row of two centres
    gap = F.sqrt(F.aggregate(F.zip_with(F.get("c", F.lit(0)), F.get("c", F.lit(1)), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, e: s + e))
    both = both.where(F.size("c") == 2).select(gap.alias("separation")).where(F.col("separation") >= separation)
    return two.crossJoin(F.broadcast(both)).select("mode", "centre", "radius", "n", "separation")


def assigned(rows: DataFrame, vec: str, model: DataFrame, margin: float = 0.08) -> DataFrame:
    """rows with `mode` 0 or 1 of an open_modes() table: the nearer centre, or -1 beyond its radius or where the other one is no further off than `margin` of their separation. All -1 without a model."""
    both = model.agg(F.sort_array(F.collect_list(F.struct("mode", "centre", "radius", "separation"))).alias("_model"))  # one row of two centres
    square = lambda c: F.aggregate(F.zip_with(F.col(vec), c, lambda p, q: (p.cast("double") - q) * (p.cast("double") - q)), F.lit(0.0), lambda s, e: s + e)
    t = rows.crossJoin(F.broadcast(both)).withColumn("_d", F.array_sort(F.transform("_model", lambda m: F.struct(F.sqrt(square(m["centre"])).alias("d"), m["mode"].alias("mode"), m["radius"].alias("r"), m["separation"].alias("s")))))
    a, b = F.get("_d", F.lit(0)), F.get("_d", F.lit(1))
    known = (a["d"] <= a["r"]) & (b["d"] - a["d"] >= margin * a["s"])
    return t.withColumn("mode", F.when(F.coalesce(known, F.lit(False)), a["mode"]).otherwise(-1)).drop("_model", "_d")
