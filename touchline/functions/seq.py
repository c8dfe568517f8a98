"""Ordered operations over per-key frame sequences: islands, gaps, moving medians, as-of and range joins, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import cut


def several(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def runs(df: DataFrame, key: str | list[str], frame: str, name: str = "run") -> DataFrame:
    """Adds an island key that consecutive frames of a key share: frame minus its row number, so that only the key's rows meet in a window."""
    return df.withColumn(name, F.col(frame) - F.row_number().over(Window.partitionBy(*several(key)).orderBy(frame)))


def sessions(df: DataFrame, key: str | list[str], at: str, gap: float, name: str = "session", ties: tuple[str, ...] = ()) -> DataFrame:
    """Numbers a key's sessions from 1: a row further than `gap` from the one before begins the next."""
    w = Window.partitionBy(*several(key)).orderBy(at, *ties)
    new = F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w)).drop("_new")


def moving_median(value: Column, window: int, partition: list[str], frame: str) -> Column:
    """Centred median over an odd number of rows; beyond its ends a run repeats its first and last value."""
    r = window // 2
    w = Window.partitionBy(*partition).orderBy(frame)
    near = F.collect_list(value).over(w.rowsBetween(-r, r))
    n, k = F.count("*").over(Window.partitionBy(*partition)), F.row_number().over(w)
    left, right = F.greatest(F.lit(0), r + 1 - k).cast("int"), F.greatest(F.lit(0), k + r - n).cast("int")
    padded = F.concat(F.array_repeat(F.element_at(near, 1), left), near, F.array_repeat(F.element_at(near, -1), right))
    return F.get(F.sort_array(padded), F.lit(r))


def fill_gaps(df: DataFrame, keys: list[str], frame: str, values: list[str], most: int) -> DataFrame:
    """Linear values for missing frames where at most `most` are missing between two observed ones; `source` tells which rows are which."""
    w = Window.partitionBy(*keys).orderBy(frame) if keys else Window.orderBy(frame)
    nxt = df.withColumn("_to", F.lead(frame).over(w))
    for v in values:
        nxt = nxt.withColumn(f"_{v}", F.lead(v).over(w))
    span = F.col("_to") - F.col(frame)
    last = F.when(F.col("_to").isNotNull() & (span - 1 <= most), F.col("_to") - 1).otherwise(F.col(frame))
    out = nxt.withColumn("_at", F.explode(F.sequence(F.col(frame), last)))
    part = (F.col("_at") - F.col(frame)) / span
    seen = F.col("_at") == F.col(frame)
    cols = [F.when(seen, F.col(v)).otherwise(F.col(v) + (F.col(f"_{v}") - F.col(v)) * part).alias(v) for v in values]
    return out.select(*keys, F.col("_at").alias(frame), *cols, F.when(seen, "observed").otherwise("interpolated").alias("source"))


def range_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: int, keys: list[str] | None = None, half_open: bool = False) -> DataFrame:
    """points within [start, end] of spans ([start, end) if half_open), as an equi-join on buckets of `width`: each span goes to the buckets it touches, and no pair is a candidate twice."""
    p = points.withColumn("_bucket", F.floor(F.col(at) / width))
    s = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    within = (F.col(at) >= F.col(start)) & ((F.col(at) < F.col(end)) if half_open else (F.col(at) <= F.col(end)))
    return p.join(s, ["_bucket", *(keys or [])]).where(within).drop("_bucket")


def as_of_accepted(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, accepted: str) -> DataFrame:
    """as_of() over right's accepted rows; a row of left at a place that right rejects has no value."""
    bad = right.where(~F.col(accepted)).select(*keys, F.col(at), F.lit(True).alias("_no")).distinct()
    out = as_of(left, right.where(accepted), keys, at, value).join(bad, [*keys, at], "left")
    return out.select(*[c for c in left.columns if c != value], *[F.when(F.col("_no").isNull(), F.col(c)).alias(c) for c in (f"{value}_at", value)])


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, tolerance: float | None = None) -> DataFrame:
    """left with the latest earlier and the earliest later row of right, and the nearer of both (the earlier on ties): two running windows over the union, no pairs."""
    rows = left.withColumn("_r", F.lit(1)).unionByName(right.select(*keys, at, value).withColumn("_r", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "_r").rowsBetween(Window.unboundedPreceding, 0)
    mine = F.when(F.col("_r") == 0, F.struct(F.col(at).alias("t"), F.col(value).alias("v")))
    back = F.last(mine, True).over(w)
    ahead = Window.partitionBy(*keys).orderBy(F.col(at).desc(), "_r").rowsBetween(Window.unboundedPreceding, 0)
    fore = F.last(mine, True).over(ahead)
    out = rows.withColumn("_b", back).withColumn("_f", fore).where("_r = 1")
    db, df_ = F.col(at) - F.col("_b.t"), F.col("_f.t") - F.col(at)
    pick = F.when(df_.isNull() | (db <= df_), F.col("_b")).otherwise(F.col("_f"))
    out = out.withColumn("_p", pick)
    if tolerance is not None:
        out = out.withColumn("_p", F.when(F.abs(F.col("_p.t") - F.col(at)) <= tolerance, F.col("_p")))
    cols = [c for c in left.columns if c != value]
    return out.select(*cols, F.col("_p.t").alias(f"{value}_at"), F.col("_p.v").alias(value))


def between_keys(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: str, unit: int | None = None) -> DataFrame:
    """left with right's array of doubles, linear between the two rows of right around each row; beyond the first and the last one it is held, and null where a key has none.

    With unit, a place in the array (8 for the last number of a homography), each array is divided by its number there before and after it is blended, so that scaled forms of one matrix are one.
    """
    if unit is not None:
        one = lambda c: F.transform(c, lambda x: x / F.get(c, F.lit(unit)))
        out = between_keys(left, right.withColumn(values, one(F.col(values))), keys, at, values)
        return out.withColumn(values, one(F.col(values)))
    rows = left.withColumn("_r", F.lit(1)).unionByName(right.select(*keys, at, values).withColumn("_r", F.lit(0)), allowMissingColumns=True)
    mine = F.when(F.col("_r") == 0, F.struct(F.col(at).alias("t"), F.col(values).alias("v")))
    w = Window.partitionBy(*keys).orderBy(at, "_r").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.col(at).desc(), "_r").rowsBetween(Window.unboundedPreceding, 0)
    b, f = F.col("_b"), F.col("_f")
    part = (F.col(at) - b["t"]) / (f["t"] - b["t"])
    lerp = F.zip_with(b["v"], f["v"], lambda p, q: p + (q - p) * part)
    pick = F.when(b.isNull(), f["v"]).when(f.isNull() | (f["t"] == b["t"]), b["v"]).otherwise(lerp)
    out = rows.withColumn("_b", F.last(mine, True).over(w)).withColumn("_f", F.last(mine, True).over(ahead)).where("_r = 1")
    return out.select(*[c for c in left.columns if c != values], pick.alias(values))


def row_index(df: DataFrame, keys: list[str], order: str, ties: list[str], name: str, descending: bool = False) -> DataFrame:
    """df with each row's place in its key's order, from 0 (nulls of `order` last), without a task that sorts a whole key.

    Rows are sorted once, in ranges of (keys, order, ties), and written with their range and place in it; a key's place is what its earlier ranges hold and its place in its own.
    A key of any size, or an order value that many rows share, is spread over as many ranges as it fills. Ties beyond `ties` fall as they come.
    """
    by = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last()
    parts = [*keys, by, *ties]
    low = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    t = cut(df.repartitionByRange(*parts).sortWithinPartitions(*parts).withColumn("_ri_part", F.spark_partition_id()).withColumn("_ri_at", low), "sorted")
    own = t.groupBy(*keys, "_ri_part").agg(F.min("_ri_at").alias("_ri_first"), F.count("*").alias("_ri_n"))
    before = F.sum("_ri_n").over(Window.partitionBy(*keys).orderBy("_ri_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range of a key
    own = own.select(*[F.col(k).alias(f"_ri_k_{k}") for k in keys], F.col("_ri_part").alias("_ri_q"), "_ri_first", F.coalesce(before, F.lit(0)).alias("_ri_before"))
    same = F.col("_ri_part") == F.col("_ri_q")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_ri_k_{k}"))
    return t.join(own, same).withColumn(name, F.col("_ri_at") - F.col("_ri_first") + F.col("_ri_before")).drop("_ri_part", "_ri_at", "_ri_q", "_ri_first", "_ri_before", *[f"_ri_k_{k}" for k in keys])


def percentile(df: DataFrame, keys: list[str], value: str, part: float, name: str) -> DataFrame:
    """(keys, name): the exact percentile of a key's values, linear between two of them, without a buffer or a sort of all values of a key; one row without keys, none for keys whose values are all null.

    Approximate quantiles on either side of it leave a few thousandths of the rows (all of a small key); the equal ones of these are counted and their running count has the value.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    ends = F.percentile_approx("_v", F.array(F.lit(max(0.0, part - 0.002)), F.lit(min(1.0, part + 0.002))), F.lit(5000))
    bound = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), ends.alias("_e"))
    small = F.col("_n") < 2000
    bound = bound.select(*keys, ((F.col("_n") - 1) * part).alias("_r"), F.when(small, F.col("_lo")).otherwise(F.get("_e", F.lit(0))).alias("_lo"), F.when(small, F.col("_hi")).otherwise(F.get("_e", F.lit(1))).alias("_hi"))
    near = (rows.join(bound, keys) if keys else rows.crossJoin(F.broadcast(bound))).where("_v <= _hi")  # without keys: one row
    per = near.groupBy(*keys, "_r", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()))
    per = per.withColumn("_upto", upto)
    at = lambda r: F.min(F.when(F.col("_upto") > r, F.col("_v")))
    out = per.groupBy(*keys, "_r").agg(at(F.floor("_r")).alias("_a"), at(F.ceil("_r")).alias("_b"))
    # the next larger value may lie beyond the bound only where the bound is the largest one
    return out.select(*keys, (F.col("_a") + (F.coalesce("_b", "_a") - F.col("_a")) * (F.col("_r") - F.floor("_r"))).alias(name))


def with_edges(df: DataFrame, keys: list[str], frame: str, size: int, halo: int) -> DataFrame:
    """df in blocks of `size` frames, `_block`, with `halo` frames of both neighbours; `_own` tells a block's own rows. A window over (keys, _block) then sees what a window over keys sees that reaches no further."""
    b = F.floor(F.col(frame) / size)
    t = df.withColumn("_block", F.explode(F.array_distinct(F.array(F.floor((F.col(frame) - halo) / size), b, F.floor((F.col(frame) + halo) / size)))))
    return t.withColumn("_own", F.floor(F.col(frame) / size) == F.col("_block"))


def round_robin(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows taken by turns from the groups, each group's best first."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("_k", rank).where(F.col("_k") <= n).orderBy("_k", group).limit(n).drop("_k")


def box_sum(df: DataFrame, frame: str, value: str, radius: int) -> DataFrame:
    """(frame, value): sums over 2 * radius + 1 frames of a sparse signal, missing ones counting 0. Each value goes to the frames that it reaches, so that no window spans the table."""
    near = F.explode(F.sequence(F.col(frame) - radius, F.col(frame) + radius))
    return df.select(near.alias(frame), value).groupBy(frame).agg(F.sum(F.col(value).cast("decimal(28,9)")).cast("double").alias(value))


def nearest(left: DataFrame, right: DataFrame, at: str, tolerance: int, prefix: str = "near_") -> DataFrame:
    """left with the nearest row of right within the tolerance, the earlier on ties, null where there is none: an equi-join on buckets as wide as the tolerance, each row of right in three of them."""
    r = right.select(F.struct(*right.columns).alias("_s"), F.col(at).alias("_at"))
    b = F.floor(F.col("_at") / tolerance)
    r = r.withColumn("_b", F.explode(F.array(b - 1, b, b + 1)))
    found = left.withColumn("_b", F.floor(F.col(at) / tolerance)).join(r, "_b").where(F.abs(F.col("_at") - F.col(at)) <= tolerance)
    best = found.groupBy(at).agg(F.min(F.struct(F.abs(F.col("_at") - F.col(at)).alias("d"), "_at", "_s")).alias("_m"))
    return left.join(best, at, "left").select(*left.columns, *[F.col(f"_m._s.{c}").alias(prefix + c) for c in right.columns])


def fill_within(df: DataFrame, keys: list[str], frame: str, values: list[str], most: int) -> DataFrame:
    """Linear values for the frames between two observed ones whose frame numbers differ by at most `most`; all rows are backed by such a pair or observed, and `observed` tells which."""
    w = Window.partitionBy(*keys).orderBy(frame)
    t = df.select(*keys, frame, *values, F.lead(frame).over(w).alias("_to"), *[F.lead(v).over(w).alias(f"_{v}") for v in values])
    span = F.col("_to") - F.col(frame)
    last = F.when(span <= most, F.col("_to") - 1).otherwise(F.col(frame))
    t = t.withColumn("_at", F.explode(F.sequence(F.col(frame), last)))
    seen = F.col("_at") == F.col(frame)
    cols = [F.when(seen, F.col(v)).otherwise(F.col(v) + (F.col(f"_{v}") - F.col(v)) * ((F.col("_at") - F.col(frame)) / span)).alias(v) for v in values]
    return t.select(*keys, F.col("_at").alias(frame), *cols, seen.alias("observed"))


def fill_all(df: DataFrame, keys: list[str], frame: str, values: list[str], margin: int, most: int) -> DataFrame:
    """Each key's frames from its first less margin to its last plus margin: linear between observed ones, held at the ends; `reliable` where observed or between two that are at most `most` apart."""
    w = Window.partitionBy(*keys).orderBy(frame)
    t = df.withColumn("_to", F.lead(frame).over(w)).withColumn("_from", F.lag(frame).over(w))
    for v in values:
        t = t.withColumn(f"_{v}", F.lead(v).over(w))
    low = F.when(F.col("_from").isNull(), F.col(frame) - margin).otherwise(F.col(frame))
    high = F.when(F.col("_to").isNull(), F.col(frame) + margin).otherwise(F.col("_to") - 1)
    t = t.withColumn("_at", F.explode(F.sequence(low, high)))
    part = (F.col("_at") - F.col(frame)) / (F.col("_to") - F.col(frame))
    ahead = (F.col("_at") > F.col(frame)) & F.col("_to").isNotNull()
    cols = [F.when(ahead, F.col(v) + (F.col(f"_{v}") - F.col(v)) * part).otherwise(F.col(v)).alias(v) for v in values]
    sure = (F.col("_at") == F.col(frame)) | (ahead & (F.col("_to") - F.col(frame) <= most))
    return t.select(*keys, F.col("_at").alias(frame), *cols, F.coalesce(sure, F.lit(False)).alias("reliable"))
