"""Running metrics: smoothed paths, steps, speeds, bouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.functions import seq


def timeseries(points: DataFrame, fps: float, window: int = 11, keys: tuple[str, ...] = ()) -> DataFrame:
    """points (gid, frame, x, y; one row per id and frame) -> smoothed path with step and speed. Runs shorter than the window are left out; segments count from 1.

    keys, here and below, are columns that name a match: ids of different matches are different ids.
    """
    who = [*keys, "gid"]
    r = seq.runs(points, who, "frame")
    r = r.withColumn("_n", F.count("*").over(Window.partitionBy(*who, "run"))).where(F.col("_n") >= window)
    for c in "xy":
        r = r.withColumn(f"{c}_smooth", seq.moving_median(F.col(c), window, [*who, "run"], "frame"))
    w = Window.partitionBy(*who, "run").orderBy("frame")
    dx, dy = (F.col(f"{c}_smooth") - F.lag(f"{c}_smooth").over(w) for c in "xy")
    step = F.sqrt(dx * dx + dy * dy)
    segment = F.dense_rank().over(Window.partitionBy(*who).orderBy("run"))
    return r.withColumn("step", step).withColumn("speed", F.col("step") * fps).withColumn("segment", segment).drop("run", "_n")


def summary(ts: DataFrame, high: float = 4.5, keys: tuple[str, ...] = ()) -> DataFrame:
    m = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
    return ts.groupBy(*keys, "gid").agg(
        F.count("*").alias("frames"), F.max("segment").cast("long").alias("segments"), F.count("step").alias("steps"),
        F.round(F.coalesce(m(F.col("step")), F.lit(0.0)), 3).alias("distance_m"),
        F.round(F.coalesce(m(F.when(F.col("speed") > high, F.col("step"))), F.lit(0.0)), 3).alias("high_speed_m"),
        F.round(F.percentile("speed", F.lit(0.95)), 3).alias("p95_speed"), F.round(F.max("speed"), 3).alias("max_speed"),
    )


def naive_motion(points: DataFrame, longest_gap: int = 2) -> DataFrame:
    """Distance over steps of at most so many frames."""
    w = Window.partitionBy("gid").orderBy("frame")
    p = points.select("gid", "frame", (F.col("frame") - F.lag("frame").over(w)).alias("g"), (F.col("x") - F.lag("x").over(w)).alias("dx"), (F.col("y") - F.lag("y").over(w)).alias("dy"))
    d = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    return p.groupBy("gid").agg(F.count("*").alias("samples"), F.round(F.coalesce(F.sum(F.when(F.col("g") <= longest_gap, d).cast("decimal(38,9)")).cast("double"), F.lit(0.0)), 3).alias("distance"))


def bouts(speeds: DataFrame, high: float, join_gap: int, least: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Bouts of fast frames: frames above `high` whose distance is at most join_gap frames belong together; a bout has at least so many of them."""
    fast = speeds.where(F.col("speed") > high)
    s = seq.sessions(fast, [*keys, "gid"], "frame", join_gap + 1, "bout")
    return s.groupBy(*keys, "gid", "bout").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("fast_frames"), F.max("speed").alias("peak")).where(F.col("fast_frames") >= least).drop("bout")


def rolling_peak(speeds: DataFrame, n: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Largest median over n following rows of an id, full windows only."""
    w = Window.partitionBy(*keys, "gid").orderBy("frame").rowsBetween(0, n - 1)
    v = F.sort_array(F.collect_list("speed").over(w))
    t = speeds.select(*keys, "gid", F.count("speed").over(w).alias("k"), v.alias("v")).where(F.col("k") == n)
    mid = (F.get("v", F.lit((n - 1) // 2)) + F.get("v", F.lit(n // 2))) / 2
    return t.groupBy(*keys, "gid").agg(F.round(F.max(mid), 6).alias("peak"))
