"""Read views: overviews, leaders, timelines, replay frames, heat maps, quality counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.functions import seq


def shares(df: DataFrame, key: str, value: str, digits: int = 4) -> DataFrame:
    """A key's total and its share of all; the window spans the aggregated rows only."""
    per = df.groupBy(key).agg(F.sum(value).alias("total"))
    return per.withColumn("share", F.round(F.col("total") / F.sum("total").over(Window.partitionBy()), digits))


def leaders(df: DataFrame, order: list[Column], n: int = 5) -> DataFrame:
    """The first n of the order, which is a top-k in each task and one merge."""
    return df.orderBy(*order).limit(n)


def ranked(df: DataFrame, metric: str, tie: str) -> DataFrame:
    """Places by falling metric from 1, and the number of rows; no task sorts the whole table."""
    total = df.agg(F.count("*").alias("of"))  # one row
    t = seq.row_index(df, [], metric, [tie], "_k", descending=True)
    return t.crossJoin(F.broadcast(total)).withColumn("rank", (F.col("_k") + 1).cast("int")).drop("_k")


def timeline(*parts: DataFrame) -> DataFrame:
    """Union of event tables by name; what a part lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def replay(players: DataFrame, ball: DataFrame) -> DataFrame:
    """Per frame its players as a sorted array, with the ball where it was observed."""
    p = players.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("gid", "x", "y"))).alias("players"))
    return p.join(ball, "frame", "left")


def first_in_step(df: DataFrame, key: str, frame: str, step: int) -> DataFrame:
    """Of each key's frames the first one in every step, steps counted from the key's first frame."""
    lo = F.min(frame).over(Window.partitionBy(key))
    t = df.withColumn("_s", F.floor((F.col(frame) - lo) / step))
    return t.groupBy(key, "_s").agg(F.min(frame).alias(frame)).drop("_s")


def histogram2d(df: DataFrame, x: str, y: str, bounds: tuple[float, float, float, float], nx: int, ny: int) -> DataFrame:
    """Counts per cell; the upper edges belong to the last cells."""
    cell = lambda c, lo, hi, n: F.least(F.floor((F.col(c) - lo) / ((hi - lo) / n)), F.lit(n - 1)).cast("int")
    inside = F.col(x).between(bounds[0], bounds[1]) & F.col(y).between(bounds[2], bounds[3])
    return df.where(inside).groupBy(cell(x, bounds[0], bounds[1], nx).alias("cx"), cell(y, bounds[2], bounds[3], ny).alias("cy")).agg(F.count("*").alias("n"))


def search(df: DataFrame, text: str) -> DataFrame:
    """Rows that hold the text in any column, whatever its case."""
    return df.where(F.contains(F.lower(F.to_json(F.struct("*"))), F.lit(text.lower())))
