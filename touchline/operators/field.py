"""The playing field in the picture: polygons at key frames, and how far inside them a point is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.functions import seq


def signed_distance(x: Column, y: Column, points: Column) -> Column:
    """Distance of (x, y) to the nearest edge of a polygon, an array of (x, y); negative outside (even-odd rule), null for fewer than three points."""
    px, py = x.cast("double"), y.cast("double")
    following = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    edges = F.zip_with(points, following, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))

    def squared(e: Column) -> Column:
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        n = dx * dx + dy * dy
        t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - e["ax"]) * dx + (py - e["ay"]) * dy) / n))).otherwise(0.0)
        qx, qy = e["ax"] + t * dx - px, e["ay"] + t * dy - py
        return qx * qx + qy * qy

    def crosses(e: Column) -> Column:
        return F.when(((e["ay"] > py) != (e["by"] > py)) & (px < (e["bx"] - e["ax"]) * (py - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"]), 1).otherwise(0)

    far = F.sqrt(F.array_min(F.transform(edges, squared)))
    odd = F.aggregate(edges, F.lit(0), lambda s, e: s + crosses(e)) % 2 == 1
    return F.when(F.size(points) >= 3, F.when(odd, far).otherwise(-far))


def polygons_at(rows: DataFrame, keyframes: DataFrame, keys: list[str], frame: str = "frame", points: str = "points", width: int = 1024) -> DataFrame:
    """rows with the polygon of their frame. keyframes (keys, frame, points array<struct<x: double, y: double>>) has one polygon per key and frame.

    Between two key frames the polygons are blended point by point if they have as many; else the nearer one holds (the earlier on ties), as points of unlike polygons aren't each other's. Beyond the
    first and the last key frame these hold. Rows of keys without polygons have null. Key frames meet rows in buckets of frames, so that no pair is a candidate twice.
    """
    w = Window.partitionBy(*keys).orderBy("_s")
    k = keyframes.select(*keys, F.col(frame).cast("long").alias("_s"), F.col(points).alias("_p"))
    ends = k.groupBy(*keys).agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    spans = k.withColumn("_t", F.lead("_s").over(w)).withColumn("_q", F.lead("_p").over(w))
    # spans are half open, the last one has one frame
    spans = spans.withColumn("_e", F.coalesce("_t", F.col("_s") + 1))
    t = rows.join(ends, keys) if keys else rows.crossJoin(F.broadcast(ends))  # without keys: one row
    t = t.withColumn("_at", F.greatest("_lo", F.least("_hi", F.col(frame).cast("long"))))
    t = seq.range_join(t, spans, "_at", "_s", "_e", width, keys, half_open=True)
    part = (F.col("_at") - F.col("_s")) / (F.col("_t") - F.col("_s"))
    blend = F.zip_with("_p", "_q", lambda a, b: F.struct((a["x"] * (1 - part) + b["x"] * part).alias("x"), (a["y"] * (1 - part) + b["y"] * part).alias("y")))
    nearer = F.when(F.col("_at") - F.col("_s") <= F.col("_t") - F.col("_at"), F.col("_p")).otherwise(F.col("_q"))
    polygon = F.when(F.col("_t").isNull() | (F.col("_at") == F.col("_s")), F.col("_p")).when(F.size("_p") == F.size("_q"), blend).otherwise(nearer)
    out = t.select(*rows.columns, polygon.alias(points))
    if not keys:
        return out
    without = rows.join(ends.select(*keys), keys, "left_anti").select(*rows.columns).withColumn(points, F.lit(None).cast(dict(keyframes.dtypes)[points]))
    return out.unionByName(without)


def on_field(rows: DataFrame, keyframes: DataFrame, keys: list[str], x: Column, y: Column, margin: float = 0.0, frame: str = "frame") -> DataFrame:
    """rows with their distance into the field, `inside_by` (negative outside), and whether they are within the margin around it; false where there is no polygon."""
    t = polygons_at(rows, keyframes.withColumnRenamed("points", "_points"), keys, frame, "_points")
    t = t.withColumn("inside_by", signed_distance(x, y, F.col("_points")))
    return t.withColumn("on_field", F.coalesce(F.col("inside_by") >= -margin, F.lit(False))).drop("_points")
