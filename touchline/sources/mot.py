"""Track files: comma-separated detections, one based frames, and the tables derived from other text sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lines

SCHEMA = "frame double, global_id double, x double, y double, w double, h double, confidence double, a double, b double, c double"


def read_mot(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Detections with frame_proc counted from 0. strict: a file without rows is an error here; a line that isn't empty and lacks one of the seven numbers, a frame below 1 or a repeated (frame, id) fail the query, where they are read. Else lines without a frame are left out."""
    if strict:
        text = spark.read.text(path).where(F.trim("value") != "")
        if text.isEmpty():
            raise ValueError(f"no detections in {path}")
        n = lines.fields(F.col("value"), 7)
        whole = F.lit(True)
        for c in n:
            whole = whole & c.isNotNull()
        told = F.assert_true(whole & (n[0] >= 1), F.concat(F.lit("a line lacks one of seven numbers or has a frame below 1: "), F.substring("value", 1, 80)))
        rows = text.where(told.isNull()).select(*[c.alias(x) for c, x in zip(n, ("frame", "global_id", "x", "y", "w", "h", "confidence"))])
    else:
        rows = spark.read.schema(SCHEMA).csv(path).where("frame is not null")
    out = rows.select((F.col("frame").cast("int") - 1).alias("frame_proc"), F.col("global_id").cast("int").alias("global_id"), "x", "y", "w", "h", "confidence")
    if not strict:
        return out
    n = out.groupBy("frame_proc", "global_id").agg(F.count("*").alias("n"))
    bad = F.assert_true(F.col("n") == 1, F.lit("a frame holds an id more than once"))
    return out.join(n, ["frame_proc", "global_id"]).where(bad.isNull()).drop("n")


def write_mot(df: DataFrame, path: str) -> None:
    """Boxes with one decimal, confidence with three, frames from 1, and the three unused fields."""
    n = lambda c, d: F.format_string(f"%.{d}f", F.col(c).cast("double"))
    line = F.concat_ws(",", (F.col("frame_proc") + 1).cast("string"), F.col("global_id").cast("string"), *[n(c, 1) for c in "xywh"], n("confidence", 3), F.lit("-1,-1,-1"))
    df.orderBy("frame_proc", "global_id").select(line.alias("value")).write.mode("errorifexists").text(path)


def read_ball(spark: SparkSession, path: str, what: str = "ball positions") -> DataFrame:
    """Observed ball points; a missing flag counts as observed, of a frame's rows the last line stays (files of a folder follow each other by name). No rows, or none that are observed, are an error."""
    rows = lines.in_order(spark.read.option("header", True).csv(path))
    seen = F.lower(F.trim(F.coalesce(F.col("observed"), F.lit("1")))).isin("1", "true", "yes") if "observed" in rows.columns else F.lit(True)
    rows = rows.where(seen)
    if rows.isEmpty():
        raise ValueError(f"no {what} in {path}")
    last = lambda c: F.max_by(F.col(c).cast("double"), F.struct("_file", "_line")).alias(c)
    return rows.groupBy(F.col("frame_proc").cast("double").cast("int").alias("frame_proc")).agg(last("ball_x_px"), last("ball_y_px"))


def read_team_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).select(F.col("global_id").cast("int").alias("global_id"), "team_id")


def read_homographies(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Accepted frames' finite 3x3 matrices, row by row, from a calibration document. Strictly, a document whose validation wasn't passed, or without an accepted matrix, is an error."""
    frame = "struct<proc_idx:int,accepted:boolean,H_image_to_pitch_m:array<array<double>>>"
    document = spark.read.option("multiLine", True).schema(f"validation struct<passed:boolean>, frames array<{frame}>").json(path)
    rows = document.select(F.explode("frames").alias("f"))
    if strict:
        if not document.where("validation.passed").isEmpty() and not read_homographies(spark, path).isEmpty():
            return read_homographies(spark, path)
        raise ValueError(f"not a validated calibration: {path}")
    h = F.flatten("f.H_image_to_pitch_m")
    fine = (F.size(h) == 9) & F.forall(h, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(F.coalesce("f.accepted", F.lit(True)) & fine).select(F.col("f.proc_idx").alias("frame_proc"), h.alias("h"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder with length and SHA-256."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
