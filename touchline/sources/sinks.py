"""Results as files: tables, reports, ball positions, split tracks, and their publication as a whole."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mot import write_mot


def write_table(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with just these columns in their order; what df lacks is empty, and a table without rows has its header."""
    cols = [F.col(c).cast("string").alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]
    df.select(*cols).write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(path)


def write_ball(df: DataFrame, path: str) -> None:
    """Ball positions by frame with three digits, all of them observed."""
    d = lambda c: F.format_string("%.3f", F.col(c).cast("double")).alias(c)
    df.orderBy("frame_proc").select("frame_proc", d("ball_x_px"), d("ball_y_px"), F.lit(1).alias("observed")).write.mode("errorifexists").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """One JSON object per row; nulls are written."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_split_mot(det: DataFrame, segments: DataFrame, path: str, map_path: str) -> None:
    """Detections under the ids of their segments, and what became of each id. segments: (frame_proc, global_id, segment, new_global_id)."""
    t = det.join(segments, ["frame_proc", "global_id"])
    write_mot(t.withColumn("global_id", F.col("new_global_id")), path)
    per = t.groupBy("global_id", "segment", "new_global_id").agg(F.min("frame_proc").alias("first_frame"), F.max("frame_proc").alias("last_frame"), F.count("*").alias("rows"))
    per.orderBy("global_id", "segment").write.mode("errorifexists").option("header", True).csv(map_path)


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return hadoop, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """write(folder) fills a work folder beside `path`, which takes that name once it is complete. An output that exists is refused before and after; a work folder that failed is left for inspection.

    The move is one rename of the file system; use it where renames are atomic.
    """
    hadoop, at, fs = _fs(spark, path)
    if fs.exists(at):
        raise FileExistsError(path)
    work = f"{path.rstrip('/')}.work-{time.strftime('%Y%m%d-%H%M%S')}-{uuid.uuid4().hex[:8]}"
    write(work)
    if fs.exists(at) or not fs.rename(hadoop.Path(work), at):
        raise FileExistsError(f"{path}; the result is in {work}")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(folder, name, length, path) of the files below a folder that may be given away; hidden ones and those of writers are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select(F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("folder"), name.alias("name"), "length", "path").where(~F.col("name").rlike(r"^[._]"))


def folder_totals(manifest: DataFrame) -> DataFrame:
    """Files and bytes per folder of a manifest's (path, length)."""
    return manifest.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
