"""Detections: deduplication, preflight, uniqueness, votes, remapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best_per_frame(det: DataFrame, keys: list[str], order: list[str], by: str | None = None) -> DataFrame:
    """Of each key's rows the one that is greatest by `order`; a max of structs, so that partial results shrink before the shuffle.

    With `by`, one of the keys, rows are dealt by it alone: where few rows repeat, that one shuffle serves what is joined or grouped by it next.
    """
    rest = [c for c in det.columns if c not in keys and c not in order]
    det = det.repartition(by) if by else det
    return det.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_m")).select(*keys, "_m.*")


def best_by_line(det: DataFrame, keys: list[str], conf: str, *line: str) -> DataFrame:
    """Of each key's rows the one of the highest confidence (null is the lowest), the first by `line` on ties, and how many others were removed."""
    rest = [c for c in det.columns if c not in keys]
    place = F.struct(F.coalesce(-F.col(conf), F.lit(float("inf"))), *line)
    per = det.groupBy(*keys).agg(F.min_by(F.struct(*rest), place).alias("_m"), (F.count("*") - 1).alias("removed"))
    return per.select(*keys, "_m.*", "removed")


def violations(det: DataFrame, keys: list[str]) -> DataFrame:
    return det.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def preflight(det: DataFrame) -> DataFrame:
    """Per id: records, frames, first and last one, coverage of its span, gaps and the longest, collisions."""
    per = det.groupBy("gid", "frame").agg(F.count("*").alias("c"))
    step = F.col("frame") - F.lag("frame").over(Window.partitionBy("gid").orderBy("frame"))
    per = per.withColumn("gap", step - 1)
    return per.groupBy("gid").agg(
        F.sum("c").alias("records"), F.count("*").alias("frames"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"),
        F.round(F.count("*") / (F.max("frame") - F.min("frame") + 1), 6).alias("coverage"),
        F.count_if(F.col("gap") > 0).alias("gap_count"), F.coalesce(F.max("gap"), F.lit(0)).cast("long").alias("max_gap"), F.count_if(F.col("c") > 1).alias("collisions"),
    )


def vote(det: DataFrame, track: str, good: Column, share: float, few: int = 3) -> DataFrame:
    """Tracks whose share of good rows is large enough, or that have too few rows to tell, with their counts."""
    per = det.groupBy(track).agg(F.count("*").alias("n"), F.count_if(good).alias("supported"))
    return per.where((F.col("n") < few) | (F.col("supported") >= share * F.col("n")))


def remap(det: DataFrame, mapping: DataFrame, id_col: str = "gid") -> DataFrame:
    """Rows of mapped ids, under their new id; the mapping is one row per id."""
    return det.join(mapping, id_col).drop(id_col)


def unmapped(det: DataFrame, mapping: DataFrame, id_col: str = "gid") -> DataFrame:
    return det.select(id_col).distinct().join(mapping, id_col, "left_anti")


def remap_events(events: DataFrame, assignments: DataFrame, id_col: str = "gid") -> DataFrame:
    """All events with player_id and team of their id's assignment (gid, player_id, team, reviewed), and whether a person must look: no id, no assignment, or one that isn't reviewed."""
    a = assignments.select(F.col("gid").alias(id_col), "player_id", "team", "reviewed")
    t = events.join(a, id_col, "left")
    return t.withColumn("identity_review_required", ~F.coalesce("reviewed", F.lit(False))).drop("reviewed")


def remap_counts(det: DataFrame, mapping: DataFrame, id_col: str = "gid") -> DataFrame:
    """One row: how many rows remap() writes, and how many it drops for want of an id."""
    known = mapping.select(id_col).distinct().withColumn("_known", F.lit(True))
    return det.join(known, id_col, "left").agg(F.count("_known").alias("written"), (F.count("*") - F.count("_known")).alias("dropped"))


def field_votes(det: DataFrame, track: str, good: Column, fits: Column, share: float = 0.25, least: float = 0.5, few: int = 3) -> DataFrame:
    """det without tracks that don't belong on the field, and without the rows that don't fit: a track stays if enough of its rows are good (or it has too few to tell) and enough of them fit."""
    per = det.groupBy(track).agg(F.count("*").alias("n"), F.count_if(good).alias("s"), F.count_if(fits).alias("f"))
    kept = per.where(((F.col("n") < few) | (F.col("s") >= share * F.col("n"))) & (F.col("f") >= least * F.col("n"))).select(track)
    return det.where(F.coalesce(fits, F.lit(False))).join(kept, track, "left_semi")
