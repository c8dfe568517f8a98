"""Side tables: hints, rosters, events, eligibility and assignments, from CSV and JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import tracks

from . import lines
from .mot import SCHEMA

#: Header names that mean the same in rosters.
ROSTER = {"name": ["name", "player", "player_name", "姓名", "球员"], "jersey_number": ["jersey_number", "number", "no", "号码", "球衣号码"], "team": ["team", "team_id", "球队", "队伍"]}
#: The lists of an eligibility document.
BUCKETS = ["eligible_confirmed", "excluded_conflict", "excluded_tentative", "excluded_unreadable", "excluded_non_player"]
UNRESOLVED = BUCKETS[1:4]


def read_mot_part(spark: SparkSession, path: str, ids: list[int] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Detections of those ids and frames (from 0, both ends included), filtered where they are read."""
    rows = spark.read.schema(SCHEMA).csv(path).where("frame is not null")
    if ids is not None:
        rows = rows.where(F.col("global_id").isin([float(i) for i in ids]))
    if start is not None:
        rows = rows.where(F.col("frame") >= start + 1)
    if end is not None:
        rows = rows.where(F.col("frame") <= end + 1)
    return rows.select((F.col("frame").cast("int") - 1).alias("frame_proc"), F.col("global_id").cast("int").alias("global_id"), "x", "y", "w", "h", "confidence")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a text file, lines counted from 0 in the file's order; any number of tasks read it."""
    return lines.numbered(lines.read_lines(spark, path)).select((F.col("line") - 1).cast("int").alias("line"), "value")


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(global_id, frame, x, y, w, h), frames counted from 1 as in the file; of an id's rows of a frame the last line stays. Files of a folder follow each other by name."""
    f = lines.fields(F.col("value"), 6)
    rows = lines.read_lines(spark, path).where(F.size(F.split("value", ",")) >= 6)
    rows = rows.select("_file", "_line", f[0].cast("int").alias("frame"), f[1].cast("int").alias("global_id"), *[f[k + 2].alias(c) for k, c in enumerate("xywh")])
    last = F.max_by(F.struct("x", "y", "w", "h"), F.struct("_file", "_line"))
    return rows.where("frame is not null and global_id is not null").groupBy("global_id", "frame").agg(last.alias("b")).select("global_id", "frame", "b.*")


def read_best(spark: SparkSession, path: str) -> DataFrame:
    """Detections without repeated (frame, id): the one of the highest confidence stays, the first line on ties; `removed` tells how many went. Lines without the seven numbers are left out."""
    f = lines.fields(F.col("value"), 7)
    rows = lines.read_lines(spark, path).select((f[0].cast("int") - 1).alias("frame_proc"), f[1].cast("int").alias("global_id"), *[f[k + 2].alias(c) for k, c in enumerate(("x", "y", "w", "h", "confidence"))], "_file", "_line")
    rows = rows.na.drop(subset=["frame_proc", "global_id", "x", "y", "w", "h", "confidence"])
    return tracks.best_by_line(rows, ["frame_proc", "global_id"], "confidence", "_file", "_line").drop("_file", "_line")


def track_ids(spark: SparkSession, path: str) -> DataFrame:
    """The different ids of a track file; lines without one are left out."""
    return spark.read.text(path).select(F.get(F.split("value", ","), F.lit(1)).try_cast("double").cast("int").alias("global_id")).where("global_id is not null").distinct()


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document as a row; a byte-order mark is left out, and what isn't JSON or isn't there gives no row."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    text = F.regexp_replace("value", "^﻿", "")
    got = spark.read.text(path, wholetext=True).select(F.from_json(text, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("d"))
    return got.where("d is not null and d._bad is null").select("d.*").drop("_bad")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a flat JSON object, values as text; none where the file is missing or broken."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "key string, value string")
    text = F.regexp_replace("value", "^﻿", "")
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json(text, "map<string,string>")).alias("key", "value"))


def read_events(spark: SparkSession, path: str, event: str) -> DataFrame:
    """Rows of an event document: an array of events, or an object that holds it as `events`."""
    text = F.ltrim(F.regexp_replace("value", "^﻿", ""))
    rows = F.when(F.startswith(text, F.lit("[")), F.from_json(text, f"array<struct<{event}>>")).otherwise(F.from_json(text, f"events array<struct<{event}>>")["events"])
    return spark.read.text(path, wholetext=True).select(F.explode(rows).alias("e")).select("e.*")


def _clean(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def _buckets(spark: SparkSession, path: str) -> DataFrame:
    item = "struct<global_id:int,team:string,predicted_number:int,confidence:double,is_player:boolean>"
    d = read_json(spark, path, ", ".join(f"{b} array<{item}>" for b in BUCKETS))
    lists = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(b).alias("bucket"), F.col(b).alias("items")) for k, b in enumerate(BUCKETS)])
    return d.select(F.explode(lists).alias("l")).select("l.place", "l.bucket", F.explode("l.items").alias("i")).select("place", "bucket", "i.*").where("global_id is not null")


def read_team_hints(spark: SparkSession, path: str) -> DataFrame:
    """(global_id, team) from a CSV file with a column team or team_id, or from an eligibility document; lower-cased, blank ones left out, the last list of an id counts."""
    if path.lower().endswith(".json"):
        t = _buckets(spark, path).groupBy("global_id").agg(F.max_by(_clean(F.col("team")), F.when(_clean(F.col("team")).isNotNull(), F.col("place"))).alias("team"))
    else:
        rows = spark.read.option("header", True).csv(path)
        name = "team" if "team" in rows.columns else "team_id"
        t = rows.select(F.col("global_id").try_cast("double").cast("int").alias("global_id"), _clean(F.col(name)).alias("team")).dropDuplicates(["global_id"])
    return t.where("global_id is not null and team is not null")


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """(name, jersey_number, team) of a CSV file or a JSON array, whatever its headers are called; rows without a name are left out."""
    js = path.lower().endswith(".json")
    rows = spark.read.option("multiLine", True).json(path) if js else spark.read.option("header", True).csv(path)
    known = {c.strip("﻿ ").lower(): c for c in rows.columns}
    pick = lambda names: F.coalesce(*[F.trim(F.col(f"`{known[n]}`").cast("string")) for n in names if n in known], F.lit(None).cast("string"))
    return rows.select(*[pick(names).alias(c) for c, names in ROSTER.items()]).where("name <> ''")


def confirmed_players(spark: SparkSession, path: str, teams: tuple[str, ...] = ("white", "yellow", "blue")) -> DataFrame:
    """(player, team, number, gids, confidence) of an eligibility document's confirmed ids with a number, of those teams only; player is team_number."""
    t = _buckets(spark, path).where("bucket = 'eligible_confirmed' and predicted_number is not null").withColumn("team", _clean(F.col("team"))).where(F.col("team").isin(*teams))
    per = t.groupBy("team", F.col("predicted_number").alias("number")).agg(F.array_sort(F.collect_set("global_id")).alias("gids"), F.min("confidence").alias("confidence"))
    return per.select(F.concat_ws("_", "team", F.col("number").cast("string")).alias("player"), "team", "number", "gids", "confidence")


def unresolved_players(spark: SparkSession, path: str) -> DataFrame:
    """(global_id, team, bucket) of the three lists of unresolved players; a later list overrides an earlier one, non-players go, a blank team is unknown."""
    t = _buckets(spark, path).where(F.col("bucket").isin(*UNRESOLVED))
    last = t.groupBy("global_id").agg(F.max_by(F.struct("team", "bucket", "is_player"), "place").alias("m")).select("global_id", "m.*")
    return last.where(F.coalesce("is_player", F.lit(True))).select("global_id", F.coalesce(_clean(F.col("team")), F.lit("unknown")).alias("team"), "bucket")


def read_assignments(spark: SparkSession, path: str, most: int) -> DataFrame:
    """(global_id, player_id, team) of a JSON object by id, whose values are a number or an object with player_id and team. A player_id outside 1..most or a blank team fails the query."""
    m = F.from_json(F.regexp_replace("value", "^﻿", ""), "map<string,string>")
    t = spark.read.text(path, wholetext=True).select(F.explode(m).alias("k", "v"))
    o = F.from_json("v", "player_id int, team string")
    t = t.select(F.col("k").cast("int").alias("global_id"), F.coalesce(F.col("v").try_cast("int"), o["player_id"]).alias("player_id"), o["team"].alias("team"), F.startswith(F.trim("v"), F.lit("{")).alias("_o"))
    good = F.coalesce(F.col("player_id").between(1, most), F.lit(False)) & (~F.col("_o") | F.col("team").isNull() | (F.trim("team") != ""))
    checked = F.assert_true(good, F.concat(F.lit("not a player or team: "), F.col("global_id").cast("string")))
    return t.where(checked.isNull()).select("global_id", "player_id", F.trim("team").alias("team"))


def crop_files(spark: SparkSession, path: str) -> DataFrame:
    """(global_id, frame, path) of the pictures gid_*/frame_*.jpg below a folder; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "frame_*.jpg").load(path).select("path")
    part = lambda p: F.regexp_extract("path", p, 1).try_cast("int")
    return files.select(part(r"gid_(\d+)/frame_").alias("global_id"), part(r"/frame_(\d+)\.jpg$").alias("frame"), "path").where("global_id is not null and frame is not null")


def read_audit(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV file of a manual audit or of candidates, all columns as text under trimmed names without a byte-order mark; columns that are lacking are an error, and rows without any value are left out."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.toDF(*[c.strip("\ufeff ") for c in rows.columns])
    lacking = [c for c in required if c not in rows.columns]
    if lacking:
        raise ValueError(f"{path} lacks {lacking}")
    return rows.where(F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in rows.columns]).isNotNull())
