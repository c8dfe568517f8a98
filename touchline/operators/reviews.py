"""Reviews and quality: roll-ups of labels, assessments, calibrations and counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.functions.geom import project


def label_review(rows: DataFrame, machine: Column, human: Column, keys: list[str]) -> DataFrame:
    """Per key: rows, labelled ones, agreements of person and machine, their rate (null without labels), complete or pending."""
    n, said, same = F.count("*"), F.count(human), F.count_if(human == machine)
    return rows.groupBy(*keys).agg(
        n.alias("total"), said.alias("labelled"), same.alias("agreed"), F.when(said > 0, F.round(same / said, 6)).alias("rate"), F.when((n > 0) & (said == n), "complete").otherwise("pending").alias("status")
    )


def confirmation(rows: DataFrame, confirmed: Column, keys: list[str]) -> DataFrame:
    """Per key how many are confirmed: complete, partial or pending."""
    n, c = F.count("*"), F.count_if(confirmed)
    return rows.groupBy(*keys).agg(c.alias("confirmed"), n.alias("total"), F.when((n > 0) & (c == n), "complete").when(c > 0, "partial").otherwise("pending").alias("status"))


def assessment(rows: DataFrame, key: str, score: str, dimensions: int) -> DataFrame:
    """Per key its valid scores (0 to 100): confirmed if each of so many dimensions has one, partial if some have."""
    valid = F.col(score).between(0, 100)
    n = F.count_distinct(F.when(valid, F.col("dimension")))
    per = rows.groupBy(key).agg(n.alias("scored"), F.round(F.avg(F.when(valid, F.col(score)).cast("decimal(20,6)")).cast("double"), 4).alias("mean"))
    return per.withColumn("status", F.when(F.col("scored") >= dimensions, "confirmed").when(F.col("scored") > 0, "partial").otherwise("pending"))


def calibration(frames: DataFrame, accepted: Column, error: str, keys: list[str], gate: float = 0.8) -> DataFrame:
    """Per key: frames, accepted ones, their share, root mean square and largest error of those, and whether the share passes the gate."""
    n, a = F.count("*"), F.count_if(accepted)
    e = F.when(accepted, F.col(error))
    sq = F.sum((e * e).cast("decimal(38,9)")).cast("double")
    return frames.groupBy(*keys).agg(
        n.alias("frames"), a.alias("accepted"), F.round(a / n, 6).alias("coverage"), F.round(F.sqrt(sq / a), 6).alias("rmse"), F.max(e).alias("max_error"), (a / n >= gate).alias("passed")
    )


def acceptance(sample: DataFrame, labels: DataFrame, key: str, wanted: int = 20, least: float = 0.9) -> DataFrame:
    """One row: the sample's size, how many of it have a valid label (true or false; labels of rows outside the sample don't count), agreements, their rate, and whether all `wanted` are labelled and the rate reaches `least`. labels (key, label)."""
    said = labels.where(F.col("label").isNotNull()).groupBy(key).agg(F.bool_and("label").alias("label"))
    t = sample.select(key).distinct().join(said, key, "left")
    n, yes = F.count("label"), F.count_if("label")
    return t.agg(F.count("*").alias("sample"), n.alias("labelled"), yes.alias("agreed"), F.when(n > 0, F.round(yes / n, 6)).alias("rate"), F.coalesce((n == wanted) & (yes / F.nullif(n, F.lit(0)) >= least), F.lit(False)).alias("passed"))


def counters(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row: how many rows meet each condition."""
    return rows.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def counts_by(rows: DataFrame, keys: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """A column per kind with its number of rows."""
    return rows.groupBy(*keys).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def by_priority(rows: DataFrame, kind: str, order: list[str], ties: list[str]) -> DataFrame:
    """Rows with the place of their kind in the list, those of no listed kind last; sorted by it."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(kind)), F.lit(0))
    return rows.withColumn("priority", F.when(place > 0, place - 1).otherwise(9).cast("int")).orderBy("priority", *ties)


def broken_rules(rows: DataFrame, keys: list[str], **rules: Column) -> DataFrame:
    """Per key the names of the rules that some row of it breaks, joined, and whether it passes. Rules are conditions that every row must meet."""
    per = rows.groupBy(*keys).agg(*[F.bool_and(F.coalesce(c, F.lit(False))).alias(f"_{n}") for n, c in rules.items()])
    broken = F.concat_ws(";", *[F.when(~F.col(f"_{n}"), n) for n in rules])
    return per.select(*keys, broken.alias("broken"), (broken == "").alias("passed"))


def reprojection(points: DataFrame, matrices: DataFrame, keys: list[str], gate: float = 0.5, frame: str = "frame") -> DataFrame:
    """(keys, frame, points, rmse, max_error, accepted, reason): how far each frame's image points (x, y) land, by its matrix h (nine numbers, row by row), from where they are on the pitch (wx, wy).

    A frame is accepted if its largest error is within the gate; else the reason tells: `reprojection_error`, `no_matrix`, `too_few_points` (fewer than four) or `point_at_infinity`.
    """
    t = points.join(matrices.select(*keys, frame, "h"), [*keys, frame], "left")
    px, py = project(F.col("x"), F.col("y"), [F.get("h", F.lit(k)) for k in range(9)])
    e = F.hypot(px - F.col("wx"), py - F.col("wy"))
    per = t.withColumn("_e", e).groupBy(*keys, frame).agg(
        F.count("*").alias("points"), F.bool_or(F.col("h").isNull()).alias("_none"), F.bool_or(F.col("_e").isNull()).alias("_far"),
        F.sqrt(F.sum((F.col("_e") * F.col("_e")).cast("decimal(38,12)")).cast("double") / F.count("_e")).alias("rmse"), F.max("_e").alias("max_error"),
    )
    reason = F.when(F.col("_none"), "no_matrix").when(F.col("points") < 4, "too_few_points").when(F.col("_far"), "point_at_infinity").when(F.col("max_error") > gate, "reprojection_error")
    return per.select(*keys, frame, "points", F.round("rmse", 6).alias("rmse"), F.round("max_error", 6).alias("max_error"), reason.isNull().alias("accepted"), reason.alias("reason"))


def accepted_segments(frames: DataFrame, keys: list[str], frame: str = "frame", apart: int = 1) -> DataFrame:
    """(keys, start_frame, end_frame, frames): stretches of a key's accepted frames that are at most `apart` from one to the next. No stretch bridges a frame that was not accepted."""
    w = Window.partitionBy(*keys).orderBy(frame)
    new = F.when(F.lag("accepted").over(w) & (F.col(frame) - F.lag(frame).over(w) <= apart), 0).otherwise(1)
    t = frames.withColumn("_new", F.coalesce(new, F.lit(1))).where("accepted").withColumn("_k", F.sum("_new").over(w))
    return t.groupBy(*keys, "_k").agg(F.min(frame).alias("start_frame"), F.max(frame).alias("end_frame"), F.count("*").alias("frames")).drop("_k")


#: The states an identity may have; only the first has a number.
STATES = ["eligible_confirmed", "unreadable", "conflict", "mismatch"]


def package(players: DataFrame, identities: DataFrame, summaries: DataFrame, events: DataFrame, files: DataFrame, listed: DataFrame, fastest: float = 15.0, clip: tuple[float, float] = (4.0, 8.0), picture: tuple[int, int] = (600, 400)) -> DataFrame:
    """(rule, passed, failures, examples): seven rules between the tables of a delivered package and the catalogue of its files; up to ten failures of each rule are named.

    players (player); identities (player, global_id, status, number); summaries (player, max_speed, distance, sprints); events (player, event_id, file, total: as many events as the player's list says); files (player, file, kind:
    heatmap, clip or other, length, sha256, width, height, seconds); listed (player, file, sha256).
    Rules: `folders` some player; `identity` a row with an id, a known state, and a number just when confirmed; `running` a speed below `fastest`, distance and sprints not negative; `heatmap` one picture of that size;
    `clips` some, each of that many seconds; `events` some, as many as told, each with its file; `manifest` every listed file is there, isn't empty and has its hash.
    """
    p = players.select("player").distinct()
    lacking = lambda good: p.join(good.select("player").distinct(), "player", "left_anti").select(F.col("player").cast("string").alias("what"))
    ok = F.col("global_id").isNotNull() & F.col("status").isin(*STATES) & ((F.col("status") == STATES[0]) == F.col("number").isNotNull())
    ran = (F.col("max_speed") < fastest) & (F.col("distance") >= 0) & (F.col("sprints") >= 0)
    heat = files.where((F.col("kind") == "heatmap") & (F.col("width") == picture[0]) & (F.col("height") == picture[1]) & (F.col("length") > 0))
    clips = files.where(F.col("kind") == "clip")
    path = F.concat_ws("/", "player", "file").alias("what")
    short = clips.where(~F.coalesce(F.col("seconds").between(*clip), F.lit(False))).select(path)
    lost = events.join(files.select("player", "file"), ["player", "file"], "left_anti").select(F.concat_ws(":", "player", F.col("event_id").cast("string")).alias("what"))
    told = events.groupBy("player").agg(F.count("*").alias("n"), F.min("total").alias("lo"), F.max("total").alias("hi")).where("n <> lo or n <> hi or lo is null").select(F.col("player").cast("string").alias("what"))
    there = files.where("length > 0").select("player", "file", "sha256")
    changed = listed.join(there, ["player", "file", "sha256"], "left_anti").select(path)
    one = lambda df, what: df.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(what).alias("what"))
    found = {
        "folders": one(p, "no player"), "identity": lacking(identities.where(ok)), "running": lacking(summaries.where(ran)), "heatmap": lacking(heat),
        "clips": short.union(one(clips, "no clip")), "events": lost.union(told).union(one(events, "no event")), "manifest": changed,
    }
    rules = list(found)
    t = reduce(DataFrame.unionByName, [f.select(F.lit(k).alias("_k"), F.lit(r).alias("rule"), "what") for k, (r, f) in enumerate(found.items())])
    first = F.row_number().over(Window.partitionBy("rule").orderBy("what"))
    named = t.withColumn("_r", first).where("_r <= 10").groupBy("rule").agg(F.array_join(F.sort_array(F.collect_list("what")), ";").alias("examples"))
    counts = t.groupBy("rule").agg(F.count("*").alias("failures")).join(named, "rule")
    every = players.sparkSession.createDataFrame([(r,) for r in rules], "rule string")  # seven rows
    return every.join(counts, "rule", "left").select("rule", F.col("failures").isNull().alias("passed"), F.coalesce("failures", F.lit(0)).alias("failures"), F.coalesce("examples", F.lit("")).alias("examples"))
