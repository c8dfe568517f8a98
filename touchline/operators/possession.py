"""Ball possession: nearest player, intervals, changes, passes and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.functions import seq
from touchline.functions.geom import distance


def nearest_player(players: DataFrame, ball: DataFrame, reach: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per ball frame whose nearest player is strictly nearer than `reach`; ties go to the smaller id. Partial minima precede the shuffle.

    keys, here and below, are columns that name a match: frames, ids and intervals of different matches never meet.
    """
    at = [*keys, "frame"]
    d = distance(F.col("x"), F.col("y"), F.col("bx"), F.col("bz"))
    best = players.join(ball, at).select(*at, F.struct(d.alias("d"), "gid", "x", "y", "bx", "bz").alias("m")).groupBy(*at).agg(F.min("m").alias("m"))
    return best.select(*at, "m.*").where(F.col("d") < reach)


def intervals(match: DataFrame, least: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs of at least so many consecutive frames of one id. Islands are found within ids, so that no window spans the whole table."""
    r = seq.runs(match, [*keys, "gid"], "frame").groupBy(*keys, "gid", "run").agg(
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("n"),
        F.min("d").alias("min_d"), F.max("d").alias("max_d"), F.avg("d").alias("mean_d"), F.min_by("bx", "frame").alias("sbx"), F.min_by("bz", "frame").alias("sby"),
        F.max_by("bx", "frame").alias("ebx"), F.max_by("bz", "frame").alias("eby"),
    )
    return r.where(F.col("n") >= least).drop("run").withColumn("confirmed_frame", F.col("start_frame") + least - 1)


def transitions(iv: DataFrame, most: int, block: int = 1 << 20, keys: tuple[str, ...] = ()) -> DataFrame:
    """Neighbouring intervals of different ids with 0..most frames between.

    Neighbours are found in blocks of frames. Intervals go to the block before their own, too, where its last one looks ahead: one pass over iv, nothing sorted in one task. What
    begins more than a block after another is beyond `most` frames of it.
    """
    own = F.floor(F.col("start_frame") / block)
    b = iv.withColumn("_g", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_b", own - F.col("_g")).withColumn("_ghost", F.col("_g") == 1).drop("_g")
    w = Window.partitionBy(*keys, "_b").orderBy("start_frame")
    nxt = {c: F.lead(c).over(w).alias(f"to_{c}") for c in ("gid", "start_frame", "confirmed_frame", "sbx", "sby")}
    t = b.select("*", *nxt.values()).where(~F.col("_ghost") & F.col("to_gid").isNotNull())
    gap = F.col("to_start_frame") - F.col("end_frame") - 1
    return t.where((F.col("gid") != F.col("to_gid")) & gap.between(0, most)).select(
        *keys, F.col("gid").alias("from_gid"), "to_gid", "end_frame", "to_start_frame", gap.alias("gap"), F.col("to_confirmed_frame").alias("confirmed_frame"),
        distance(F.col("ebx"), F.col("eby"), F.col("to_sbx"), F.col("to_sby")).alias("displacement"), "ebx", "eby", F.col("to_sbx").alias("sbx"), F.col("to_sby").alias("sby"),
    )


def classified(tr: DataFrame, teams: DataFrame, least: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Both teams (default unassigned) and the kind of change: unknown, opponent, short or directed."""
    a = teams.select(*keys, F.col("gid").alias("from_gid"), F.col("team").alias("from_team"))
    b = teams.select(*keys, F.col("gid").alias("to_gid"), F.col("team").alias("to_team"))
    t = tr.join(a, [*keys, "from_gid"], "left").join(b, [*keys, "to_gid"], "left").fillna("unassigned", ["from_team", "to_team"])
    kind = (
        F.when((F.col("from_team") == "unassigned") | (F.col("to_team") == "unassigned"), "unknown")
        .when(F.col("from_team") != F.col("to_team"), "opponent").when(F.col("displacement") < least, "short").otherwise("directed")
    )
    return t.withColumn("kind", kind)


def passes(tr: DataFrame, fps: float) -> DataFrame:
    """Directed changes within a team, with angle and speed."""
    frames = F.greatest(F.lit(1), F.col("to_start_frame") - F.col("end_frame"))
    return tr.where("kind = 'directed'").withColumn("angle_deg", F.degrees(F.atan2(F.col("sby") - F.col("eby"), F.col("sbx") - F.col("ebx")))).withColumn("speed", F.col("displacement") / (frames / fps))


def grey_zone(tr: DataFrame, low: float, high: float) -> DataFrame:
    same = (F.col("from_team") == F.col("to_team")) & ~F.col("from_team").isin("", "unassigned")
    return tr.where(same & (F.col("displacement") >= low) & (F.col("displacement") < high))


def team_summary(ps: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    d = F.col("displacement").cast("decimal(38,9)")
    return ps.groupBy(*keys, F.col("from_team").alias("team")).agg(F.count("*").alias("passes"), F.round(F.sum(d).cast("double"), 3).alias("total_m"), F.round(F.sum(d).cast("double") / F.count("*"), 3).alias("mean_m"))


def team_overview(iv: DataFrame, teams: DataFrame, ps: DataFrame) -> DataFrame:
    """Per team: ids, frames, share of all teams' frames, passes. The window spans one row per team."""
    t = iv.join(teams, "gid", "left").fillna("unassigned", ["team"]).groupBy("team").agg(F.count_distinct("gid").alias("ids"), F.sum("n").alias("frames"))
    t = t.withColumn("share", F.round(F.col("frames") / F.sum("frames").over(Window.partitionBy()), 4))
    return t.join(ps.groupBy(F.col("from_team").alias("team")).agg(F.count("*").alias("passes")), "team", "left").fillna(0, ["passes"])


def owners(iv: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, frame, gid): one owner for each frame of an interval, the later interval's where two hold it."""
    t = iv.select(*keys, F.explode(F.sequence("start_frame", "end_frame")).alias("frame"), "gid", F.struct("start_frame", "end_frame", "gid").alias("_o"))
    return t.groupBy(*keys, "frame").agg(F.max_by("gid", "_o").alias("gid"))


def matrix(ps: DataFrame) -> DataFrame:
    return ps.groupBy(F.col("from_team").alias("team"), "from_gid", "to_gid").agg(F.count("*").alias("n"))


def dense_matrix(ps: DataFrame) -> DataFrame:
    """Every ordered pair of a team's participants with its count; teams are small, each participant meets its own team only."""
    who = ps.select(F.col("from_team").alias("team"), F.explode(F.array("from_gid", "to_gid")).alias("gid")).distinct()
    pairs = who.withColumnRenamed("gid", "from_gid").join(who.withColumnRenamed("gid", "to_gid"), "team")
    return pairs.join(matrix(ps), ["team", "from_gid", "to_gid"], "left").fillna(0, ["n"])


def systematic_sample(df: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    """Rows at floor((i + 0.5) * total / n) of the order, all of them where there are n or fewer; no task sorts the whole table."""
    total = df.agg(F.count("*").alias("_n"))  # one row
    t = seq.row_index(df, [], order[0], order[1:], "_k").crossJoin(F.broadcast(total))
    i = F.floor((F.col("_k") + 0.0) * n / F.col("_n"))
    hit = F.exists(F.sequence(i - 1, i + 1), lambda j: (j >= 0) & (j < n) & (F.floor((j + 0.5) * F.col("_n") / n) == F.col("_k")))
    return t.where((F.col("_n") <= n) | hit).drop("_k", "_n")
