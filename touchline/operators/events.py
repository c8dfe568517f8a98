"""Event candidates and their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.functions import seq
from touchline.functions.geom import distance
from touchline.functions.tables import cut

from . import candidates


def shielding(owned: DataFrame, players: DataFrame, teams: DataFrame, reach: float, least: int) -> DataFrame:
    """Intervals of at least so many owned frames, as many of them under pressure: an opponent (any id of another or no team) within reach. The anchor is the closest one, the first on ties."""
    t = teams.select(F.col("gid").alias("_g"), "team")
    mine = owned.join(t, owned["gid"] == t["_g"], "left").drop("_g").withColumnRenamed("team", "own_team")
    other = players.join(t, players["gid"] == t["_g"], "left").select("frame", F.col("gid").alias("opp"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("team").alias("opp_team"))
    near = mine.join(other, "frame").where((F.col("gid") != F.col("opp")) & ~F.col("own_team").eqNullSafe(F.col("opp_team")))
    near = near.groupBy("pid", "gid", "frame").agg(F.min(F.struct(distance(F.col("x"), F.col("y"), F.col("ox"), F.col("oy")).alias("d"), "opp")).alias("m"))
    hit = near.where(F.col("m.d") <= reach).groupBy("pid", "gid").agg(F.count("*").alias("pressed"), F.min(F.struct("m.d", "frame", "m.opp")).alias("a"))
    return hit.where(F.col("pressed") >= least).select("pid", "gid", "pressed", F.col("a.frame").alias("frame"), F.col("a.opp").alias("opponent"), F.round("a.d", 6).alias("distance"))


def goal_zone(x: Column, y: Column, length: float, width: float) -> Column:
    """Whether a point lies in front of one of the goals: within a margin of a goal line, and within the goal's half width of its middle, both by the pitch's size in metres."""
    half, margin = max(1.5, min(3.66, width * 0.12)), max(0.6, length * 0.025)
    return ((x <= margin) | (x >= length - margin)) & y.between(width / 2 - half, width / 2 + half)


def counterpress(changes: DataFrame, within: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """changes (frame, from_team, to_team): for each loss the first later change within so many frames by which the losing team has the ball again.

    Losses meet recoveries in buckets of frames and by team, so that this is an equi-join.
    """
    loss = changes.where("from_team <> to_team").select(*keys, F.col("frame").alias("lost"), F.col("from_team").alias("team"), F.col("frame").alias("_lo"), (F.col("frame") + within).alias("_hi"))
    back = changes.where("from_team <> to_team").select(*keys, "frame", F.col("to_team").alias("team"))
    hit = seq.range_join(back, loss, "frame", "_lo", "_hi", within, [*keys, "team"]).where("frame > lost")
    return hit.groupBy(*keys, "lost", "team").agg(F.min("frame").alias("regained"))


def counterpress_until_unknown(changes: DataFrame, within: int) -> DataFrame:
    """As counterpress(), but a change to an unknown team ends the search: no recovery counts after it."""
    loss = changes.where("from_team <> to_team and from_team <> 'unassigned'").select(F.col("frame").alias("lost"), F.col("from_team").alias("team"), (F.col("frame") + within).alias("_hi"))
    hit = seq.range_join(changes.select("frame", "from_team", "to_team"), loss, "frame", "lost", "_hi", within).where("frame > lost")
    back = F.when((F.col("to_team") == F.col("team")) & (F.col("from_team") != F.col("to_team")), F.col("frame"))
    t = hit.groupBy("lost", "team").agg(F.min(back).alias("regained"), F.min(F.when(F.col("to_team") == "unassigned", F.col("frame"))).alias("_end"))
    return t.where("regained is not null and (_end is null or regained < _end)").drop("_end")


def likelihoods(ranked: DataFrame, key: str, cost: str) -> DataFrame:
    """Each candidate's share of its event's sum of exp(-cost)."""
    total = ranked.groupBy(key).agg(F.sum(F.exp(-F.col(cost)).cast("decimal(28,12)")).cast("double").alias("_t"))
    return ranked.join(total, key).withColumn("likelihood", F.round(F.exp(-F.col(cost)) / F.col("_t"), 6)).drop("_t")


def padded(spans: DataFrame, key: str, pad: int, last: int) -> DataFrame:
    """A key's spans widened by so many frames on either side, within 0..last; those that touch then are one."""
    t = spans.select(key, F.greatest(F.lit(0), F.col("start_frame") - pad).alias("a"), F.least(F.lit(last), F.col("end_frame") + pad).alias("b"))
    before = F.max("b").over(Window.partitionBy(key).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("_n", F.when(before >= F.col("a") - 1, 0).otherwise(1))
    t = t.withColumn("_k", F.sum("_n").over(Window.partitionBy(key).orderBy("a", "b")))
    return t.groupBy(key, "_k").agg(F.min("a").alias("start_frame"), F.max("b").alias("end_frame")).drop("_k")


def first_in_zone(shots: DataFrame, ball: DataFrame, within: int, zone: Column) -> DataFrame:
    """The first ball frame in the zone within so many frames of each shot."""
    spans = shots.select("shot", (F.col("shot") + within).alias("_hi"))
    return seq.range_join(ball.where(zone), spans, "frame", "shot", "_hi", within).groupBy("shot").agg(F.min("frame").alias("frame"))


def actors(events: DataFrame, ball: DataFrame, players: DataFrame, before: int, after: int, k: int = 3) -> DataFrame:
    """Each event's k likeliest actors: per id the least cost, distance to the ball plus a fee for frames away from the event."""
    at = events.select("event_id", F.col("frame").alias("at"), F.explode(F.sequence(F.col("frame") - before, F.col("frame") + after)).alias("frame"))
    c = at.join(ball, "frame").join(players, "frame")
    cost = distance(F.col("x"), F.col("y"), F.col("bx"), F.col("bz")) + F.abs(F.col("frame") - F.col("at")) * 0.18 / float(before)
    best = c.groupBy("event_id", "gid").agg(F.min(F.struct(cost.alias("cost"), "frame")).alias("m"))
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy("m.cost", "gid"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("event_id", "rank", "gid", F.col("m.frame").alias("frame"), F.round("m.cost", 6).alias("cost"))


def signal_z(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Box mean over five rows (zeros beyond the ends) and its z-score within the key; 0 where nothing varies. Each value goes to the five rows that it reaches by place, so that no task sorts a whole key."""
    t = seq.row_index(df, [key], order[0], order[1:], "_k")
    near = t.select(key, F.explode(F.sequence(F.col("_k") - 2, F.col("_k") + 2)).alias("_k"), F.col(value).cast("decimal(28,9)").alias("_v")).groupBy(key, "_k").agg(F.sum("_v").alias("_v"))
    s = t.join(near, [key, "_k"]).withColumn("smooth", F.round(F.col("_v").cast("double") / 5, 9)).drop("_k", "_v")
    d = lambda c: c.cast("decimal(28,9)")
    per = s.groupBy(key).agg(F.count("*").alias("_n"), F.sum(d(F.col("smooth"))).cast("double").alias("_s"), F.sum(d(F.col("smooth") * F.col("smooth"))).cast("double").alias("_q"))
    mean, var = F.col("_s") / F.col("_n"), F.col("_q") / F.col("_n") - (F.col("_s") / F.col("_n")) * (F.col("_s") / F.col("_n"))
    z = F.when(var <= 1e-12, F.lit(0.0)).otherwise((F.col("smooth") - mean) / F.sqrt(F.greatest(var, F.lit(1e-12))))
    return s.join(per, key).withColumn("z", F.round(z, 5)).drop("_n", "_s", "_q")


def peaks(df: DataFrame, key: str, frame: str, score: str, distance_: int) -> DataFrame:
    """Greedy non-maximum suppression within each key; see candidates.suppressed()."""
    return candidates.suppressed(df, [key], frame, score, distance_)


def above_percentile(df: DataFrame, frame: str, score: str, percentile: float, margin: int) -> DataFrame:
    """Rows whose score reaches the percentile of all scores, away from the first and last `margin` frames."""
    ends = df.agg(F.min(frame).alias("_lo"), F.max(frame).alias("_hi"))  # one row
    lim = seq.percentile(df, [], score, percentile, "_t")  # one row
    t = df.crossJoin(F.broadcast(lim)).crossJoin(F.broadcast(ends)).where(F.col(score) >= F.col("_t"))
    return t.where(F.col(frame).between(F.col("_lo") + margin, F.col("_hi") - margin)).drop("_t", "_lo", "_hi")


def visible(frames: DataFrame, gap: int) -> DataFrame:
    """Maximal intervals of an id's frames with gaps of at most so many frames, and where each begins in a compilation."""
    s = seq.sessions(frames.select("gid", "frame").distinct(), "gid", "frame", gap, "part")
    iv = s.groupBy("gid", "part").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("n"))
    w = Window.partitionBy("gid").orderBy("start_frame").rowsBetween(Window.unboundedPreceding, -1)
    return iv.withColumn("offset", F.coalesce(F.sum(F.col("end_frame") - F.col("start_frame") + 1).over(w), F.lit(0))).drop("part")


def compilation(intervals: DataFrame, key: str) -> DataFrame:
    """A key's stretches of source time (start, end), in seconds, one after the other: (key, source_start, source_end, compilation_start, duration)."""
    w = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    length = F.col("end") - F.col("start")
    return intervals.select(key, F.col("start").alias("source_start"), F.col("end").alias("source_end"), F.coalesce(F.sum(length).over(w), F.lit(0.0)).alias("compilation_start"), length.alias("duration"))


def seen_times(frames: DataFrame, key: str, fps: float, gap: float = 1.5, pad: float = 0.35) -> DataFrame:
    """(key, start, end) in seconds: where a key's frames (key, frame) are at most `gap` seconds apart, widened by `pad`."""
    s = seq.sessions(frames.select(key, "frame").distinct(), key, "frame", max(1, round(fps * gap)), "_part")
    return s.groupBy(key, "_part").agg(F.greatest(F.lit(0.0), F.min("frame") / fps - pad).alias("start"), ((F.max("frame") + 1) / fps + pad).alias("end")).drop("_part")


def retimed(boxes: DataFrame, timeline: DataFrame, key: str, fps: float, stride: int | None = None, width: int = 32) -> DataFrame:
    """boxes (key, frame, ...) at every stride-th frame (about 15 a second by default) with their source_time and their time in the compilation; those outside its stretches go.

    Boxes meet stretches [source_start, source_end) in buckets of `width` seconds; where stretches overlap the earlier one has the box.
    """
    stride = stride or max(1, round(fps / 15.0))
    t = boxes.where(F.col("frame") % stride == 0).withColumn("source_time", F.col("frame") / fps).withColumn("_row", F.monotonically_increasing_id())
    t = cut(t, "boxes")
    hit = seq.range_join(t.select(key, "source_time", "_row"), timeline, "source_time", "source_start", "source_end", width, [key], half_open=True)
    first = hit.groupBy("_row").agg(F.min(F.struct("source_start", "source_end", "compilation_start")).alias("_s"))
    time = F.col("_s.compilation_start") + F.col("source_time") - F.col("_s.source_start")
    return t.join(first, "_row").withColumn("time", F.round(time, 3)).withColumn("source_time", F.round("source_time", 3)).drop("_row", "_s")
