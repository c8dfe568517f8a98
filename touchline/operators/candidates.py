"""Action candidates: signals of ball and players per frame, their best frames, and what kind of action they hint at."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.functions import seq
from touchline.functions.tables import cut

#: The kinds of action candidates.
KICK, TURN, OTHER = "射门_大力踢球", "传球_解围_方向突变", "关键动作"
#: Frames of a block that are looked at together.
BLOCK = 1 << 14


def suppressed(df: DataFrame, keys: list[str], frame: str, score: str, distance: int, block: int = BLOCK) -> DataFrame:
    """(keys, frame, score): the rows that a greedy choice by falling score keeps (the earlier frame on ties), none of them nearer than `distance` to another.

    The choice is made in rounds, in blocks of frames. Within a block a row is chosen once all better ones within reach are gone, and goes once a chosen one is within reach; rows that
    hang on what lies beyond the block's ends wait for the next round, whose blocks are shifted by half. The best waiting row of a key is settled in one of any two rounds, and no
    task has more than a block, however long a key is.
    """
    block = max(block, 4 * distance)
    types = dict(df.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "_f long, _s double, _kept boolean"])

    def settle(low: int, f: np.ndarray, s: np.ndarray, kept: np.ndarray) -> np.ndarray:
        """1 chosen, 0 waiting, -1 gone; [low, low + block) are the block's frames."""
        out = kept.astype(np.int8)
        chosen, waiting = sorted(f[kept].tolist()), []
        near = lambda x, at: (k := bisect_left(at, x - distance + 1)) < len(at) and at[k] < x + distance
        for k in np.lexsort((f, -s)):
            x = int(f[k])
            if kept[k]:
                continue
            if near(x, chosen):
                out[k] = -1
            elif x - distance + 1 < low or x + distance > low + block or near(x, waiting):
                insort(waiting, x)
            else:
                insort(chosen, x)
                out[k] = 1
        return out

    def run(shift: int):
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            low = (int(pdf["_f"].iloc[0]) + shift) // block * block - shift
            state = settle(low, pdf["_f"].to_numpy(), pdf["_s"].to_numpy(), pdf["_kept"].to_numpy(dtype=bool))
            return pdf.drop(columns="_block").assign(_kept=state == 1)[state >= 0]

        return one

    now = cut(df.select(*keys, F.col(frame).cast("long").alias("_f"), F.col(score).cast("double").alias("_s"), F.lit(False).alias("_kept")).where("_f is not null and _s is not null"), "candidates")
    turn = 0
    while True:
        shift = (turn % 2) * (block // 2)
        blocks = now.withColumn("_block", F.floor((F.col("_f") + shift) / block))
        now = cut(blocks.groupBy(*keys, "_block").applyInPandas(run(shift), schema), "candidates")
        turn += 1
        if now.where("not _kept").isEmpty():
            return now.select(*keys, F.col("_f").cast(types[frame]).alias(frame), F.col("_s").cast(types[score]).alias(score))


def _smooth(c: str, w) -> Column:
    """Box mean over five frames, frames beyond the ends counting 0."""
    return F.sum(c).over(w.rowsBetween(-2, 2)) / 5


def _gradient(c: str, w) -> Column:
    before, after = F.lag(c).over(w), F.lead(c).over(w)
    return F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - F.col(c)).when(after.isNull(), F.col(c) - before).otherwise((after - before) / 2)


def ball_signals(ball: DataFrame, keys: list[str], total: int, fps: float, longest: int, block: int = BLOCK) -> DataFrame:
    """ball (keys, frame, x, y) -> (keys, frame, reliable, acceleration, turn, push) for each frame 0 to total - 1 of the keys with two points or more.

    Positions are linear between points and held beyond them, smoothed over five frames; a frame is reliable where it was seen or lies between points at most `longest` frames apart. turn is the angle in
    degrees against the frame before, 0 where one of the speeds is 1 or less; push is turn times speed. Windows see blocks of frames with a few of their neighbours'.
    """
    w = Window.partitionBy(*keys).orderBy("frame")
    t = ball.where(F.col("frame").between(0, total - 1)).withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n > 1")
    t = t.select(*keys, "frame", "x", "y", F.lead("frame").over(w).alias("_to"), F.lead("x").over(w).alias("_x"), F.lead("y").over(w).alias("_y"), F.lag("frame").over(w).alias("_from"))
    first = F.when(F.col("_from").isNull(), F.lit(0)).otherwise(F.col("frame"))
    t = t.withColumn("_at", F.explode(F.sequence(first.cast("long"), F.coalesce(F.col("_to") - 1, F.lit(total - 1)).cast("long"))))
    ahead = (F.col("_at") > F.col("frame")) & F.col("_to").isNotNull()
    part = (F.col("_at") - F.col("frame")) / (F.col("_to") - F.col("frame"))
    at = lambda c: F.when(ahead, F.col(c) + (F.col(f"_{c}") - F.col(c)) * part).otherwise(F.col(c)).alias(c)
    sure = (F.col("_at") == F.col("frame")) | (ahead & (F.col("_to") - F.col("frame") <= longest))
    t = t.select(*keys, F.col("_at").alias("frame"), at("x"), at("y"), F.coalesce(sure, F.lit(False)).alias("reliable"))
    # smoothing, two gradients and a look back reach five frames
    t = seq.with_edges(t, keys, "frame", block, 8)
    w = Window.partitionBy(*keys, "_block").orderBy("frame")
    if total >= 5:
        t = t.withColumn("x", _smooth("x", w)).withColumn("y", _smooth("y", w))
    t = t.withColumn("_vx", _gradient("x", w) * fps).withColumn("_vy", _gradient("y", w) * fps)
    t = t.withColumn("_v", F.hypot("_vx", "_vy")).withColumn("acceleration", F.hypot(_gradient("_vx", w), _gradient("_vy", w)))
    lag = lambda c: F.lag(c).over(w)
    cos = (lag("_vx") * F.col("_vx") + lag("_vy") * F.col("_vy")) / (lag("_v") * F.col("_v"))
    angle = F.when((lag("_v") > 1) & (F.col("_v") > 1), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))))
    t = t.withColumn("turn", F.coalesce(angle, F.lit(0.0)))
    return t.where("_own").select(*keys, "frame", "reliable", "acceleration", "turn", (F.col("turn") * F.col("_v")).alias("push"))


def player_signal(players: DataFrame, keys: list[str], total: int, fps: float, longest: int = 3) -> DataFrame:
    """players (keys, gid, frame, x, y) -> (keys, frame, fast): of each frame the largest speed of an id over a step of at most so many frames, smoothed over five frames; frames without any aren't there."""
    w = Window.partitionBy(*keys, "gid").orderBy("frame")
    gap = F.col("frame") - F.lag("frame").over(w)
    speed = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) / gap * fps
    t = players.select(*keys, "frame", F.when(gap.between(1, longest), speed).alias("v")).where("v is not null").groupBy(*keys, "frame").agg(F.max("v").alias("v"))
    t = t.withColumn("frame", F.col("frame").cast("long"))
    t = t.select(*keys, F.explode(F.sequence(F.col("frame") - 2, F.col("frame") + 2)).alias("frame"), "v").where(F.col("frame").between(0, total - 1))
    return t.groupBy(*keys, "frame").agg((F.sum(F.col("v").cast("decimal(28,9)")).cast("double") / 5).alias("fast"))


def standard(value: str, mean: str, spread: str) -> Column:
    return F.when(F.col(spread) > 1e-6, (F.col(value) - F.col(mean)) / F.col(spread)).otherwise(0.0)


def action_candidates(ball: DataFrame, players: DataFrame, keys: list[str], total: int, fps: float, longest: int = 10, margin: int = 0, apart: int = 1, part: float = 0.95, block: int = BLOCK) -> DataFrame:
    """(keys, event_id, frame, event_type, score): frames of 0 to total - 1 whose signals stand out, numbered by frame within their key.

    A score adds the z-scores of the ball's acceleration and push and half that of the players' speed, over all of a key's frames. Unreliable frames and those within `margin` of the ends have none;
    of the others those from the percentile `part` on are candidates, and a greedy choice keeps the best ones, 2 * apart frames apart. Where the key's ball has fewer than two points, the players count alone.
    """
    b = cut(ball_signals(ball, keys, total, fps, longest, block), "ball")
    p = player_signal(players, keys, total, fps)
    every = ball.select(*keys).distinct().union(players.select(*keys).distinct()).distinct() if keys else ball.sparkSession.range(1).select()
    frames = every.withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(total - 1).cast("long"))))
    t = frames.join(b, [*keys, "frame"], "left").join(p, [*keys, "frame"], "left")
    t = t.na.fill(0.0, ["acceleration", "turn", "push", "fast"])
    # a key has a ball in all of its frames or in none
    t = cut(t.withColumn("sure", F.coalesce("reliable", F.lit(True))), "signals")
    stats = [f(c).alias(f"_{n}_{c}") for c in ("acceleration", "push", "fast") for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    per = t.groupBy(*keys).agg(*stats)
    kick = seq.percentile(t.where("reliable"), keys, "acceleration", 0.95, "_kick")
    with_all = lambda d, one: d.join(one, keys, "left") if keys else d.crossJoin(F.broadcast(one))
    z = lambda c: standard(c, f"_m_{c}", f"_s_{c}")
    t = with_all(t, per).withColumn("score", z("acceleration") + z("push") + 0.5 * z("fast"))
    t = t.where(F.col("sure") & F.col("frame").between(margin, total - 1 - margin))
    kind = F.when(F.coalesce("reliable", F.lit(False)) & (F.col("acceleration") > F.col("_kick")), KICK).when(F.coalesce("reliable", F.lit(False)) & (F.col("turn") > 90), TURN).otherwise(OTHER)
    t = cut(with_all(t, kick).select(*keys, "frame", kind.alias("event_type"), "score"), "scores")
    found = with_all(t, seq.percentile(t, keys, "score", part, "_t")).where(F.col("score") >= F.col("_t")).select(*keys, "frame", "score")
    out = suppressed(found, keys, "frame", "score", 2 * apart, block).select(*keys, "frame").join(t, [*keys, "frame"])
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("frame"))  # a row for each event
    return out.select(*keys, number.alias("event_id"), "frame", "event_type", F.round("score", 3).alias("score"))
