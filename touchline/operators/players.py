"""Players put together from several tables, and what their pages list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.functions import seq


def assembled(running: DataFrame, teams: DataFrame, numbers: DataFrame, identities: DataFrame, assessments: DataFrame, cards: DataFrame, pending: str = "-") -> DataFrame:
    """One row per curated card, and per running id that no card holds: with team, number (where confirmed), a person's overrides and the assessment's status.

    running (gid, distance, peak), teams (gid, team), numbers (gid, number, status), identities (gid, name, number, team), assessments (gid, status), cards (player, gids, team, distance, peak). Each of the first five has a
    row per id. A card without a team takes that of its first id; overrides and assessment are those of the first of its ids that has them.
    """
    ident = identities.select("gid", F.struct("name", "number", "team").alias("who"))
    ids = cards.select("player", F.posexplode("gids").alias("at", "gid"))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("at")))
    more = ids.join(teams, "gid", "left").join(ident, "gid", "left").join(assessments, "gid", "left").groupBy("player").agg(
        F.min_by("team", "at").alias("_team"), first(F.col("who")).alias("who"), first(F.col("status")).alias("assessment")
    )
    c = cards.join(more, "player", "left").select(
        "player", F.array_join("gids", ";").alias("gids"), F.coalesce("team", "_team").alias("team"), F.lit(None).cast("string").alias("number"), "distance", "peak", "who", "assessment", F.lit(True).alias("card")
    )
    num = numbers.select("gid", F.when(F.lower("status").contains("confirm"), F.col("number")).alias("number"))
    r = running.join(ids.select("gid").distinct(), "gid", "left_anti").join(teams, "gid", "left").join(num, "gid", "left").join(ident, "gid", "left").join(assessments, "gid", "left").select(
        F.concat(F.lit("ID "), F.col("gid").cast("string")).alias("player"), F.col("gid").cast("string").alias("gids"), "team", "number", "distance", "peak", "who", F.col("status").alias("assessment"), F.lit(False).alias("card")
    )
    w = F.col("who")
    return c.unionByName(r).select(
        F.coalesce(w["name"], "player").alias("player"), "gids", F.coalesce(w["team"], "team").alias("team"), F.coalesce(w["number"], "number", F.lit(pending)).alias("number"), "distance", "peak",
        F.when(w["name"].isNotNull(), "human_confirmed").otherwise("candidate").alias("identity"), F.coalesce("assessment", F.lit("pending")).alias("assessment"), "card",
    )


def confirmed_identities(rows: DataFrame, keys: list[str], gid: str, confidence: str, audit: str) -> DataFrame:
    """Per person: sorted ids, least confidence, audited rows."""
    return rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(gid)), ";").alias("gids"), F.round(F.min(confidence), 6).alias("confidence"), F.count_if(F.col(audit)).alias("audited"))


def numbered(rows: DataFrame, key: str, order: list[str], prefix: str = "ev") -> DataFrame:
    """Each key's rows by order as ev001, ev002, ..."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("label", F.concat(F.lit(prefix), F.lpad(k.cast("string"), 3, "0")))


def cumulative(rows: DataFrame, key: str, frame: str, value: str) -> DataFrame:
    """Running totals within a key, and how many rows so far."""
    w = Window.partitionBy(key).orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("total", F.round(F.sum(F.col(value).cast("decimal(28,6)")).over(w).cast("double"), 4)).withColumn("so_far", F.count("*").over(w))


def strided(rows: DataFrame, key: str, order: list[str], cap: int) -> DataFrame:
    """Every step-th row of a key's order, step = max(1, n // cap), and of those the first cap."""
    w = Window.partitionBy(key).orderBy(*order)
    t = rows.withColumn("_k", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / cap))
    return t.where((F.col("_k") % step == 0) & (F.floor(F.col("_k") / step) < cap)).drop("_k", "_n")


def evenly(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """At most n of each key's rows, spread evenly from its first to its last (places cut to whole ones)."""
    w = Window.partitionBy(key).orderBy(*order)
    t = rows.withColumn("_k", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    m = F.least(F.col("_n"), F.lit(n))
    # the places floor(i * (count - 1) / (m - 1)) of i = 0 .. m - 1
    i = F.ceil(F.col("_k") * (m - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    return t.where((F.col("_n") <= n) | (F.floor(i * (F.col("_n") - 1) / F.greatest(m - 1, F.lit(1))) == F.col("_k"))).drop("_k", "_n")


def smoothed_heat(cells: DataFrame, nx: int, ny: int, sigma: float, radius: int) -> DataFrame:
    """cells (cx, cy, n) after a Gaussian of that radius, over the peak. A Gaussian is one along x, then one along y: each pass sends a cell's value to the cells of its row or column that it reaches, those of the grid only."""
    weight = lambda d: F.exp(-(F.col(d) * F.col(d)) / F.lit(2 * sigma * sigma))

    def along(t: DataFrame, axis: str, other: str, size: int) -> DataFrame:
        t = t.select(axis, other, "v", F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("d"))
        t = t.select((F.col(axis) + F.col("d")).alias(axis), other, (F.col("v") * weight("d")).cast("decimal(28,12)").alias("v")).where(F.col(axis).between(0, size - 1))
        return t.groupBy(axis, other).agg(F.sum("v").cast("double").alias("v"))

    t = along(along(cells.select("cx", "cy", F.col("n").cast("double").alias("v")), "cx", "cy", nx), "cy", "cx", ny)
    top = t.agg(F.max("v").alias("_m"))  # one row
    return t.crossJoin(F.broadcast(top)).select("cx", "cy", F.round(F.col("v") / F.col("_m"), 6).alias("heat"))


def active(spans: DataFrame, frames: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Per frame how many spans hold it, edges included; frames meet spans in buckets as wide as that."""
    from touchline.functions import seq

    return seq.range_join(frames, spans, "frame", start, end, width).groupBy("frame").agg(F.count("*").alias("active"))


def distinct_in_order(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Each key's different values in the order of their first appearance, joined."""
    first = rows.groupBy(key, value).agg(F.min(order).alias("_o"))
    return first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda s: s[value]), ";").alias("items"))


def latest_first(rows: DataFrame, last: Column, *order: Column) -> DataFrame:
    """Rows by order, those where `last` holds at the end."""
    return rows.orderBy(last, *order)
