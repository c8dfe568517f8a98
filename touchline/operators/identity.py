"""Identity checks: appearance centres, switches, overlaps, merges."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.functions import seq
from touchline.functions.tables import cut

#: Pairs of ids that a task makes, about.
PAIRS = 2_000_000


def squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def nearest_centre(rows: DataFrame, centres: list[tuple[int, list[float]]], vec: str, radius: float | None = None, margin: float = 0.0) -> DataFrame:
    """The nearest of a fixed list of centres, with confidence (d2 - d1) / d2; beyond the radius or below the margin the mode is -1."""
    d = F.array_sort(F.array(*[F.struct(F.sqrt(squared(F.col(vec), F.array(*map(F.lit, c)))).alias("d"), F.lit(m).alias("mode")) for m, c in centres]))
    t = rows.withColumn("_d", d)
    d1, d2 = F.get("_d", F.lit(0))["d"], F.get("_d", F.lit(1))["d"]
    mode = F.get("_d", F.lit(0))["mode"]
    if radius is not None:
        mode = F.when((d1 > radius) | (d2 - d1 < margin), F.lit(-1)).otherwise(mode)
    conf = F.when(d2 > 0, (d2 - d1) / d2).otherwise(0.0)
    return t.withColumn("mode", mode).withColumn("confidence", F.round(conf, 6)).drop("_d")


def majority(rows: DataFrame, key: str, mode: str, order: str) -> DataFrame:
    """The commonest mode of a key (the one seen first on ties), its count and share."""
    per = rows.groupBy(key, mode).agg(F.count("*").alias("c"), F.min(order).alias("f"))
    return per.groupBy(key).agg(
        F.max_by(mode, F.struct("c", -F.col("f"))).alias("mode"), F.max("c").alias("support"), F.round(F.max("c") / F.sum("c"), 6).alias("purity")
    )


def quality(det: DataFrame) -> DataFrame:
    """Per id the number of frames that hold it more than once, the first and last of them and all of them in order, and the longest step between its frames."""
    per = det.groupBy("gid", "frame").agg(F.count("*").alias("c"))
    per = per.withColumn("gap", F.col("frame") - F.lag("frame").over(Window.partitionBy("gid").orderBy("frame")))
    twice = F.when(F.col("c") > 1, F.col("frame"))
    return per.groupBy("gid").agg(F.count(twice).alias("collisions"), F.min(twice).alias("first_collision"), F.max(twice).alias("last_collision"), F.sort_array(F.collect_list(twice)).alias("collision_frames"), F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap"))


def switches(rows: DataFrame, key: str, frame: str, mode: str, span: int, least: int, purity: float) -> DataFrame:
    """Cuts where the majority of `span` rows before differs from that of as many after, both pure enough; of neighbouring cuts between the same modes the first.

    Modes are 0 and 1, -1 is unknown: counts over row windows give both majorities.
    """
    w = Window.partitionBy(key).orderBy(frame)
    before, after = w.rowsBetween(-span, -1), w.rowsBetween(0, span - 1)
    n = lambda m, at: F.count_if(F.col(mode) == m).over(at)
    t = rows.select(key, frame, mode, n(0, before).alias("b0"), n(1, before).alias("b1"), n(0, after).alias("a0"), n(1, after).alias("a1"))
    big = lambda p: F.when((F.col(f"{p}0") + F.col(f"{p}1") >= least) & (F.greatest(f"{p}0", f"{p}1") >= purity * (F.col(f"{p}0") + F.col(f"{p}1"))), F.when(F.col(f"{p}0") >= F.col(f"{p}1"), 0).otherwise(1))
    t = t.withColumn("before", big("b")).withColumn("after", big("a")).where("before <> after").where(F.col(mode) == F.col("after"))
    last = F.lag("after").over(w)
    return t.where("before is not null and after is not null").withColumn("_l", last).where("_l is null or _l <> after").select(key, F.col(frame).alias("cut_frame"), F.col("before").alias("before_mode"), F.col("after").alias("after_mode"))


def segments(rows: DataFrame, cuts: DataFrame, key: str, frame: str) -> DataFrame:
    """Each row's segment: the number of its key's cuts up to its frame; cuts and rows are sorted together, so nothing is paired."""
    c = cuts.select(key, F.col("cut_frame").alias(frame)).withColumn("_c", F.lit(1))
    both = rows.withColumn("_c", F.lit(0)).unionByName(c, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.col(frame), F.col("_c").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("segment", F.sum("_c").over(w)).where("_c = 0").drop("_c")


def overlaps(rows: DataFrame, group: str, least: int) -> DataFrame:
    """Pairs of ids of one group that are seen in at least so many frames together: an equi-join on group and frame."""
    a = rows.select(group, "frame", F.col("gid").alias("a"))
    b = rows.select(group, "frame", F.col("gid").alias("b"))
    return a.join(b, [group, "frame"]).where("a < b").groupBy(group, "a", "b").agg(F.count("*").alias("frames")).where(F.col("frames") >= least)


def neighbour_overlap(boxes: DataFrame) -> DataFrame:
    """Per box the largest share of it that another box of its frame covers (0 if none does)."""
    o = boxes.select("frame", *[F.col(c).alias(f"o_{c}") for c in ("gid", "x", "y", "w", "h")])
    side = lambda c, s: F.greatest(F.lit(0.0), F.least(F.col(c) + F.col(s), F.col(f"o_{c}") + F.col(f"o_{s}")) - F.greatest(F.col(c), F.col(f"o_{c}")))
    share = F.when(F.col("gid") != F.col("o_gid"), side("x", "w") * side("y", "h") / (F.col("w") * F.col("h")))
    return boxes.join(o, "frame").groupBy("frame", "gid").agg(F.round(F.coalesce(F.max(share), F.lit(0.0)), 6).alias("overlap"))


def merged_people(rows: DataFrame, key: str) -> DataFrame:
    """Sums, maxima and united ids of rows that share a key; rows without one stay single."""
    one = F.coalesce(F.col(key), F.concat(F.lit("row:"), F.col("gid").cast("string")))
    return rows.groupBy(one.alias("person")).agg(
        F.round(F.sum(F.col("distance").cast("decimal(38,9)")).cast("double"), 3).alias("distance"), F.max("peak").alias("peak"),
        F.round(F.sum((F.col("score") * F.greatest(F.lit(1.0), F.col("seconds"))).cast("decimal(38,9)")).cast("double") / F.sum(F.greatest(F.lit(1.0), F.col("seconds")).cast("decimal(38,9)")).cast("double"), 4).alias("score"),
        F.array_join(F.array_sort(F.collect_set("gid")), ";").alias("gids"),
    )


def open_switches(rows: DataFrame, key: str, frame: str, mode: str, span: int, least: int, purity: float, collapse: int) -> DataFrame:
    """(key, cut_frame, before_mode, after_mode, support): lasting changes between the modes 0 and 1 (-1 is unknown).

    Full windows of `span` rows before and after a row need `least` known modes and a purity each; the cut is the first row of the new mode. Of cuts that follow within
    `collapse` frames the one of most support stays, and changes must alternate. Only a key's few candidates meet in one row.
    """
    w = Window.partitionBy(key).orderBy(frame)
    before, after = w.rowsBetween(-span, -1), w.rowsBetween(0, span - 1)
    n = lambda m, at: F.count_if(F.col(mode) == m).over(at)
    first = lambda m: F.min(F.when(F.col(mode) == m, F.col(frame))).over(after)
    full = (F.count("*").over(before) == span) & (F.count("*").over(after) == span)
    t = rows.select(key, frame, n(0, before).alias("b0"), n(1, before).alias("b1"), n(0, after).alias("a0"), n(1, after).alias("a1"), first(0).alias("f0"), first(1).alias("f1"), full.alias("full"))
    t = t.where("full").withColumn("b", F.when(F.col("b1") > F.col("b0"), 1).otherwise(0)).withColumn("a", F.when(F.col("a1") > F.col("a0"), 1).otherwise(0))
    for s in "ba":
        t = t.where((F.col(f"{s}0") + F.col(f"{s}1") >= least) & (F.greatest(f"{s}0", f"{s}1") >= purity * (F.col(f"{s}0") + F.col(f"{s}1"))))
    t = t.where("a <> b").withColumn("f", F.when(F.col("a") == 1, F.col("f1")).otherwise(F.col("f0"))).withColumn("s", F.greatest("b0", "b1") + F.greatest("a0", "a1"))
    items = F.transform(F.array_sort(F.collect_list(F.struct(frame, "f", "b", "a", "s"))), lambda x: F.struct(x["f"].alias("f"), x["b"].alias("b"), x["a"].alias("a"), x["s"].alias("s")))
    per = t.groupBy(key).agg(items.alias("c"))
    none, one = F.filter("c", lambda x: F.lit(False)), lambda x: F.array(x)
    last = lambda acc: F.element_at(acc, -1)
    but_last = lambda acc: F.slice(acc, 1, F.size(acc) - 1)
    near = lambda acc, x: F.when(F.size(acc) == 0, one(x)).when(x["f"] - last(acc)["f"] > collapse, F.concat(acc, one(x))).when(x["s"] > last(acc)["s"], F.concat(but_last(acc), one(x))).otherwise(acc)
    turn = lambda acc, x: F.when((F.size(acc) == 0) | ((x["b"] == last(acc)["a"]) & (x["a"] != last(acc)["a"])), F.concat(acc, one(x))).otherwise(acc)
    per = per.withColumn("c", F.aggregate("c", none, near)).withColumn("c", F.aggregate("c", none, turn))
    return per.select(key, F.explode("c").alias("c")).select(key, F.col("c.f").alias("cut_frame"), F.col("c.b").alias("before_mode"), F.col("c.a").alias("after_mode"), F.col("c.s").alias("support"))


def local_changes(rows: DataFrame, window: int = 8, least: float = 0.35, ratio: float = 2.2, floor: float = 0.035, horizon: int = 30, back: float = 0.20, block: int = 2048) -> DataFrame:
    """rows (gid, frame, feature) -> (gid, cut_frame, distance, ratio): lasting changes of a track's own appearance, without any colour model.

    The median features of `window` rows before and after a row, over unit length, differ by `least` and by `ratio` times their usual spread; both sides span at most three windows.
    Of neighbouring candidates the one of the largest ratio stays; one that the next takes back goes with it. A track's rows are looked at in blocks of so many, with a window of rows on either side; its candidates meet in one task.
    """

    def medians(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each `window` rows in turn: their median over unit length, and the median distance to it."""
        w = np.lib.stride_tricks.sliding_window_view(x, window, axis=0)  # (places, dim, window)
        mid = np.median(w, axis=2)
        mid = mid / np.maximum(np.linalg.norm(mid, axis=1, keepdims=True), 1e-9)
        return mid, np.median(np.linalg.norm(w - mid[:, :, None], axis=1), axis=1)

    def candidates(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        f, own, x = pdf["frame"].to_numpy(), pdf["own"].to_numpy(), np.array([np.asarray(v, dtype=float) for v in pdf["feature"]])
        if len(f) < 2 * window:
            return pd.DataFrame([], columns=["gid", "cut_frame", "distance", "ratio", "before", "after"], dtype=object)
        mid, usual = medians(x)
        k = np.arange(window, len(f) - window + 1)  # the first row of the later side
        short = f[window - 1 :] - f[: len(f) - window + 1] <= 3 * window
        d = np.linalg.norm(mid[k - window] - mid[k], axis=1)
        r = d / np.maximum(usual[k - window] + usual[k], floor)
        k, d, r = (v[own[k] & short[k - window] & short[k] & (d >= least) & (r >= ratio)] for v in (k, d, r))
        sides = {n: pd.Series(list(mid[j]), dtype=object) for n, j in (("before", k - window), ("after", k))}
        return pd.DataFrame({"gid": np.full(len(k), pdf["gid"].iloc[0]), "cut_frame": f[k], "distance": d, "ratio": r, **sides})

    def settled(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list = []
        for item in pdf.sort_values("cut_frame").itertuples(index=False):
            if found and item.cut_frame - found[-1].cut_frame <= window:
                found[-1] = max(found[-1], item, key=lambda i: i.ratio)
            else:
                found.append(item)
        out, k = [], 0
        while k < len(found):
            if k + 1 < len(found) and found[k + 1].cut_frame - found[k].cut_frame <= horizon and np.linalg.norm(found[k].before - found[k + 1].after) <= back:
                k += 2
                continue
            out.append(found[k][:4])
            k += 1
        return pd.DataFrame(out, columns=["gid", "cut_frame", "distance", "ratio"])

    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    length = F.sqrt(F.aggregate("feature", F.lit(0.0), lambda s, v: s + v * v))
    t = rows.select(F.col("gid").cast("long").alias("gid"), F.col("frame").cast("long").alias("frame"), F.col("feature").cast("array<double>").alias("feature"))
    t = t.where(F.col("feature").isNotNull() & F.forall("feature", finite)).where(length > 1e-6)
    t = seq.with_edges(t.withColumn("k", F.row_number().over(Window.partitionBy("gid").orderBy("frame"))), ["gid"], "k", block, window)
    t = t.select("gid", "frame", "feature", F.col("_own").alias("own"), "_block").groupBy("gid", "_block")
    found = t.applyInPandas(candidates, "gid long, cut_frame long, distance double, ratio double, before array<double>, after array<double>")
    return found.groupBy("gid").applyInPandas(settled, "gid long, cut_frame long, distance double, ratio double")


def apart(rows: DataFrame, group: list[str], frames: int, metres: float) -> DataFrame:
    """(group, a, b, frames, separation): pairs of ids that are one by their group (a team and number, say) but are seen in at least so many frames together, with a median distance of over `metres`.

    rows (group, gid, frame, x, y), a row per id and frame. Ids meet by group and frame; the median is that of seq.percentile(), without an array for each pair.
    """
    side = lambda n: rows.select(*group, "frame", F.col("gid").alias(n), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    both = side("a").join(side("b"), [*group, "frame"]).where("a < b")
    both = both.select(*group, "a", "b", F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")).alias("d"))
    pairs = [*group, "a", "b"]
    often = both.groupBy(*pairs).agg(F.count("*").alias("frames")).where(F.col("frames") >= frames)
    middle = seq.percentile(both, pairs, "d", 0.5, "separation")
    return often.join(middle, pairs).where(F.col("separation") > metres).withColumn("separation", F.round("separation", 3))


def frames_held(rows: DataFrame) -> DataFrame:
    """(gid, frames, block, bits) of rows (gid, frame): the id's different frames as a map of 64-frame blocks to the bits of those that it has; an id of one block has it in (block, bits), too."""
    at = F.col("frame").cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    per = rows.where(at.isNotNull()).groupBy("gid", F.shiftright(at, 6).alias("block")).agg(F.bit_or(bit).alias("bits"))
    held = per.groupBy("gid").agg(F.map_from_entries(F.collect_list(F.struct("block", "bits"))).alias("frames"), F.min("block").alias("b"), F.max("block").alias("top"), F.bit_or("bits").alias("bits"))
    one = F.col("b") == F.col("top")
    return held.select("gid", "frames", F.when(one, F.col("b")).alias("block"), F.when(one, F.col("bits")).alias("bits"))


def merge_candidates(ids: DataFrame, rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(gid, candidate, compatible, linked, reasons) of each chosen id (gid) against all others: which may be the same person, and why not.

    ids (gid, team, person, number; blanks and nulls are unknown), rows (gid, frame; whole numbers). Reasons are joined by ';': `team` and `number` where both are known and differ, `together:n` where the two
    are seen in the same n frames, `person` where each belongs to another one; `linked` where they are one person already. Every pair is a row of the result anyway: it is made where the other id lies, with both
    ids' frames beside it as bits, so that neither pairs nor the frames that they share are shuffled, sorted or held.
    """
    known = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    cols = [known(c).alias(c) for c in ("team", "person", "number")]
    few = chosen.select("gid").distinct()
    every = cut(ids.select("gid", *cols).join(frames_held(rows), "gid", "left"), "ids")
    mine = cut(every.join(few, "gid", "left_semi").select("gid", *[F.col(c).alias(f"own_{c}") for c in every.columns if c != "gid"]), "chosen")
    # few bytes become many pairs: dealt by the number of pairs, not by bytes
    tasks = max(every.sparkSession.sparkContext.defaultParallelism, math.ceil(every.count() * mine.count() / PAIRS))
    t = every.withColumnRenamed("gid", "candidate").repartition(tasks).join(mine, F.col("candidate") != F.col("gid"))
    both = F.map_zip_with("frames", "own_frames", lambda k, a, b: F.coalesce(F.bit_count(a.bitwiseAND(b)), F.lit(0)))
    many = F.aggregate(F.map_values(both), F.lit(0), lambda s, v: s + v)
    # ids within one block, as in short videos, need no maps
    one = F.when(F.col("block") == F.col("own_block"), F.bit_count(F.col("bits").bitwiseAND(F.col("own_bits")))).otherwise(0)
    t = t.withColumn("n", F.when(F.col("block").isNotNull() & F.col("own_block").isNotNull(), one).otherwise(many))
    differ = lambda c: F.when(F.col(c) != F.col(f"own_{c}"), F.lit(c))
    reasons = F.concat_ws(";", differ("team"), F.when(F.col("n") > 0, F.concat(F.lit("together:"), F.col("n").cast("string"))), differ("person"), differ("number"))
    t = t.select("gid", "candidate", F.coalesce(F.col("person") == F.col("own_person"), F.lit(False)).alias("linked"), reasons.alias("reasons"))
    return t.select("gid", "candidate", (F.col("reasons") == "").alias("compatible"), "linked", "reasons")


def new_ids(rows: DataFrame, key: str, segment: str) -> DataFrame:
    """rows with new_<key>: segment 0 keeps its id, further segments get ids after the largest one, in order of (id, segment); no task sorts them all."""
    top = rows.agg(F.max(key).alias("_top"))  # one row
    more = seq.row_index(rows.select(key, segment).distinct().where(F.col(segment) > 0), [], key, [segment], "_rank").withColumn("_rank", F.col("_rank") + 1)
    t = rows.join(more, [key, segment], "left").crossJoin(F.broadcast(top))
    return t.withColumn(f"new_{key}", F.when(F.col("_rank").isNull(), F.col(key).cast("long")).otherwise((F.col("_top") + F.col("_rank")).cast("long"))).drop("_rank", "_top")


def partition_ids(segments: DataFrame, key: str = "gid", segment: str = "segment", mode: str = "mode") -> DataFrame:
    """(key, mode, new_<key>) of an id's segments (key, segment, mode): the first segment's mode keeps the id, each other mode gets one id for all its segments, after the largest id, in order of (id, first segment)."""
    top = segments.agg(F.max(key).alias("_top"))  # one row
    per = segments.groupBy(key, mode).agg(F.min(segment).alias("_s")).withColumn("_first", F.min("_s").over(Window.partitionBy(key)) == F.col("_s"))
    more = seq.row_index(per.where("not _first"), [], key, ["_s"], "_rank").select(key, mode, "_rank")
    t = per.join(more, (per[key] == more[key]) & per[mode].eqNullSafe(more[mode]), "left").select(per[key], per[mode], "_rank")
    new = F.when(F.col("_rank").isNull(), F.col(key).cast("long")).otherwise((F.col("_top") + F.col("_rank") + 1).cast("long"))
    return t.crossJoin(F.broadcast(top)).select(key, mode, new.alias(f"new_{key}"))


def people(rows: DataFrame, key: str) -> DataFrame:
    """Rows of one person put together: sums of distance, time and sprints, largest speed, whether any has a card, and the time-weighted mean of confirmed scores (a second at least each) with a status: confirmed, partial or pending; notes in order, each once."""
    d = lambda c: F.sum(c.cast("decimal(28,6)")).cast("double")
    ok = F.col("status") == "confirmed"
    w = F.when(ok, F.greatest(F.lit(1.0), F.col("seconds")))
    notes = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("note") != "", F.struct("gid", "note")))), lambda s: s["note"]))
    return rows.groupBy(key).agg(
        F.round(d(F.col("distance")), 3).alias("distance"), F.round(d(F.col("seconds")), 3).alias("seconds"), F.sum("sprints").alias("sprints"), F.max("peak").alias("peak"), F.bool_or("card").alias("card"),
        F.round(d(F.col("score") * w) / d(w), 4).alias("score"), F.when(F.count_if(ok) == F.count("*"), "confirmed").when(F.count_if(ok) > 0, "partial").otherwise("pending").alias("status"),
        F.array_join(notes, "; ").alias("notes"),
    )
