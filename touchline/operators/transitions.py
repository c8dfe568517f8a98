"""Lasting changes of a track's mode, told from flicker, occlusion and short excursions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _majority(side: Column) -> Column:
    """The commonest mode of an array of (frame, mode) as (count, mode), that seen first on ties; null without rows."""
    modes = F.transform(side, lambda r: r["mode"])
    count = lambda m: F.size(F.filter(modes, lambda x: x == m))
    best = F.array_max(F.transform(F.array_distinct(modes), lambda m: F.struct(count(m).alias("n"), (-F.array_position(modes, m)).alias("at"), m.alias("mode"))))
    return F.when(F.size(side) > 0, best)


def persistent(
    rows: DataFrame, keys: list[str], frame: str = "frame", mode: str = "mode", confidence: str = "confidence", *, window: int = 8, least: int = 5, purity: float = 0.75,
    trust: float = 0.35, span: int | None = None, cooldown: int = 12, horizon: int = 30,
) -> DataFrame:
    """(keys, cut_frame, before_mode, after_mode, before_purity, after_purity, before_evidence, after_evidence) of rows (keys, frame, mode, confidence), a row per key and frame.

    Evidence are rows with a mode and a confidence of `trust` or more. Before each row stand its key's last `window` rows of evidence within `span` frames, after it the first ones as far; where
    both sides have `least` of them and a mode with a share of `purity`, and the modes differ, there is a change, at the first evidence of the new mode.
    Of changes in turn, those less than `cooldown` frames after an accepted one, or the same way as it, are left out; two that undo each other within `horizon` frames go both.
    Keys with less evidence than both sides need have no change. Only a key's changes meet in one row; the windows hold `window` rows.
    """
    span = max(window * 3, 18) if span is None else span
    w = Window.partitionBy(*keys).orderBy(frame)
    sure = F.col(mode).isNotNull() & (F.col(confidence) >= trust)
    seen = rows.where(sure).select(*keys, F.col(frame).alias("_f"), F.col(mode).alias("_m"))
    # each row of evidence with those before and after it, itself included
    item = F.struct(F.col("_f").alias("frame"), F.col("_m").alias("mode"))
    v = Window.partitionBy(*keys).orderBy("_f")
    seen = seen.select(*keys, "_f", F.collect_list(item).over(v.rowsBetween(1 - window, 0)).alias("_back"), F.collect_list(item).over(v.rowsBetween(0, window - 1)).alias("_fore"), F.count("*").over(Window.partitionBy(*keys)).alias("_all"))
    seen = seen.where(F.col("_all") >= 2 * least).drop("_all")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys] + [F.col(f"r.{frame}") == F.col("s._f")]
    t = rows.select(*keys, frame).alias("r").join(seen.alias("s"), same, "left").select(*[f"r.{k}" for k in keys], f"r.{frame}", "_back", "_fore")
    down = Window.partitionBy(*keys).orderBy(F.col(frame).desc()).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_b", F.last("_back", True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_a", F.last("_fore", True).over(down)).withColumn("_k", F.row_number().over(w))
    at = F.col(frame)
    t = t.where("_k > 1 and _b is not null and _a is not null")
    t = t.withColumn("_b", F.filter("_b", lambda r: r["frame"] >= at - span)).withColumn("_a", F.filter("_a", lambda r: r["frame"] <= at + span))
    t = t.withColumn("_bm", _majority(F.col("_b"))).withColumn("_am", _majority(F.col("_a")))
    for s in "ba":
        t = t.where((F.size(f"_{s}") >= least) & (F.col(f"_{s}m.n") >= purity * F.size(f"_{s}")))
    t = t.where("_bm.mode <> _am.mode")
    new = F.array_min(F.transform(F.filter("_a", lambda r: r["mode"] == F.col("_am.mode")), lambda r: r["frame"]))
    share = lambda s: F.col(f"_{s}m.n") / F.size(f"_{s}")
    t = t.select(
        *keys, F.col(frame).alias("_at"), new.alias("cut_frame"), F.col("_bm.mode").alias("before_mode"), F.col("_am.mode").alias("after_mode"), share("b").alias("before_purity"), share("a").alias("after_purity"),
        F.size("_b").cast("long").alias("before_evidence"), F.size("_a").cast("long").alias("after_evidence"),
    )
    names = [*keys, "cut_frame", "before_mode", "after_mode", "before_purity", "after_purity", "before_evidence", "after_evidence"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        accepted: list = []
        for r in pdf.sort_values("_at").itertuples(index=False):
            if accepted:
                last = accepted[-1]
                if r.cut_frame - last.cut_frame < cooldown or (r.before_mode, r.after_mode) == (last.before_mode, last.after_mode):
                    continue
            accepted.append(r)
        kept, k = [], 0
        while k < len(accepted):
            if k + 1 < len(accepted):
                a, b = accepted[k], accepted[k + 1]
                if b.cut_frame - a.cut_frame <= horizon and a.before_mode == b.after_mode and a.after_mode == b.before_mode:
                    k += 2
                    continue
            kept.append(accepted[k])
            k += 1
        return pd.DataFrame(kept, columns=pdf.columns)[names]

    schema = ", ".join(f"`{n}` {dict(t.dtypes)[n]}" for n in names)
    return t.groupBy(*keys).applyInPandas(fold, schema)
