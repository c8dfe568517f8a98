"""Motion between frames: turning, speed signals, states at any time, dense calibration, cards of running."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.functions import seq
from touchline.functions.geom import distance, inside

#: Fixed values of a running card: speeds beyond which a row is abnormal, and above which it belongs to a sprint, in m/s.
ABNORMAL, SPRINT = 15.0, 4.5


def turning(df: DataFrame, key: str, frame: str) -> DataFrame:
    """Velocity by central differences (one-sided at the ends of a key) and the angle between a row's and the next row's velocity, 0 where one of them is next to nothing."""
    w = Window.partitionBy(key).orderBy(frame)

    def grad(c: str):
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        mid = F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - F.col(c)).when(after.isNull(), F.col(c) - before)
        return mid.otherwise((after - before) / 2)

    t = df.withColumn("vx", grad("x")).withColumn("vy", grad("y"))
    t = t.withColumn("_nx", F.lead("vx").over(w)).withColumn("_ny", F.lead("vy").over(w))
    n, m = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")), F.sqrt(F.col("_nx") * F.col("_nx") + F.col("_ny") * F.col("_ny"))
    c = (F.col("vx") * F.col("_nx") + F.col("vy") * F.col("_ny")) / (n * m)
    angle = F.when((n > 1e-6) & (m > 1e-6), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))).otherwise(0.0)
    return t.withColumn("angle", angle).drop("_nx", "_ny")


def speed_signal(points: DataFrame, fps: float, longest: int = 3, radius: int = 2, weight: float = 0.5) -> DataFrame:
    """(frame, speed, z): per frame the largest speed of an id over steps of at most so many frames, box-smoothed over all frames from 0 to the last (0 where none moves), and its weighted z-score.

    Frames that no value reaches aren't returned; they count as 0 in mean and deviation.
    """
    w = Window.partitionBy("gid").orderBy("frame")
    g = F.col("frame") - F.lag("frame").over(w)
    d = distance(F.col("x"), F.col("y"), F.lag("x").over(w), F.lag("y").over(w))
    steps = points.select("frame", g.alias("g"), (d / g * fps).alias("speed")).where(F.col("g").between(1, longest))
    top = steps.groupBy("frame").agg(F.max("speed").alias("speed"))
    s = seq.box_sum(top, "frame", "speed", radius).withColumn("speed", F.round(F.col("speed") / (2 * radius + 1), 9))
    last = points.agg((F.max("frame") + 1).alias("_n"))  # one row
    s = s.crossJoin(F.broadcast(last)).where(F.col("frame").between(0, F.col("_n") - 1))
    x = F.col("speed").cast("decimal(28,9)")
    stat = s.agg(F.sum(x).cast("double").alias("_s"), F.sum((F.col("speed") * F.col("speed")).cast("decimal(28,9)")).cast("double").alias("_q"))
    mean = F.col("_s") / F.col("_n")
    sd = F.sqrt(F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0)))
    return s.crossJoin(F.broadcast(stat)).select("frame", "speed", F.when(sd > 1e-6, weight * (F.col("speed") - mean) / sd).otherwise(0.0).alias("z"))


def states_at(times: DataFrame, points: DataFrame, longest: int) -> DataFrame:
    """times (gid, t) with x and y at t: exact, linear between two neighbouring frames at most so far apart, else those of the nearer one (the earlier on ties)."""
    rows = times.select("gid", "t", F.lit(1).alias("_r"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    rows = rows.unionByName(points.select("gid", F.col("frame").cast("double").alias("t"), F.lit(0).alias("_r"), "x", "y"))
    p = F.when(F.col("_r") == 0, F.struct("t", "x", "y"))
    back = Window.partitionBy("gid").orderBy("t", "_r").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("gid").orderBy(F.col("t").desc(), "_r").rowsBetween(Window.unboundedPreceding, 0)
    t = rows.withColumn("_b", F.last(p, True).over(back)).withColumn("_f", F.last(p, True).over(ahead)).where("_r = 1 and (_b is not null or _f is not null)")
    b, f = F.col("_b"), F.col("_f")
    near = F.when(b.isNull() | (f["t"] - F.col("t") < F.col("t") - b["t"]), f).otherwise(b)
    part = (F.col("t") - b["t"]) / (f["t"] - b["t"])
    inner = b.isNotNull() & f.isNotNull() & (f["t"] > b["t"]) & (f["t"] - b["t"] <= longest)
    val = lambda c: F.when(inner, b[c] + (f[c] - b[c]) * part).otherwise(near[c]).alias(c)
    return t.select("gid", "t", val("x"), val("y"))


def dense_calibration(samples: DataFrame, frames: DataFrame, keys: list[str], at: str, values: str, most: int) -> DataFrame:
    """frames with the samples' matrices, cell by cell linear between the samples around them, and `accepted`: the bracket is at most so wide. A frame that is a sample has the distance to the sample before as its bracket (to the one after for the first)."""
    w = Window.partitionBy(*keys).orderBy(at)
    s = samples.withColumn("_p", F.lag(at).over(w)).withColumn("_n", F.lead(at).over(w)).withColumn("_v", F.lead(values).over(w))
    exact = s.select(*keys, at, F.col(values).alias("_h"), F.coalesce(F.col(at) - F.col("_p"), F.col("_n") - F.col(at)).alias("bracket"))
    inner = s.where("_n is not null").withColumn("_at", F.explode(F.expr(f"filter(sequence({at}, _n), f -> f > {at} and f < _n)")))
    inner = inner.withColumn("bracket", F.col("_n") - F.col(at)).withColumn("_part", (F.col("_at") - F.col(at)) / F.col("bracket"))
    inner = inner.withColumn("_h", F.zip_with(values, "_v", lambda p, q: p + (q - p) * F.col("_part"))).drop(at).withColumnRenamed("_at", at).select(*keys, at, "_h", "bracket")
    out = frames.join(exact.unionByName(inner), [*keys, at])
    return out.withColumn(values, F.col("_h")).drop("_h").withColumn("accepted", F.coalesce(F.col("bracket") <= most, F.lit(False)))


def eligible(det: DataFrame, bounds: tuple[float, float, float, float], window: int, keys: tuple[str, ...] = (), calibrated: DataFrame | None = None) -> DataFrame:
    """Rows that a path is made of: frames that hold an id more than once, points out of bounds and, with calibrated (keys, frame), frames that aren't there are dropped first, and split the runs; runs shorter than the window go. `run` names a run within its id."""
    who = [*keys, "gid"]
    once = det.groupBy(*who, "frame").agg(F.count("*").alias("_c"), F.first("x").alias("x"), F.first("y").alias("y")).where("_c = 1").drop("_c")
    once = once.where(inside(F.col("x"), F.col("y"), bounds))
    if calibrated is not None:
        once = once.join(calibrated.select(*keys, "frame").distinct(), [*keys, "frame"], "left_semi")
    r = seq.runs(once, who, "frame")
    return r.withColumn("_n", F.count("*").over(Window.partitionBy(*who, "run"))).where(F.col("_n") >= window).drop("_n")


def running_report(det: DataFrame, series: DataFrame, bounds: tuple[float, float, float, float], window: int, interval: int, fps: float, high: float = 4.5) -> DataFrame:
    """Per id the measures of its path (series, by running.timeseries() over eligible() rows) with what was left out of it and why, as counts and flags."""
    per = det.groupBy("gid", "frame").agg(F.count("*").alias("c"), F.first("x").alias("x"), F.first("y").alias("y"))
    ok = inside(F.col("x"), F.col("y"), bounds)
    seen = per.groupBy("gid").agg(F.count("*").alias("observed"), F.count_if(F.col("c") > 1).alias("collisions"), F.count_if((F.col("c") == 1) & ~ok).alias("out_of_bounds"), F.count_if((F.col("c") == 1) & ok).alias("fit"))
    m = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
    path = series.groupBy("gid").agg(
        F.count("*").alias("eligible"), F.max("segment").cast("long").alias("segments"), F.count("step").alias("steps"), m(F.col("step")).alias("distance"),
        m(F.when(F.col("speed") > high, F.col("step"))).alias("fast"), F.percentile("speed", F.lit(0.95)).alias("p95"),
    )
    t = seen.join(path, "gid", "left").fillna(0, ["eligible", "segments", "steps"]).fillna(0.0, ["distance", "fast", "p95"])
    short = F.col("fit") - F.col("eligible")
    flag = lambda c, name: F.when(c, name)
    flags = F.concat_ws(
        ";", flag(F.col("collisions") > 0, "identity_collision"), flag(F.col("out_of_bounds") > 0, "out_of_bounds"), flag(short > 0, "short_segments_excluded"),
        flag(F.col("observed") / interval < 0.5, "low_visible_coverage"), flag(F.col("steps") == 0, "no_valid_steps"),
    )
    return t.select(
        "gid", F.round("distance", 3).alias("distance_m"), F.round("fast", 3).alias("high_speed_m"), F.round("p95", 3).alias("p95_speed"), "steps", F.round(F.col("steps") / fps, 3).alias("seconds"),
        "eligible", "observed", F.round(F.col("observed") / interval, 6).alias("coverage"), "segments", "collisions", "out_of_bounds", short.alias("short"), flags.alias("flags"),
    )


def running_card(series: DataFrame, fps: float, join_gap: int, least: int, peak_rows: int) -> DataFrame:
    """Per id: distance, sprints and their distance (dips within a sprint count), the largest median speed over so many rows in a run, P95, visible frames, abnormal rows.

    series has gid, frame, speed, step. Rows of abnormal speed are left out; runs are consecutive frames with a speed. A sprint is fast rows at most join_gap apart, at least `least` of them.
    """
    odd = F.coalesce(F.col("speed") > ABNORMAL, F.lit(False))
    whole = series.groupBy("gid").agg(
        F.count_if(odd).alias("abnormal"), F.count_if(~odd).alias("visible"), F.round(F.coalesce(F.sum(F.when(~odd, F.col("step")).cast("decimal(38,9)")).cast("double"), F.lit(0.0)), 3).alias("distance"),
        F.round(F.coalesce(F.percentile(F.when(~odd, F.col("speed")), F.lit(0.95)), F.lit(0.0)), 3).alias("p95"),
    )
    r = seq.runs(series.where(~odd & F.col("speed").isNotNull()), "gid", "frame")
    w = Window.partitionBy("gid", "run").orderBy("frame")
    ahead = w.rowsBetween(0, peak_rows - 1)
    v = F.sort_array(F.collect_list("speed").over(ahead))
    mid = (F.get(v, F.lit((peak_rows - 1) // 2)) + F.get(v, F.lit(peak_rows // 2))) / 2
    peak = r.select("gid", F.when(F.count("*").over(ahead) == peak_rows, mid).alias("m")).groupBy("gid").agg(F.max("m").alias("peak"))
    fast = F.col("speed") > SPRINT
    last = F.last(F.when(fast, F.col("frame")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    b = r.withColumn("_f", fast).withColumn("_new", F.when(fast & (last.isNull() | (F.col("frame") - last - 1 > join_gap)), 1).otherwise(0))
    b = b.withColumn("bout", F.sum("_new").over(w)).withColumn("_last", F.last(F.when(F.col("_f"), F.col("frame")), True).over(Window.partitionBy("gid", "run", "bout").orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    b = b.where("bout > 0 and frame <= _last").groupBy("gid", "run", "bout").agg(F.count_if("_f").alias("n"), F.sum(F.col("step").cast("decimal(38,9)")).alias("d")).where(F.col("n") >= least)
    sprints = b.groupBy("gid").agg(F.count("*").alias("sprints"), F.round(F.sum("d").cast("double"), 3).alias("sprint_m"))
    t = whole.join(peak, "gid", "left").join(sprints, "gid", "left").fillna(0, ["sprints"]).fillna(0.0, ["sprint_m", "peak"])
    return t.select("gid", "distance", "sprints", "sprint_m", F.round("peak", 3).alias("peak"), "p95", "visible", F.round(F.col("visible") / fps, 3).alias("seconds"), "abnormal")
