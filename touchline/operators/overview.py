"""What a match's pages show: summaries, teams, quality, trials, replays, timelines and networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.functions import seq


def _money(c: Column, digits: int = 6) -> Column:
    """A sum that doesn't hang on the order of its rows."""
    return F.sum(c.cast(f"decimal(38,{digits})")).cast("double")


def _some(df: DataFrame, name: str) -> DataFrame:
    """One row: whether df has any."""
    return df.select(F.lit(1).alias("_one")).limit(1).agg((F.count("*") > 0).alias(name))


def confirmed_number(status: Column, *numbers: Column) -> Column:
    """Whether a status says confirmed, or some number is there."""
    told = F.coalesce(F.contains(F.lower(status), F.lit("confirm")), F.lit(False))
    for n in numbers:
        told = told | F.coalesce(F.trim(n.cast("string")) != "", F.lit(False))
    return told


def summary(running: DataFrame, passes: DataFrame, intervals: DataFrame, numbers: DataFrame, cards: DataFrame, sections: dict[str, DataFrame]) -> DataFrame:
    """One row: ids, cards, distance and peak speed over all ids (running: gid, distance, peak), passes, intervals, confirmed numbers (gid, status, number), and which sections have something to show, as a map."""
    one = running.agg(F.count_distinct("gid").alias("candidate_ids"), F.round(F.coalesce(_money(F.col("distance")), F.lit(0.0)), 1).alias("total_distance_m"), F.round(F.coalesce(F.max("peak"), F.lit(0.0)), 2).alias("peak_speed_mps"))
    counts = [
        cards.agg(F.count("*").alias("confirmed_player_cards")), passes.agg(F.count("*").alias("pass_candidates")), intervals.agg(F.count("*").alias("possession_intervals")),
        numbers.agg(F.count_if(confirmed_number(F.col("status"), F.col("number"))).alias("confirmed_numbers")), *[_some(df, f"_has_{n}") for n, df in sections.items()],
    ]
    for c in counts:  # one row each
        one = one.crossJoin(F.broadcast(c))
    has = [x for n in sections for x in (F.lit(n), F.col(f"_has_{n}"))]
    return one.withColumn("sections", F.create_map(*has)).drop(*[f"_has_{n}" for n in sections])


def teams(members: DataFrame, running: DataFrame, passes: DataFrame, intervals: DataFrame) -> DataFrame:
    """A row per team with passes: its ids, their distance and peak speed, its passes and their metres, and its share of all teams' possession frames (those of ids without a team count in the whole).

    members (gid, team), running (gid, distance, peak), passes (team, displacement), intervals (gid, start_frame, end_frame).
    """
    per = passes.groupBy("team").agg(F.count("*").alias("passes"), F.round(_money(F.col("displacement"), 9), 1).alias("pass_distance_m"), F.round(_money(F.col("displacement"), 9) / F.count("*"), 2).alias("mean_pass_distance_m"))
    who = members.join(running, "gid", "left").groupBy("team").agg(
        F.sort_array(F.collect_set("gid")).alias("player_ids"), F.round(F.coalesce(_money(F.col("distance")), F.lit(0.0)), 1).alias("distance_m"), F.round(F.coalesce(F.max("peak"), F.lit(0.0)), 2).alias("peak_speed_mps")
    )
    held = intervals.join(members, "gid", "left").groupBy("team").agg(F.sum(F.greatest(F.lit(0), F.col("end_frame") - F.col("start_frame") + 1)).alias("_f"))
    # a row per team
    held = held.withColumn("possession_share", F.round(F.col("_f") / F.sum("_f").over(Window.partitionBy()), 4)).drop("_f").where("team is not null")
    total = intervals.agg((F.count("*") > 0).alias("_any"))  # one row
    t = per.join(who, "team", "left").join(held, "team", "left").crossJoin(F.broadcast(total))
    return t.select(
        "team", F.coalesce("player_ids", F.array().cast(dict(who.dtypes)["player_ids"])).alias("player_ids"), F.coalesce(F.size("player_ids"), F.lit(0)).alias("player_count"), F.coalesce("distance_m", F.lit(0.0)).alias("distance_m"),
        F.coalesce("peak_speed_mps", F.lit(0.0)).alias("peak_speed_mps"), "passes", "pass_distance_m", "mean_pass_distance_m", F.when(F.col("_any"), F.coalesce("possession_share", F.lit(0.0))).alias("possession_share"),
    )


def quality(numbers: DataFrame, review: DataFrame, people: DataFrame, frames: DataFrame, cuts: DataFrame) -> DataFrame:
    """One row: the numbers' statuses as a map of counts, the passes' labels (review: machine, human; null is open), confirmed people (status), the calibration's accepted frames (accepted), and cuts (gid) of the identity audit."""
    status = numbers.groupBy(F.coalesce(F.nullif(F.trim("status"), F.lit("")), F.lit("unknown")).alias("s")).agg(F.count("*").alias("n"))
    one = status.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("numbers"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("s", "n")))).alias("status_counts"))  # a row per status
    said = F.count("human")
    labels = review.agg(F.count("*").alias("sample_size"), said.alias("labelled"), F.when((F.count("*") > 0) & (said == F.count("*")), "complete").otherwise("pending").alias("review_status"), F.when(said > 0, F.round(F.count_if(F.col("human") == F.col("machine")) / said, 6)).alias("agreement_rate"))
    sure = F.count_if(F.col("status") == "confirmed")
    who = people.agg(sure.alias("people_confirmed"), F.count("*").alias("people"), F.when((F.count("*") > 0) & (sure == F.count("*")), "complete").when(sure > 0, "partial").otherwise("pending").alias("people_status"))
    cal = frames.agg(F.count_if("accepted").alias("calibrated_frames"), F.round(F.count_if("accepted") / F.nullif(F.count("*"), F.lit(0)), 6).alias("calibrated_share"))
    audit = cuts.agg(F.count_distinct("gid").alias("ids_with_transitions"), F.count("*").alias("detected_transitions"))
    for c in (labels, who, cal, audit):  # one row each
        one = one.crossJoin(F.broadcast(c))
    return one


def trials(boxes: DataFrame, frames: DataFrame, fps: float) -> DataFrame:
    """Per trial: frames and seconds, mean boxes a frame, ids, new ids a minute, median length of a track and tracks shorter than ten frames. boxes (trial, frame, gid), frames (trial, n): a trial's frames, also those without a box."""
    tracks = boxes.groupBy("trial", "gid").agg(F.count("*").alias("length"))
    per = tracks.groupBy("trial").agg(F.sum("length").alias("boxes"), F.count("*").alias("ids"), F.count_if(F.col("length") < 10).alias("short_tracks"))
    t = frames.join(per, "trial", "left").join(seq.percentile(tracks, ["trial"], "length", 0.5, "median_length"), "trial", "left").na.fill(0, ["boxes", "ids", "short_tracks"]).na.fill(0.0, ["median_length"])
    seconds = F.col("n") / max(fps, 1e-9)
    return t.select(
        "trial", F.col("n").alias("frames"), seconds.alias("seconds"), F.round(F.col("boxes") / F.greatest("n", F.lit(1)), 4).alias("mean_boxes_per_frame"), "ids",
        F.round(F.col("ids") / F.greatest(seconds / 60, F.lit(1e-9)), 3).alias("new_ids_per_minute"), "median_length", "short_tracks",
    )


def recommended(trials_: DataFrame, baseline: str) -> DataFrame:
    """Each other trial against the baseline's row: `candidate` if it keeps 95 % of the boxes and of the median length, and has a tenth fewer new ids a minute at least; else `baseline`."""
    cols = ["mean_boxes_per_frame", "new_ids_per_minute", "median_length"]
    base = trials_.where(F.col("trial") == baseline).select(*[F.col(c).alias(f"_{c}") for c in cols])  # one row
    ok = (F.col(cols[0]) >= F.col(f"_{cols[0]}") * 0.95) & (F.col(cols[1]) <= F.col(f"_{cols[1]}") * 0.90) & (F.col(cols[2]) >= F.col(f"_{cols[2]}") * 0.95)
    return trials_.where(F.col("trial") != baseline).crossJoin(F.broadcast(base)).select("trial", F.when(ok, "candidate").otherwise("baseline").alias("recommended"))


def replay(players: DataFrame, members: DataFrame, numbers: DataFrame, boxes: DataFrame, ball: DataFrame, ball_image: DataFrame) -> DataFrame:
    """(frame, players array<struct>, ball, ball_image) of the frames with players or a ball: everything that a replay of the frame draws.

    players (frame, gid, x, y, speed, foot_x, foot_y): rows without an id or a finite place are left out. members (gid, team), numbers (gid, number, status; confirmed ones only count), boxes (frame, gid, x, y, w, h, confidence),
    ball (frame, bx, by, source; observed ones only), ball_image (frame, px, py). A player's box and picture point are null where they weren't seen.
    """
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    p = players.where(F.col("gid").isNotNull() & (F.col("frame") >= 0) & finite(F.col("x")) & finite(F.col("y")))
    num = numbers.select("gid", F.when(F.contains(F.lower("status"), F.lit("confirm")), F.col("number").cast("string")).alias("number"))
    b = boxes.select("frame", "gid", F.array(*[F.round(c, 2) for c in "xywh"], F.round("confidence", 3)).alias("bbox"))
    t = p.join(members, "gid", "left").join(num, "gid", "left").join(b, ["frame", "gid"], "left")
    image = F.when(finite(F.col("foot_x")) & finite(F.col("foot_y")), F.array(F.round("foot_x", 2), F.round("foot_y", 2)))
    one = F.struct(
        F.col("gid").alias("id"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(F.coalesce("speed", F.lit(0.0)), 2).alias("speed"), F.coalesce("team", F.lit("unassigned")).alias("team_id"),
        F.coalesce("number", F.lit("")).alias("number"), image.alias("image"), F.col("bbox").alias("bbox"),
    )
    out = t.groupBy("frame").agg(F.sort_array(F.collect_list(one)).alias("players"))
    seen = ball.where((F.lower(F.coalesce("source", F.lit("observed"))) == "observed") & F.col("bx").isNotNull()).select("frame", F.array(F.round("bx", 3), F.round("by", 3)).alias("ball"))
    drawn = ball_image.where(finite(F.col("px")) & finite(F.col("py"))).select("frame", F.array(F.round("px", 2), F.round("py", 2)).alias("ball_image"))
    return out.join(seen, "frame", "full").join(drawn, "frame", "full")


#: How the timeline shows semantic events.
SEMANTIC = {"shielding_under_pressure": "shield", "counterpress_recovery": "counterpress", "goal_candidate": "goal"}


def timeline(passes: DataFrame, transitions: DataFrame, actions: DataFrame, semantic: DataFrame, fps: float) -> DataFrame:
    """(type, time_sec, end_time_sec, team, from_id, to_id, distance_m, classification, review): passes, turnovers to the opponent, actions and semantic events as one table.

    passes and transitions (end_frame, to_start_frame, from_team, to_team, from_gid, to_gid, displacement, kind), actions (frame, event_type, gid, status), semantic (frame, end_time, event_type, team, gid, other, distance). Sort and limit it by time.
    """
    null = lambda t: F.lit(None).cast(t)

    def rows(df, kind, start, end, team, a, b, metres, cls, review):
        return df.select(kind.alias("type"), start.cast("double").alias("time_sec"), end.cast("double").alias("end_time_sec"), team.cast("string").alias("team"), a.cast("int").alias("from_id"), b.cast("int").alias("to_id"), metres.cast("double").alias("distance_m"), cls.cast("string").alias("classification"), review.cast("string").alias("review"))

    c, at = F.col, lambda n: F.col(n) / fps
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in SEMANTIC.items() for x in p]), c("event_type")), F.lit("key"))
    return (
        rows(passes, F.lit("pass"), at("end_frame"), at("to_start_frame"), c("from_team"), c("from_gid"), c("to_gid"), c("displacement"), c("kind"), F.lit("review"))
        .unionByName(rows(transitions.where("kind = 'opponent'"), F.lit("turnover"), at("end_frame"), at("to_start_frame"), c("to_team"), c("from_gid"), c("to_gid"), c("displacement"), c("kind"), F.lit("automatic")))
        .unionByName(rows(actions, F.lit("key"), at("frame"), null("double"), null("string"), c("gid"), null("int"), null("double"), c("event_type"), F.coalesce("status", F.lit("candidate"))))
        .unionByName(rows(semantic, kind, at("frame"), c("end_time"), c("team"), c("gid"), c("other"), c("distance"), c("event_type"), F.lit("candidate_review")))
    )


def network(passes: DataFrame, every: int, last: int, top: int = 10) -> DataFrame:
    """(frame, team, from_gid, to_gid, n, rank): at each `every`-th frame up to `last` the pairs with the most passes so far. passes (team, from_gid, to_gid, frame).

    A pass counts at the first of these frames that isn't before it; a pair's counts are summed from there on.
    """
    pair = ["team", "from_gid", "to_gid"]
    at = (F.ceil(F.col("frame") / every) * every).cast("long")
    n = passes.select(*pair, at.alias("frame")).where(F.col("frame") <= last).groupBy(*pair, "frame").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*pair).orderBy("frame")
    n = n.withColumn("n", F.sum("c").over(w)).withColumn("_to", F.coalesce(F.lead("frame").over(w) - every, F.lit(last // every * every)))
    n = n.select(*pair, "n", F.explode(F.sequence(F.col("frame"), F.col("_to"), F.lit(every).cast("long"))).alias("frame"))
    rank = F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("n"), *pair))
    return n.withColumn("rank", rank).where(F.col("rank") <= top).select("frame", *pair, "n", "rank")


def frame_totals(det: DataFrame, frames: int | None = None) -> DataFrame:
    """One row: records, ids, frames (of the video, or to the last one seen), frames with detections, mean and most detections in a frame, and how many (id, frame) come more than once."""
    per = det.groupBy("frame").agg(F.count("*").alias("c"))
    one = per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("records"), F.count("*").alias("frames_with_detections"), F.coalesce(F.max("c"), F.lit(0)).alias("max_detections"), F.coalesce(F.max("frame") + 1, F.lit(0)).alias("_last"))
    keys = det.groupBy("gid", "frame").agg(F.count("*").alias("c"))
    two = keys.agg(F.count_distinct("gid").alias("identities"), F.count_if(F.col("c") > 1).alias("duplicate_keys"))
    n = F.lit(frames) if frames is not None else F.col("_last")
    t = one.crossJoin(F.broadcast(two)).withColumn("frames", n.cast("long"))  # one row each
    return t.select("records", "identities", "frames", "frames_with_detections", F.round(F.when(F.col("frames") > 0, F.col("records") / F.col("frames")).otherwise(0.0), 6).alias("mean_detections"), "max_detections", "duplicate_keys")


def purities(labels: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, n, purity): the share of a partition's commonest label; null and negative labels are unknown and don't count."""
    per = labels.where(F.col(label) >= 0).groupBy(*keys, label).agg(F.count("*").alias("c"))
    return per.groupBy(*keys).agg(F.sum("c").alias("n"), (F.max("c") / F.sum("c")).alias("purity"))


def purity_report(partitions: DataFrame, bound: float = 0.8) -> DataFrame:
    """One row: partitions, least and median purity, and how many are below the bound."""
    one = partitions.agg(F.count("*").alias("partitions"), F.round(F.min("purity"), 8).alias("least"), F.count_if(F.col("purity") < bound).alias("below"))
    middle = seq.percentile(partitions, [], "purity", 0.5, "median").select(F.round("median", 8).alias("median"))
    return one.join(F.broadcast(middle), F.lit(True), "left")  # one row each
