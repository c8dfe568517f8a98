"""The table of machine events: who acted, what backs it, and one header row; annotated ledgers matched to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.functions import attributes, scalars, seq

#: Seconds before and after an event in which its actor is looked for, and shown around an event's anchor.
LOOK, SHOW = (0.55, 0.15), (3.0, 2.0)
#: The fee for half a second off the event, the largest distance of an actor in box heights, the lead over the next one and the distance that make an actor sure.
FEE, FAR, LEAD, CLOSE = 0.18, 1.25, 0.12, 0.15
#: Where events come from, in the order of their counts.
SOURCES = {"stage4_action_candidate": "stage4_action_candidates", "stable_possession_transition": "possession_transitions", "pass_network_candidate": "active_directed_pass_candidates", "semantic_event_candidate": "semantic_event_candidates"}
#: What an events document says of itself and of its events.
VERSION, LABELS, REVIEW = "events-for-annotation-v1", "machine_candidates_without_human_labels", "candidate_requires_review"
#: Why an event has its actor or none, and how a ledger's row got its own.
NEAREST, TOO_FAR, NOBODY, PROVISIONAL = "nearest_player_before_event_peak", "nearest_player_too_far_from_ball", "no_reliable_ball_player_overlap", "provisional_nearest_detector_event"
CANDIDATE = "struct<global_id:int,attribution_score:double,evidence_frame_proc:int,normalized_ball_distance:double>"


def attributed(events: DataFrame, ball: DataFrame, boxes: DataFrame, fps: float, keys: list[str] | None = None, top: int = 3) -> DataFrame:
    """events (keys, event_id, frame) -> (keys, event_id, primary_global_id, actor_status, actor_reason, actor_candidates): who was nearest to the ball around the event, and whether that is sure.

    ball (keys, frame, bx, by, reliable): only reliable frames count. boxes (keys, frame, gid, x, y, w, h). Per id the least cost, distance in box heights and a fee for time, counts, at its first frame; the `top` ids are
    ranked by cost, then id. The best is the actor if near enough; `auto` if it also leads by enough or is very close, else `review`. Events without a reliable ball near a box keep an empty list.
    """
    keys = keys or []
    # halves go to the even frame
    low = F.greatest(F.lit(0), F.bround(F.col("frame") - LOOK[0] * fps).cast("int"))
    high = F.bround(F.col("frame") + LOOK[1] * fps).cast("int")
    at = events.select(*keys, "event_id", F.col("frame").alias("_at"), low.alias("_low"), high.alias("_high")).where("_low <= _high")
    at = at.select(*keys, "event_id", "_at", F.explode(F.sequence("_low", "_high")).alias("frame"))
    t = at.join(ball.where("reliable and not isnan(bx) and not isnan(by)"), [*keys, "frame"]).join(boxes, [*keys, "frame"])
    d = scalars.rectangle_distance(F.col("bx"), F.col("by"), F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    cost = d + FEE * (F.abs(F.col("frame") - F.col("_at")) / max(fps * 0.5, 1.0))
    best = t.groupBy(*keys, "event_id", "gid").agg(F.min(F.struct(cost.alias("cost"), F.col("frame").alias("frame"), d.alias("d"))).alias("m"))
    rank = F.row_number().over(Window.partitionBy(*keys, "event_id").orderBy("m.cost", "gid"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= max(1, top))
    item = F.struct("rank", F.struct(F.col("gid").cast("int").alias("global_id"), F.round(F.exp(-F.col("m.cost")), 4).alias("attribution_score"), F.col("m.frame").cast("int").alias("evidence_frame_proc"), F.round("m.d", 4).alias("normalized_ball_distance")).alias("c"))
    found = best.groupBy(*keys, "event_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda s: s["c"]).alias("actor_candidates"))
    out = events.select(*keys, "event_id").join(found, [*keys, "event_id"], "left")
    none = F.from_json(F.lit("[]"), f"array<{CANDIDATE}>")
    out = out.withColumn("actor_candidates", F.coalesce("actor_candidates", none))
    c = F.get("actor_candidates", F.lit(0))
    lead = c["attribution_score"] - F.coalesce(F.get("actor_candidates", F.lit(1))["attribution_score"], F.lit(0.0))
    near = c["normalized_ball_distance"] <= FAR
    sure = near & ((lead >= LEAD) | (c["normalized_ball_distance"] <= CLOSE))
    reason = F.when(c.isNull(), NOBODY).when(near, NEAREST).otherwise(TOO_FAR)
    return out.select(*keys, "event_id", F.when(near, c["global_id"]).alias("primary_global_id"), F.when(F.coalesce(sure, F.lit(False)), "auto").otherwise("review").alias("actor_status"), reason.alias("actor_reason"), "actor_candidates")


def _event(kind: str, number: Column, pattern: str, anchor: Column, duration: float, primary: Column, second: Column, label: Column, evidence: dict[str, Column], status: Column, reason: Column, candidates: Column) -> list[Column]:
    start, end = scalars.clip_window(anchor, *SHOW, F.lit(duration))
    pairs = [F.struct(F.lit(n).alias("key"), c.cast("double").alias("value")) for n, c in evidence.items()]
    return [
        F.format_string(pattern, number.cast("long")).alias("event_id"), start.alias("start_time"), end.alias("end_time"), primary.cast("int").alias("primary_global_id"), second.cast("int").alias("secondary_global_id"),
        label.cast("string").alias("event_type"), F.lit(kind).alias("source_kind"), F.lit(REVIEW).alias("machine_status"), status.alias("actor_status"), reason.alias("actor_reason"),
        candidates.cast(f"array<{CANDIDATE}>").alias("actor_candidates"), F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())).alias("evidence"),
    ]


def machine_events(actions: DataFrame, actors: DataFrame, transitions: DataFrame, passes: DataFrame, semantic: DataFrame, fps: float, duration: float, most: int) -> DataFrame:
    """All machine events as one table: (event_id, start_time, end_time, primary and secondary id, event_type, source_kind, machine_status, actor_status, actor_reason, actor_candidates, evidence map<string, double>).

    actions (event_id, frame, event_type, score): `most` of them at most, taken by turns from their types, the best first, with their attributed() actors. transitions (transition_id, end_frame, to_start_frame, from_gid,
    to_gid, displacement), passes (pass_id, the same and angle_deg) and semantic (event_id, frame, event_type, gid, other) are taken whole.
    """
    none = lambda t: F.lit(None).cast(t)
    empty = none(f"array<{CANDIDATE}>")
    chosen = seq.round_robin(actions, "event_type", [F.col("score").desc(), F.col("event_id")], most).join(actors, "event_id", "left")
    a = chosen.select(*_event("stage4_action_candidate", F.col("event_id"), "action_%03d", F.col("frame") / fps, duration, F.col("primary_global_id"), none("int"), F.col("event_type"), {"source_signal_score": F.col("score"), "source_event_frame_proc": F.col("frame")}, F.col("actor_status"), F.col("actor_reason"), F.col("actor_candidates")))
    moved = lambda kind, number, pattern, label, df, more: df.select(*_event(kind, F.col(number), pattern, F.col("end_frame") / fps, duration, F.col("from_gid"), F.col("to_gid"), F.lit(label), {"release_time_seconds": F.col("end_frame") / fps, "receive_time_seconds": F.col("to_start_frame") / fps, **more}, none("string"), none("string"), empty))
    t = moved("stable_possession_transition", "transition_id", "transition_%04d", "possession_transition", transitions, {"displacement_m": F.col("displacement")})
    p = moved("pass_network_candidate", "pass_id", "pass_%04d", "active_directed_pass_candidate", passes, {"distance_m": F.col("displacement"), "direction_angle_deg": F.col("angle_deg")})
    s = semantic.select(*_event("semantic_event_candidate", F.col("event_id"), "semantic_%04d", F.col("frame") / fps, duration, F.col("gid"), F.col("other"), F.col("event_type"), {"source_event_frame_proc": F.col("frame")}, none("string"), none("string"), empty))
    return reduce(DataFrame.unionByName, [a, t, p, s])


def envelope(events: DataFrame) -> DataFrame:
    """One row about a machine_events() table: schema_version, data_status, total_events and counts by source, 0 where there are none."""
    counts = [F.count_if(F.col("source_kind") == k) for k in SOURCES]
    pairs = F.map_from_arrays(F.array(*map(F.lit, SOURCES.values())), F.array(*counts))
    return events.agg(F.count("*").alias("total_events"), pairs.alias("counts")).select(F.lit(VERSION).alias("schema_version"), F.lit(LABELS).alias("data_status"), "total_events", "counts")


def annotated(ledger: DataFrame, detected: DataFrame, identities: DataFrame, tolerance: float, keys: list[str]) -> DataFrame:
    """A ledger of annotations (keys, event_id, anchor, start, end, tags; times as text) with the nearest detected event of its key within `tolerance` seconds, the earlier on ties.

    detected (keys, order, at, primary, candidates array<int>, score); of several at one time the first by `order` counts. identities (gid, player_id, number) are the confirmed ones.
    Gives start_time, end_time and anchor_time in seconds, the event's type by its tags, both ids (the second is the first other candidate), the confidence (a hundredth of the score, 0 without an event), the time between the two, and who
    it is. Rows whose anchor can't be read match nothing.
    """
    whole = F.struct("at", "primary", "candidates", "score")
    right = detected.groupBy(*keys, F.col("at").cast("double").alias("_t")).agg(F.min_by(whole, "order").alias("_found"))
    left = ledger.withColumn("_t", attributes.seconds(F.col("anchor")))
    # rows without an anchor stand apart, so that they don't meet in the windows
    told = seq.as_of(left.where("_t is not null"), right, keys, "_t", "_found", tolerance)
    t = told.drop("_found_at").unionByName(left.where("_t is null").withColumn("_found", F.lit(None).cast(dict(told.dtypes)["_found"])))
    t = t.join(identities.select(F.col("gid").alias("_gid"), "player_id", F.col("number").alias("jersey_number")), F.col("_found.primary") == F.col("_gid"), "left")
    other = F.get(F.filter("_found.candidates", lambda c: ~c.eqNullSafe(F.col("_found.primary"))), F.lit(0))
    met, known = F.col("_found").isNotNull(), F.col("_gid").isNotNull()
    r = lambda c: F.round(attributes.seconds(F.col(c)), 3)
    return t.select(
        *keys, "event_id", r("start").alias("start_time"), r("end").alias("end_time"), F.round("_t", 3).alias("anchor_time"), attributes.keyword_kind(F.col("tags")).alias("event_type"),
        F.col("_found.primary").alias("primary_global_id"), other.alias("secondary_global_id"), F.when(met, F.round(F.col("_found.score") / 100, 4)).otherwise(0.0).alias("confidence"),
        F.round(F.abs(F.col("_found.at") - F.col("_t")), 3).alias("delta"), F.when(met, PROVISIONAL).otherwise("unassigned").alias("actor_status"),
        F.when(known, "eligible_confirmed").otherwise("not_confirmed").alias("identity_status"), "player_id", "jersey_number",
    )
