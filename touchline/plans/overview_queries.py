"""Queries over match pages, many matches in one table, and small rules, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import geom, scalars, seq
from touchline.operators import events, identity, motion, overview, possession, reviews, running, tracklets, tracks

from .match_queries import MATCH
from .registry import query, rnd

# ---- many matches in one table ----

_IV = f"SELECT match, gid, min(frame) AS start_frame, max(frame) AS end_frame, min_by(bx, frame) AS sbx, min_by(bz, frame) AS sby, max_by(bx, frame) AS ebx, max_by(bz, frame) AS eby FROM (SELECT *, frame - row_number() OVER (PARTITION BY match, gid ORDER BY frame) AS run FROM (SELECT frame // {MATCH} AS match, frame % {MATCH} AS frame, gid, bx, bz FROM match)) GROUP BY match, gid, run HAVING count(*) >= 2"
_TR = f"SELECT *, sqrt((ebx - nx) * (ebx - nx) + (eby - ny) * (eby - ny)) AS d FROM (SELECT match, gid, end_frame, ebx, eby, lead(gid) OVER w AS to_gid, lead(start_frame) OVER w AS start, lead(sbx) OVER w AS nx, lead(sby) OVER w AS ny FROM ({_IV}) WINDOW w AS (PARTITION BY match ORDER BY start_frame)) WHERE gid <> to_gid AND start - end_frame - 1 BETWEEN 0 AND 15"
_KIND = f"SELECT t.*, coalesce(a.team, 'unassigned') AS from_team, coalesce(b.team, 'unassigned') AS to_team FROM ({_TR}) t LEFT JOIN teams a ON a.gid = t.gid LEFT JOIN teams b ON b.gid = t.to_gid"
KEYS = ("match",)


def _per_match(v, df):
    return df.withColumn("match", F.expr(f"frame div {MATCH}")).withColumn("frame", F.col("frame") % MATCH)


def _match_changes(v):
    near = possession.nearest_player(_per_match(v, v.dedup()), _per_match(v, v.ball()), 12.0, KEYS)
    tr = possession.transitions(possession.intervals(near, 2, KEYS), 15, keys=KEYS)
    teams = tr.select("match").distinct().crossJoin(F.broadcast(v.teams()))  # six ids
    return possession.classified(tr, teams, 2.0, KEYS)


@query(f"SELECT match, from_team AS team, count(*) AS passes, round(CAST(sum(CAST(d AS DECIMAL(38,9))) AS DOUBLE), 3) AS total_m, round(CAST(sum(CAST(d AS DECIMAL(38,9))) AS DOUBLE) / count(*), 3) AS mean_m FROM ({_KIND}) WHERE from_team = to_team AND from_team <> 'unassigned' AND d >= 2.0 GROUP BY ALL", "match", "teams")
def match_pass_summary(v):
    return possession.team_summary(_match_changes(v).where("kind = 'directed'"), KEYS)


@query(f"SELECT a.match, a.end_frame AS lost, a.from_team AS team, min(b.end_frame) AS regained FROM ({_KIND}) a JOIN ({_KIND}) b ON a.match = b.match AND b.to_team = a.from_team AND b.from_team <> b.to_team AND b.end_frame > a.end_frame AND b.end_frame <= a.end_frame + 1000 WHERE a.from_team <> a.to_team GROUP BY ALL", "match", "teams")
def match_counterpress(v):
    return events.counterpress(_match_changes(v).select("match", F.col("end_frame").alias("frame"), "from_team", "to_team"), 1000, KEYS)


@query(f"SELECT match, CAST(frame AS BIGINT) AS frame, max_by(gid, struct_pack(s := start_frame, e := end_frame, g := gid)) AS gid FROM (SELECT *, unnest(range(start_frame, end_frame + 1)) AS frame FROM ({_IV})) GROUP BY match, frame", "match")
def match_owners(v):
    near = possession.nearest_player(_per_match(v, v.dedup()), _per_match(v, v.ball()), 12.0, KEYS)
    return possession.owners(possession.intervals(near, 2, KEYS), KEYS).withColumn("frame", F.col("frame").cast("long"))


@query("SELECT match, gid, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS fast_frames, max(x) AS peak FROM (SELECT *, sum(b) OVER (PARTITION BY match, gid ORDER BY frame) AS k FROM (SELECT gid % 3 AS match, gid // 3 AS gid, frame, x, CASE WHEN frame - lag(frame) OVER (PARTITION BY gid ORDER BY frame) <= 3 THEN 0 ELSE 1 END AS b FROM ticks WHERE x > 55)) GROUP BY match, gid, k HAVING count(*) >= 2", "ticks")
def match_sprints(v):
    t = v.ticks().select((F.col("gid") % 3).alias("match"), F.expr("gid div 3").alias("gid"), "frame", F.col("x").alias("speed"))
    return running.bouts(t, 55.0, 2, 2, KEYS)


# ---- pages ----

_RUN = "SELECT gid, CAST(sum(CAST(x AS DECIMAL(38,6))) AS DOUBLE) AS distance, max(y) AS peak FROM (SELECT gid, x, y FROM dedup) GROUP BY gid"


def _running(v):
    return v.dedup().groupBy("gid").agg(F.sum(F.col("x").cast("decimal(38,6)")).cast("double").alias("distance"), F.max("y").alias("peak"))


def _numbers(v):
    k = F.col("p_partkey")
    status = F.when(k % 4 == 0, "Confirmed").when(k % 4 == 1, "conflict").when(k % 4 == 2, " ")
    return v.table("part").select(k.alias("gid"), status.alias("status"), F.when(k % 6 == 0, (k % 99).cast("string")).otherwise("").alias("number"))


_NUM = "SELECT p_partkey AS gid, CASE p_partkey % 4 WHEN 0 THEN 'Confirmed' WHEN 1 THEN 'conflict' WHEN 2 THEN ' ' END AS status, CASE WHEN p_partkey % 6 = 0 THEN CAST(p_partkey % 99 AS VARCHAR) ELSE '' END AS number FROM part"


@query(
    f"SELECT * FROM (WITH r AS ({_RUN}), n AS ({_NUM}) SELECT (SELECT count(*) FROM r) AS candidate_ids, (SELECT round(sum(distance), 1) FROM r) AS total_distance_m, (SELECT round(max(peak), 2) FROM r) AS peak_speed_mps, (SELECT count(*) FROM customer WHERE c_custkey % 40 = 0) AS confirmed_player_cards, (SELECT count(*) FROM ps) AS pass_candidates, (SELECT count(*) FROM iv) AS possession_intervals, (SELECT count(*) FROM n WHERE lower(coalesce(status, '')) LIKE '%confirm%' OR number <> '') AS confirmed_numbers, true AS has_replay, false AS has_highlights)",
    "dedup", "iv", "ps",
)
def match_overview(v):
    cards = v.table("customer").where("c_custkey % 40 = 0")
    t = overview.summary(_running(v), v.transitions().where("kind = 'directed'"), v.intervals(), _numbers(v), cards, {"replay": v.dedup(), "highlights": v.dedup().where("gid < 0")})
    return t.select("*", F.col("sections")["replay"].alias("has_replay"), F.col("sections")["highlights"].alias("has_highlights")).drop("sections")


@query(
    f"SELECT p.team, array_to_string(list_sort(ids), ';') AS player_ids, len(ids) AS player_count, round(distance, 1) AS distance_m, round(peak, 2) AS peak_speed_mps, passes, pass_distance_m, mean_pass_distance_m, round(coalesce(f, 0) / (SELECT sum(end_frame - start_frame + 1) FROM iv), 4) AS possession_share FROM (SELECT from_team AS team, count(*) AS passes, round(CAST(sum(CAST(displacement AS DECIMAL(38,9))) AS DOUBLE), 1) AS pass_distance_m, round(CAST(sum(CAST(displacement AS DECIMAL(38,9))) AS DOUBLE) / count(*), 2) AS mean_pass_distance_m FROM ps GROUP BY 1) p LEFT JOIN (SELECT team, list(gid) AS ids, sum(distance) AS distance, max(peak) AS peak FROM teams LEFT JOIN ({_RUN}) USING (gid) GROUP BY team) r USING (team) LEFT JOIN (SELECT team, sum(end_frame - start_frame + 1) AS f FROM iv JOIN teams USING (gid) GROUP BY team) h USING (team)",
    "dedup", "iv", "ps", "teams",
)
def team_pages(v):
    ps = v.transitions().where("kind = 'directed'").select(F.col("from_team").alias("team"), "displacement")
    t = overview.teams(v.teams(), _running(v), ps, v.intervals())
    return t.withColumn("player_ids", F.array_join(F.col("player_ids").cast("array<string>"), ";"))


@query(
    f"SELECT * FROM (WITH n AS ({_NUM}), s AS (SELECT coalesce(nullif(trim(status), ''), 'unknown') AS s, count(*) AS c FROM n GROUP BY 1) SELECT (SELECT count(*) FROM n) AS numbers, (SELECT string_agg(s || '=' || c, ';' ORDER BY s) FROM s) AS status_counts, (SELECT count(*) FROM labels) AS sample_size, (SELECT count(quality) FROM labels WHERE doc_id % 3 > 0) AS labelled, 'pending' AS review_status, (SELECT round(count(*) FILTER (quality = 1) / count(quality), 6) FROM labels WHERE doc_id % 3 > 0) AS agreement_rate, (SELECT count(*) FROM customer WHERE c_custkey % 4 > 0) AS people_confirmed, (SELECT count(*) FROM customer) AS people, 'partial' AS people_status, (SELECT count(*) FROM ball WHERE bx < 30) AS calibrated_frames, (SELECT round(count(*) FILTER (bx < 30) / count(*), 6) FROM ball) AS calibrated_share, (SELECT count(DISTINCT gid) FROM iv WHERE n > 2) AS ids_with_transitions, (SELECT count(*) FROM iv WHERE n > 2) AS detected_transitions)",
    "ball", "iv",
)
def quality_page(v):
    review = v.table("labels").select(F.lit(1).alias("machine"), F.when(F.col("doc_id") % 3 > 0, F.col("quality")).alias("human"))
    people = v.table("customer").select(F.when(F.col("c_custkey") % 4 > 0, "confirmed").otherwise("open").alias("status"))
    t = overview.quality(_numbers(v), review, people, v.ball().select((F.col("bx") < 30).alias("accepted")), v.intervals().where("n > 2"))
    return t.withColumn("status_counts", F.array_join(F.transform(F.sort_array(F.map_entries("status_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";"))


_TRIAL = f"SELECT CASE WHEN frame % 2 = 0 THEN 'base' ELSE 'other' END AS trial, frame, gid * 1000 + frame // CASE WHEN frame % 2 = 0 THEN 3000 ELSE 4000 END AS gid FROM dedup"
_TM = f"SELECT trial, count(DISTINCT frame) AS frames, count(DISTINCT frame) / 10.0 AS seconds, round(count(*) / count(DISTINCT frame), 4) AS mean_boxes_per_frame, count(DISTINCT gid) AS ids, round(count(DISTINCT gid) / (count(DISTINCT frame) / 10.0 / 60), 3) AS new_ids_per_minute FROM t GROUP BY trial"
_TL = "SELECT trial, quantile_cont(n, 0.5) AS median_length, count(*) FILTER (n < 10) AS short_tracks FROM (SELECT trial, gid, count(*) AS n FROM t GROUP BY ALL) GROUP BY trial"
_TRIALS = f"WITH t AS ({_TRIAL}) SELECT * FROM ({_TM}) JOIN ({_TL}) USING (trial)"


def _trials(v):
    even = F.col("frame") % 2 == 0
    gid = F.col("gid") * 1000 + F.when(even, F.expr("frame div 3000")).otherwise(F.expr("frame div 4000"))
    b = v.dedup().select(F.when(even, "base").otherwise("other").alias("trial"), "frame", gid.alias("gid"))
    return overview.trials(b, b.groupBy("trial").agg(F.count_distinct("frame").alias("n")), 10.0)


@query(f"SELECT * FROM ({_TRIALS})", "dedup")
def tracker_trials(v):
    return _trials(v)


@query(f"SELECT 'other' AS trial, CASE WHEN o.mean_boxes_per_frame >= b.mean_boxes_per_frame * 0.95 AND o.new_ids_per_minute <= b.new_ids_per_minute * 0.9 AND o.median_length >= b.median_length * 0.95 THEN 'candidate' ELSE 'baseline' END AS recommended FROM (SELECT * FROM ({_TRIALS})) o, (SELECT * FROM ({_TRIALS})) b WHERE o.trial = 'other' AND b.trial = 'base'", "dedup")
def trial_recommendation(v):
    return overview.recommended(_trials(v), "base")


@query(
    "SELECT coalesce(f.frame, b.frame) AS frame, coalesce(f.n, 0) AS players, f.first_id, f.first_team, f.first_number, f.boxes, f.pictures, round(b.bx, 3) AS ball_x, round(CASE WHEN i.frame IS NOT NULL THEN i.px END, 2) AS ball_px FROM (SELECT frame, count(*) AS n, min(gid) AS first_id, coalesce(min_by(coalesce(team, 'unassigned'), gid), 'unassigned') AS first_team, min_by(CASE WHEN gid % 2 = 0 THEN CAST(gid + 10 AS VARCHAR) ELSE '' END, gid) AS first_number, count(*) FILTER (conf > 0.03) AS boxes, count(*) FILTER (gid <> 3) AS pictures FROM dedup LEFT JOIN teams USING (gid) WHERE x < 40 GROUP BY frame) f FULL JOIN (SELECT * FROM ball WHERE frame % 3 > 0) b ON b.frame = f.frame FULL JOIN (SELECT frame, bx * 20 AS px FROM ball WHERE frame % 3 > 0) i ON i.frame = coalesce(f.frame, b.frame)",
    "dedup", "ball", "teams",
)
def replay_pages(v):
    g = F.col("gid")
    p = v.dedup().where("x < 40").select("frame", "gid", "x", "y", F.lit(1.0).alias("speed"), F.when(g != 3, F.col("x") * 20).alias("foot_x"), (F.col("y") * 20).alias("foot_y"))
    ids = v.spark.range(7).select(F.col("id").cast("int").alias("gid"))
    numbers = ids.select("gid", (g + 10).alias("number"), F.when(g % 2 == 0, "confirmed").otherwise("conflict").alias("status"))
    boxes = v.dedup().where("conf > 0.03").select("frame", "gid", "x", "y", F.lit(1.0).alias("w"), F.lit(2.0).alias("h"), F.col("conf").alias("confidence"))
    ball = v.ball().select("frame", "bx", F.col("bz").alias("by"), F.when(F.col("frame") % 3 > 0, "Observed").otherwise("interpolated").alias("source"))
    image = v.ball().where("frame % 3 > 0").select("frame", (F.col("bx") * 20).alias("px"), F.col("bz").alias("py"))
    t = overview.replay(p, v.teams(), numbers, boxes, ball, image)
    first = F.get("players", F.lit(0))
    count = lambda f: F.when(F.col("players").isNotNull(), F.size(F.filter("players", lambda q: q[f].isNotNull())))
    n = F.greatest(F.lit(0), F.coalesce(F.size("players"), F.lit(0)))
    return t.select("frame", n.alias("players"), first["id"].alias("first_id"), first["team_id"].alias("first_team"), first["number"].alias("first_number"), count("bbox").alias("boxes"), count("image").alias("pictures"), F.get("ball", F.lit(0)).alias("ball_x"), F.get("ball_image", F.lit(0)).alias("ball_px"))


_PASS = "SELECT 'pass' AS type, end_frame / 10.0 AS time_sec, to_start_frame / 10.0 AS end_time_sec, from_team AS team, from_gid AS from_id, to_gid AS to_id, round(displacement, 6) AS distance_m, kind AS classification, 'review' AS review FROM ck WHERE kind = 'directed'"
_TURN = "SELECT 'turnover', end_frame / 10.0, to_start_frame / 10.0, to_team, from_gid, to_gid, round(displacement, 6), kind, 'automatic' FROM ck WHERE kind = 'opponent'"
_KEYS = "SELECT 'key', frame / 10.0, NULL, NULL, CAST(frame % 7 AS INT), NULL, NULL, CASE WHEN frame % 3 = 0 THEN 'shot' ELSE 'cross' END, 'candidate' FROM ball WHERE bx > 44"
_SEM = "SELECT CASE frame % 4 WHEN 0 THEN 'goal' WHEN 1 THEN 'shield' WHEN 2 THEN 'counterpress' ELSE 'key' END, frame / 10.0, frame / 10.0 + 3, 'team_1', 1, NULL, 0.5, CASE frame % 4 WHEN 0 THEN 'goal_candidate' WHEN 1 THEN 'shielding_under_pressure' WHEN 2 THEN 'counterpress_recovery' ELSE 'other' END, 'candidate_review' FROM ball WHERE bx < 1"


@query(f"{_PASS} UNION ALL {_TURN} UNION ALL {_KEYS} UNION ALL {_SEM}", "ck", "ball")
def full_timeline(v):
    tr, b, k = v.transitions(), v.ball(), F.col("frame")
    actions = b.where("bx > 44").select("frame", F.when(k % 3 == 0, "shot").otherwise("cross").alias("event_type"), (k % 7).alias("gid"), F.lit(None).cast("string").alias("status"))
    kind = F.when(k % 4 == 0, "goal_candidate").when(k % 4 == 1, "shielding_under_pressure").when(k % 4 == 2, "counterpress_recovery").otherwise("other")
    semantic = b.where("bx < 1").select("frame", (k / 10.0 + 3).alias("end_time"), kind.alias("event_type"), F.lit("team_1").alias("team"), F.lit(1).alias("gid"), F.lit(None).cast("int").alias("other"), F.lit(0.5).alias("distance"))
    return overview.timeline(tr.where("kind = 'directed'"), tr, actions, semantic, 10.0).withColumn("distance_m", rnd("distance_m"))


@query(
    "SELECT CAST(frame AS BIGINT) AS frame, from_team AS team, from_gid, to_gid, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY n DESC, from_team, from_gid, to_gid) AS rank FROM (SELECT c.frame, from_team, from_gid, to_gid, count(*) AS n FROM (SELECT unnest(range(5000, 60001, 5000)) AS frame) c JOIN ck ON ck.end_frame <= c.frame GROUP BY ALL)) WHERE rank <= 10",
    "ck",
)
def network_so_far(v):
    return overview.network(v.transitions().select(F.col("from_team").alias("team"), "from_gid", "to_gid", F.col("end_frame").alias("frame")), 5000, 60000)


@query("SELECT count(*) AS records, count(DISTINCT gid) AS identities, CAST(max(frame) + 1 AS BIGINT) AS frames, count(DISTINCT frame) AS frames_with_detections, round(count(*) / (max(frame) + 1), 6) AS mean_detections, (SELECT max(c) FROM (SELECT count(*) AS c FROM det GROUP BY frame)) AS max_detections, (SELECT count(*) FROM (SELECT 1 FROM det GROUP BY gid, frame HAVING count(*) > 1)) AS duplicate_keys FROM det", "det")
def frame_totals(v):
    return overview.frame_totals(v.det())


_PUR = "SELECT gid, max(c) / sum(c) AS purity FROM (SELECT CAST(user_id AS INT) AS gid, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE -1 END AS label, count(*) AS c FROM events GROUP BY ALL) WHERE label >= 0 GROUP BY gid"


@query(f"SELECT count(*) AS partitions, round(min(purity), 8) AS least, count(*) FILTER (purity < 0.8) AS below, round(quantile_cont(purity, 0.5), 8) AS median FROM ({_PUR})")
def purity_page(v):
    label = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(-1)
    e = v.table("events").select(F.col("user_id").cast("int").alias("gid"), label.alias("label"))
    return overview.purity_report(overview.purities(e, ["gid"], "label"))


# ---- identities ----

_SEG = "SELECT gid, segment, (gid * 3 + segment * segment) % 3 AS mode FROM (SELECT DISTINCT gid, frame // 20 AS segment FROM ticks)"


@query(f"SELECT gid, CAST(mode AS INT) AS mode, CAST(CASE WHEN s = first THEN gid ELSE (SELECT max(gid) FROM ticks) + sum(CASE WHEN s > first THEN 1 ELSE 0 END) OVER (ORDER BY gid, s) END AS BIGINT) AS new_gid FROM (SELECT *, min(s) OVER (PARTITION BY gid) AS first FROM (SELECT gid, mode, min(segment) AS s FROM ({_SEG}) GROUP BY gid, mode))", "ticks")
def partitions_by_mode(v):
    s = v.ticks().select("gid", F.expr("frame div 20").alias("segment")).distinct()
    s = s.withColumn("mode", ((F.col("gid") * 3 + F.col("segment") * F.col("segment")) % 3).cast("int"))
    return identity.partition_ids(s).withColumn("new_gid", F.col("new_gid").cast("long"))


@query("SELECT o_orderkey, gid, CASE WHEN gid < 5 THEN gid + 100 END AS player_id, CASE WHEN gid < 5 THEN 'team_' || (gid % 2) END AS team, NOT coalesce(gid < 5 AND gid <> 2, false) AS identity_review_required FROM (SELECT o_orderkey, CAST(CASE WHEN o_custkey % 9 < 7 THEN o_custkey % 9 END AS INT) AS gid FROM orders)")
def remapped_events(v):
    k = F.col("o_custkey") % 9
    e = v.table("orders").select("o_orderkey", F.when(k < 7, k.cast("int")).alias("gid"))
    g = F.col("id").cast("int")
    a = v.spark.range(5).select(g.alias("gid"), (g + 100).alias("player_id"), F.concat(F.lit("team_"), (g % 2).cast("string")).alias("team"), (g != 2).alias("reviewed"))
    return tracks.remap_events(e, a).select("o_orderkey", "gid", "player_id", "team", "identity_review_required")


@query("SELECT count(*) FILTER (gid < 6) AS written, count(*) FILTER (gid >= 6) AS dropped FROM det", "det")
def remap_counts(v):
    return tracks.remap_counts(v.det(), v.teams().select("gid"))


@query("SELECT gid, count(*) AS n FROM det WHERE y < 22 AND gid IN (SELECT gid FROM det GROUP BY gid HAVING (count(*) < 3 OR count(*) FILTER (x > 30) >= 0.33 * count(*)) AND count(*) FILTER (y < 22) >= 0.5 * count(*)) GROUP BY gid", "det")
def field_votes(v):
    return tracks.field_votes(v.det(), "gid", F.col("x") > 30, F.col("y") < 22, 0.33, 0.5).groupBy("gid").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 THEN 'key-' || o_custkey WHEN o_custkey % 11 = 1 THEN 'roster:' || (o_custkey % 30) WHEN o_custkey % 11 < 8 THEN 'manual:team_1|' || (o_custkey % 30) || '|' || lower(trim(o_clerk)) WHEN o_custkey % 11 < 10 THEN 'linked:' || o_custkey || ',7' ELSE '' END AS person FROM (SELECT o_orderkey, o_custkey, ' Clerk ' || o_orderpriority AS o_clerk FROM (SELECT o_orderkey, o_custkey, o_orderstatus AS o_orderpriority FROM orders))")
def person_keys(v):
    k = F.col("o_custkey")
    m = k % 11
    name = F.when(m.between(2, 7), F.concat(F.lit(" Clerk "), F.col("o_orderstatus")))
    linked = F.when(m.between(8, 9), F.array(k, F.lit(7).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    key = scalars.person_key(F.when(m == 0, F.concat(F.lit(" key-"), k.cast("string"))), F.when(m == 1, k % 30), F.lit("Team_1 "), k % 30, name, linked)
    return v.table("orders").select("o_orderkey", key.alias("person"))


# ---- motion and calibration ----

_CAL = "SELECT gid, frame, frame - row_number() OVER (PARTITION BY gid ORDER BY frame) AS run FROM (SELECT gid, frame, any_value(x) AS x, any_value(y) AS y FROM det GROUP BY gid, frame HAVING count(*) = 1) WHERE x BETWEEN 2.0 AND 43.0 AND y BETWEEN 1.0 AND 24.0 AND frame IN (SELECT frame FROM ball WHERE bx < 40)"


@query(f"SELECT gid, count(*) AS rows FROM (SELECT *, count(*) OVER (PARTITION BY gid, run) AS n FROM ({_CAL})) WHERE n >= 3 GROUP BY gid", "det", "ball")
def calibrated_paths(v):
    t = motion.eligible(v.det(), (2.0, 43.0, 1.0, 24.0), 3, calibrated=v.ball().where("bx < 40"))
    return t.groupBy("gid").agg(F.count("*").alias("rows"))


@query("SELECT match, frame, round(x, 6) AS x, observed FROM (SELECT match, f AS frame, CASE WHEN f = frame THEN x ELSE x + (nx - x) * ((f - frame) / (t - frame)) END AS x, f = frame AS observed FROM (SELECT *, unnest(range(frame, CASE WHEN t - frame <= 6 THEN t ELSE frame + 1 END)) AS f FROM (SELECT *, lead(frame) OVER w AS t, lead(bx) OVER w AS nx FROM (SELECT frame // 20000 AS match, CAST(frame % 20000 AS BIGINT) AS frame, bx, bx AS x FROM ball WHERE frame % 5 <> 1) WINDOW w AS (PARTITION BY match ORDER BY frame))))", "ball")
def ball_backed(v):
    b = _per_match(v, v.ball().where("frame % 5 <> 1")).select("match", F.col("frame").cast("long").alias("frame"), F.col("bx").alias("x"))
    return seq.fill_within(b, ["match"], "frame", ["x"], 6).withColumn("x", rnd("x"))


_HK = "SELECT gid, frame, (1 + gid % 3) AS s, x FROM ticks WHERE frame % 5 = 0"


@query(f"SELECT gid, frame, round(CASE WHEN b IS NULL THEN fx WHEN f IS NULL OR f = b THEN bx ELSE bx + (fx - bx) * ((frame - b) / (f - b)) END, 6) AS h0 FROM (SELECT t.gid, t.frame, max(k.frame) FILTER (k.frame <= t.frame) AS b, max_by(k.x, k.frame) FILTER (k.frame <= t.frame) AS bx, min(k.frame) FILTER (k.frame >= t.frame) AS f, min_by(k.x, k.frame) FILTER (k.frame >= t.frame) AS fx FROM ticks t LEFT JOIN ({_HK}) k ON k.gid = t.gid GROUP BY ALL)", "ticks")
def unit_homographies(v):
    t = v.ticks()
    s = (F.lit(1.0) + F.col("gid") % 3) * (1 + F.col("frame") % 2)
    keys = t.where("frame % 5 = 0").select("gid", "frame", F.array(F.col("x") * s, *[F.lit(0.0)] * 7, s).alias("h"))
    return seq.between_keys(t.select("gid", "frame"), keys, ["gid"], "frame", "h", unit=8).select("gid", "frame", rnd(F.get("h", F.lit(0))).alias("h0"))


@query("SELECT a.frame AS shot, min(b.frame) AS frame FROM ball a JOIN ball b ON b.frame BETWEEN a.frame AND a.frame + 20 WHERE a.bx > 40 AND (b.bx <= 45 * 0.025 OR b.bx >= 45 - 45 * 0.025) AND b.bz BETWEEN 12.5 - 3.0 AND 12.5 + 3.0 GROUP BY 1", "ball")
def goal_candidates(v):
    b = v.ball()
    return events.first_in_zone(b.where("bx > 40").select(F.col("frame").alias("shot")), b, 20, events.goal_zone(F.col("bx"), F.col("bz"), 45.0, 25.0))


@query("SELECT frame, gid, round((1.1 * x + 0.2 * y + 3) / (0.001 * x + 0.002 * y + 1), 6) AS px, round((0.1 * x + 0.9 * y - 2) / (0.001 * x + 0.002 * y + 1), 6) AS py FROM det", "det")
def strict_projection(v):
    px, py = geom.project(F.col("x"), F.col("y"), [F.lit(c) for c in (1.1, 0.2, 3.0, 0.1, 0.9, -2.0, 0.001, 0.002, 1.0)], strict=True)
    return v.det().select("frame", "gid", rnd(px).alias("px"), rnd(py).alias("py"))


_PIX = "SELECT user_id AS k, CAST(event_id * 7 % 180 AS INT) AS h, CAST(event_id * CASE WHEN user_id % 3 = 0 THEN 1 ELSE 11 END % CASE WHEN user_id % 3 = 0 THEN 50 ELSE 256 END AS INT) AS s, CAST(120 + event_id % 100 AS INT) AS v FROM events"


@query(f"SELECT k, round(CASE WHEN w >= 0.55 THEN 0.0 WHEN c = 0 THEN hm ELSE CASE WHEN a < 0 THEN a + 360 ELSE a END / 2 END, 6) AS hue, CASE WHEN w >= 0.55 THEN sp WHEN c = 0 THEN sa ELSE sc END AS saturation, CASE WHEN w >= 0.55 THEN vp WHEN c = 0 THEN va ELSE vc END AS value FROM (SELECT k, count(*) FILTER (s < 45 AND v >= 100) / count(*) AS w, count(*) FILTER (s >= 45) AS c, quantile_cont(h, 0.5) AS hm, degrees(atan2(sum(sin(radians(h * 2.0)) * (s / 255.0)) FILTER (s >= 45), sum(cos(radians(h * 2.0)) * (s / 255.0)) FILTER (s >= 45))) AS a, quantile_cont(s, 0.5) FILTER (s < 55 AND v >= 80) AS sp, quantile_cont(v, 0.5) FILTER (s < 55 AND v >= 80) AS vp, quantile_cont(s, 0.5) AS sa, quantile_cont(v, 0.5) AS va, quantile_cont(s, 0.5) FILTER (s >= 45) AS sc, quantile_cont(v, 0.5) FILTER (s >= 45) AS vc FROM ({_PIX}) GROUP BY k)")
def jersey_colours(v):
    k, e = F.col("user_id"), F.col("event_id")
    s = F.when(k % 3 == 0, e % 50).otherwise(e * 11 % 256)
    p = v.table("events").select(k.alias("k"), (e * 7 % 180).cast("int").alias("h"), s.cast("int").alias("s"), (120 + e % 100).cast("int").alias("v"))
    return tracklets.representative_hsv(p, "k")


# ---- reviews and rules ----


@query("SELECT count(*) AS sample, count(l) AS labelled, count(*) FILTER (l) AS agreed, round(count(*) FILTER (l) / count(l), 6) AS rate, coalesce(count(l) = 20 AND count(*) FILTER (l) / count(l) >= 0.5, false) AS passed FROM (SELECT d.doc_id, CASE WHEN quality IS NOT NULL THEN quality = 1 END AS l FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 50 = 0) d LEFT JOIN labels USING (doc_id))")
def acceptance_labels(v):
    sample = v.table("documents").where("doc_id % 50 = 0").select("doc_id")
    return reviews.acceptance(sample, v.table("labels").select("doc_id", (F.col("quality") == 1).alias("label")), "doc_id", 20, 0.5)


@query(
    "SELECT event_id, strftime(ts, '%Y.%m.%d') AS day, CASE WHEN value * 2 <= 8.01 THEN 0.0 ELSE round((value * 2 - 8) / 2, 6) END AS cut_from, CASE WHEN value * 2 <= 8.01 THEN round(least(value * 2, 8), 6) ELSE 8.0 END AS length, CASE WHEN user_id % 3 = 0 THEN 'new_venue' ELSE 'Pitch_' || user_id END AS venue, CAST(CASE WHEN user_id % 7 = 0 THEN 1 ELSE greatest(1, CAST(round_even(0.25 * (user_id % 7) * 10, 0) AS INT)) END AS INT) AS stride, CASE WHEN event_type = 'click' THEN 'a=1;b=2' ELSE 'a=0;b=2;c=3' END AS merged, event_type || ';-;-' AS padded FROM events"
)
def document_rules(v):
    u, x = F.col("user_id"), F.col("value") * 2
    offset, length = scalars.trimmed(x)
    place = F.when(u % 3 == 0, " ..").otherwise(F.concat(F.lit(' Pitch:?*'), u.cast("string"), F.lit(". ")))
    given = F.when(F.col("event_type") == "click", F.create_map(F.lit("a"), F.lit(1))).otherwise(F.create_map(F.lit("c"), F.lit(3)))
    full = scalars.merged(given, F.create_map(F.lit("a"), F.lit(0), F.lit("b"), F.lit(2)))
    shown = F.array_join(F.transform(F.sort_array(F.map_entries(full)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return v.table("events").select(
        "event_id", scalars.short_date(F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).alias("day"), rnd(offset).alias("cut_from"), rnd(length).alias("length"), scalars.venue(place).alias("venue"),
        scalars.reid_stride(0.25, (u % 7) * 10.0).alias("stride"), shown.alias("merged"), F.array_join(scalars.padded(F.array("event_type"), 3, F.lit("-")), ";").alias("padded"),
    )
