"""The engine's own queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import geom, seq
from touchline.operators import candidates, events, identity, possession, running, tracks, views
from touchline.streaming import windows

from . import attribute_queries, match_queries, overview_queries, player_queries  # noqa: F401  register their queries
from .registry import ORACLES, QUERIES, query, rnd  # noqa: F401


# ---- tracks ----


@query("SELECT frame, gid, conf, x, y FROM dedup", "dedup")
def mot_dedup_best_conf(v):
    return v.dedup()


@query("SELECT frame, gid, count(*) AS n FROM det GROUP BY ALL HAVING count(*) > 1", "det")
def mot_uniqueness_violations(v):
    return tracks.violations(v.det(), ["frame", "gid"])


@query(
    "SELECT gid, CAST(sum(c) AS BIGINT) AS records, count(*) AS frames, min(frame) AS first_frame, max(frame) AS last_frame, round(count(*) / (max(frame) - min(frame) + 1), 6) AS coverage, count(*) FILTER (gap > 0) AS gap_count, CAST(coalesce(max(gap), 0) AS BIGINT) AS max_gap, count(*) FILTER (c > 1) AS collisions FROM (SELECT *, frame - lag(frame) OVER (PARTITION BY gid ORDER BY frame) - 1 AS gap FROM (SELECT gid, frame, count(*) AS c FROM det GROUP BY ALL)) GROUP BY gid",
    "det",
)
def mot_preflight(v):
    return tracks.preflight(v.det())


@query("SELECT frame, gid, round(x + (1 + conf * 10) / 2, 6) AS foot_x, round(y + 2 * (1 + conf * 10), 6) AS foot_y FROM det", "det")
def footpoint_projection(v):
    w = 1 + F.col("conf") * 10
    fx, fy = geom.footpoint(F.col("x"), F.col("y"), w, 2 * w)
    return v.det().select("frame", "gid", rnd(fx).alias("foot_x"), rnd(fy).alias("foot_y"))


@query("SELECT frame, gid, round((1.1 * x + 0.2 * y + 3) / (0.001 * x + 0.002 * y + 1), 6) AS px, round((0.1 * x + 0.9 * y - 2) / (0.001 * x + 0.002 * y + 1), 6) AS py FROM det", "det")
def homography_projection(v):
    px, py = geom.project(F.col("x"), F.col("y"), [F.lit(c) for c in (1.1, 0.2, 3.0, 0.1, 0.9, -2.0, 0.001, 0.002, 1.0)])
    return v.det().select("frame", "gid", rnd(px).alias("px"), rnd(py).alias("py"))


@query("SELECT gid, count(*) AS inside FROM det WHERE x BETWEEN 4.5 AND 40.5 AND y BETWEEN 1.5 AND 20.5 GROUP BY gid", "det")
def bounds_filter(v):
    return v.det().where(geom.inside(F.col("x"), F.col("y"), (5.0, 40.0, 2.0, 20.0), 0.5)).groupBy("gid").agg(F.count("*").alias("inside"))


@query("SELECT gid, count(*) AS inside FROM det WHERE x > 10.05 AND y > 5.05 AND x < 30.05 AND y < 18.05 GROUP BY gid", "det")
def polygon_filter(v):
    return v.det().where(geom.in_polygon(F.col("x"), F.col("y"), [(10.05, 5.05), (30.05, 5.05), (30.05, 18.05), (10.05, 18.05)])).groupBy("gid").agg(F.count("*").alias("inside"))


@query("SELECT gid, count(*) AS n, count(*) FILTER (y > 5) AS supported FROM det GROUP BY gid HAVING count(*) < 3 OR count(*) FILTER (y > 5) >= 0.25 * count(*)", "det")
def field_vote(v):
    return tracks.vote(v.det(), "gid", F.col("y") > 5, 0.25)


@query("SELECT frame, gid % 3 AS person, x, y, conf FROM dedup WHERE gid < 6", "dedup")
def id_remap(v):
    m = v.teams().select("gid", (F.col("gid") % 3).alias("person"))
    return tracks.remap(v.dedup(), F.broadcast(m)).select("frame", "person", "x", "y", "conf")


@query("SELECT DISTINCT gid FROM det WHERE gid NOT IN (SELECT gid FROM teams)", "det", "teams")
def anti_missing_team(v):
    return tracks.unmapped(v.det(), F.broadcast(v.teams()))


@query("SELECT gid, count(DISTINCT frame) AS visible, round(count(DISTINCT frame) / (SELECT count(DISTINCT frame) FROM det), 6) AS ratio FROM det GROUP BY gid", "det")
def presence_filter(v):
    d = v.det().select("gid", "frame").distinct()
    n = d.select("frame").distinct().agg(F.count("*").alias("t"))
    return d.groupBy("gid").agg(F.count("*").alias("visible")).crossJoin(n).select("gid", "visible", rnd(F.col("visible") / F.col("t")).alias("ratio"))  # n is one row


@query("SELECT round(avg(c), 6) AS mean_boxes, CAST(max(c) AS BIGINT) AS max_boxes, count(*) AS frames FROM (SELECT frame, count(*) AS c FROM det GROUP BY frame)", "det")
def trial_metrics(v):
    per = v.det().groupBy("frame").agg(F.count("*").alias("c"))
    return per.agg(rnd(F.avg("c")).alias("mean_boxes"), F.max("c").alias("max_boxes"), F.count("*").alias("frames"))


# ---- possession ----


@query("SELECT frame, gid, round(d, 6) AS d, bx, bz FROM match", "match")
def nearest_player_match(v):
    return v.match().select("frame", "gid", rnd("d").alias("d"), "bx", "bz")


@query("SELECT gid, start_frame, end_frame, confirmed_frame, n, round(min_d, 6) AS min_d, round(max_d, 6) AS max_d, sbx, sby, ebx, eby FROM iv", "iv")
def possession_intervals(v):
    return v.intervals().select("gid", "start_frame", "end_frame", "confirmed_frame", "n", rnd("min_d").alias("min_d"), rnd("max_d").alias("max_d"), "sbx", "sby", "ebx", "eby")


@query("SELECT from_gid, to_gid, end_frame, to_start_frame, confirmed_frame, gap, from_team, to_team, kind, round(displacement, 6) AS displacement FROM ck", "ck")
def possession_transitions(v):
    return v.transitions().select("from_gid", "to_gid", "end_frame", "to_start_frame", "confirmed_frame", "gap", "from_team", "to_team", "kind", rnd("displacement").alias("displacement"))


@query("SELECT from_gid, to_gid, end_frame, from_team AS team, round(displacement, 6) AS displacement, round(degrees(atan2(sby - eby, sbx - ebx)), 6) AS angle_deg, round(displacement / (greatest(1, to_start_frame - end_frame) / 10.0), 6) AS speed FROM ps", "ps")
def pass_events(v):
    p = possession.passes(v.transitions(), 10.0)
    return p.select("from_gid", "to_gid", "end_frame", F.col("from_team").alias("team"), rnd("displacement").alias("displacement"), rnd("angle_deg").alias("angle_deg"), rnd("speed").alias("speed"))


@query("SELECT from_gid, to_gid, end_frame, round(displacement, 6) AS displacement FROM ck WHERE from_team = to_team AND from_team <> 'unassigned' AND displacement >= 1.0 AND displacement < 6.0", "ck")
def pass_grey_zone(v):
    return possession.grey_zone(v.transitions(), 1.0, 6.0).select("from_gid", "to_gid", "end_frame", rnd("displacement").alias("displacement"))


@query("SELECT from_team AS team, count(*) AS passes, round(CAST(sum(CAST(displacement AS DECIMAL(38,9))) AS DOUBLE), 3) AS total_m, round(CAST(sum(CAST(displacement AS DECIMAL(38,9))) AS DOUBLE) / count(*), 3) AS mean_m FROM ps GROUP BY 1", "ps")
def team_pass_summary(v):
    return possession.team_summary(possession.passes(v.transitions(), 10.0))


@query("SELECT from_team AS team, from_gid, to_gid, count(*) AS n FROM ps GROUP BY ALL", "ps")
def pass_matrix_long(v):
    return possession.matrix(possession.passes(v.transitions(), 10.0))


@query("SELECT a.team, a.gid AS from_gid, b.gid AS to_gid, count(p.kind) AS n FROM (SELECT DISTINCT from_team AS team, unnest([from_gid, to_gid]) AS gid FROM ps) a JOIN (SELECT DISTINCT from_team AS team, unnest([from_gid, to_gid]) AS gid FROM ps) b USING (team) LEFT JOIN ps p ON p.from_team = team AND p.from_gid = a.gid AND p.to_gid = b.gid GROUP BY ALL", "ps")
def pass_matrix_dense(v):
    return possession.dense_matrix(possession.passes(v.transitions(), 10.0))


@query("SELECT from_gid, to_gid, end_frame FROM (SELECT *, row_number() OVER (ORDER BY end_frame) - 1 AS k, count(*) OVER () AS n FROM ps) WHERE n <= 20 OR k IN (SELECT CAST(floor((range + 0.5) * (SELECT count(*) FROM ps) / 20) AS BIGINT) FROM range(20))", "ps")
def acceptance_sample20(v):
    return possession.systematic_sample(possession.passes(v.transitions(), 10.0), ["end_frame"]).select("from_gid", "to_gid", "end_frame")


@query("SELECT count(*) AS labelled, count(*) FILTER (quality = 1) AS agreed, round(count(*) FILTER (quality = 1) / count(*), 6) AS rate, count(*) >= 20 AND count(*) FILTER (quality = 1) >= 0.8 * count(*) AS passed FROM labels")
def acceptance_eval(v):
    n, a = F.count("*"), F.count_if(F.col("quality") == 1)
    return v.table("labels").agg(n.alias("labelled"), a.alias("agreed"), rnd(a / n).alias("rate"), ((n >= 20) & (a >= 0.8 * n)).alias("passed"))


@query("SELECT kind, count(*) AS n FROM ck GROUP BY kind", "ck")
def quality_status_counts(v):
    return v.transitions().groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT team, CAST(sum(n) AS BIGINT) AS total, round(sum(n) / sum(sum(n)) OVER (), 4) AS share FROM (SELECT coalesce(team, 'unassigned') AS team, n FROM iv LEFT JOIN teams USING (gid)) GROUP BY team", "iv", "teams")
def possession_share(v):
    t = v.intervals().join(F.broadcast(v.teams()), "gid", "left").fillna("unassigned", ["team"])
    return views.shares(t, "team", "n")


@query("SELECT from_team, to_team, count(*) AS n FROM ck GROUP BY ROLLUP (from_team, to_team)", "ck")
def rollup_team_player(v):
    return v.transitions().rollup("from_team", "to_team").agg(F.count("*").alias("n"))


# ---- running ----

SMOOTH = "SELECT gid, frame, run, list_sort(list_resize([]::DOUBLE[], greatest(0, 6 - k), near[1]) || near || list_resize([]::DOUBLE[], greatest(0, k + 5 - n), near[-1]))[6] AS xs, list_sort(list_resize([]::DOUBLE[], greatest(0, 6 - k), neary[1]) || neary || list_resize([]::DOUBLE[], greatest(0, k + 5 - n), neary[-1]))[6] AS ys FROM (SELECT *, list(x) OVER (PARTITION BY gid, run ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near, list(y) OVER (PARTITION BY gid, run ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS neary, row_number() OVER (PARTITION BY gid, run ORDER BY frame) AS k, count(*) OVER (PARTITION BY gid, run) AS n FROM tickrun) WHERE n >= 11"
SERIES = f"SELECT *, sqrt((xs - lag(xs) OVER w) * (xs - lag(xs) OVER w) + (ys - lag(ys) OVER w) * (ys - lag(ys) OVER w)) AS step, dense_rank() OVER (PARTITION BY gid ORDER BY run) AS segment FROM ({SMOOTH}) WINDOW w AS (PARTITION BY gid, run ORDER BY frame)"


@query(f"SELECT gid, frame, round(xs, 6) AS x_smooth, round(ys, 6) AS y_smooth, round(step, 6) AS step, CAST(segment AS INT) AS segment FROM ({SERIES})", "tickrun")
def running_timeseries(v):
    t = running.timeseries(v.ticks(), 10.0)
    return t.select("gid", "frame", rnd("x_smooth").alias("x_smooth"), rnd("y_smooth").alias("y_smooth"), rnd("step").alias("step"), "segment")


@query(f"SELECT gid, count(*) AS frames, CAST(max(segment) AS BIGINT) AS segments, count(step) AS steps, round(CAST(sum(CAST(step AS DECIMAL(38,9))) AS DOUBLE), 3) AS distance_m, round(coalesce(CAST(sum(CAST(step AS DECIMAL(38,9))) FILTER (step * 10.0 > 4.5) AS DOUBLE), 0), 3) AS high_speed_m, round(quantile_cont(step * 10.0, 0.95), 3) AS p95_speed, round(max(step * 10.0), 3) AS max_speed FROM ({SERIES}) GROUP BY gid", "tickrun")
def running_summary(v):
    return running.summary(running.timeseries(v.ticks(), 10.0))


@query("SELECT gid, count(*) AS samples, round(coalesce(CAST(sum(CAST(CASE WHEN g <= 2 THEN sqrt(dx * dx + dy * dy) END AS DECIMAL(38,9))) AS DOUBLE), 0), 3) AS distance FROM (SELECT gid, frame - lag(frame) OVER w AS g, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM ticks WINDOW w AS (PARTITION BY gid ORDER BY frame)) GROUP BY gid", "ticks")
def naive_motion(v):
    return running.naive_motion(v.ticks())


@query("SELECT gid, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS fast_frames, max(x) AS peak FROM (SELECT *, sum(b) OVER (PARTITION BY gid ORDER BY frame) AS bout FROM (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY gid ORDER BY frame) <= 2 THEN 0 ELSE 1 END AS b FROM ticks WHERE x > 50)) GROUP BY gid, bout HAVING count(*) >= 3", "ticks")
def sprint_bouts(v):
    return running.bouts(v.ticks().withColumnRenamed("x", "speed"), 50.0, 1, 3)


@query("SELECT gid, round(max((v[2] + v[3]) / 2), 6) AS peak FROM (SELECT gid, list_sort(list(x) OVER (PARTITION BY gid ORDER BY frame ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) AS v FROM ticks) WHERE len(v) = 4 GROUP BY gid", "ticks")
def rolling_peak_speed(v):
    return running.rolling_peak(v.ticks().withColumnRenamed("x", "speed"), 4)


@query("SELECT gid, pos AS frame, CASE WHEN pos = frame THEN x ELSE round(x + (nx - x) * ((pos - frame) / (nf - frame)), 6) END AS x, CASE WHEN pos = frame THEN 'observed' ELSE 'interpolated' END AS source FROM (SELECT *, unnest(range(frame, CASE WHEN nf - frame - 1 <= 3 THEN nf ELSE frame + 1 END)) AS pos FROM (SELECT gid, frame, x, lead(frame) OVER w AS nf, lead(x) OVER w AS nx FROM ticks WINDOW w AS (PARTITION BY gid ORDER BY frame)))", "ticks")
def ball_interp_bounded(v):
    t = seq.fill_gaps(v.ticks(), ["gid"], "frame", ["x"], 3)
    return t.select("gid", F.col("frame").cast("int").alias("frame"), F.when(F.col("source") == "observed", F.col("x")).otherwise(rnd("x")).alias("x"), "source")


@query("SELECT gid, start_frame, end_frame, n, CAST(coalesce(sum(end_frame - start_frame + 1) OVER (PARTITION BY gid ORDER BY start_frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM (SELECT gid, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY gid ORDER BY frame) AS part FROM (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY gid ORDER BY frame) <= 5 THEN 0 ELSE 1 END AS b FROM ticks)) GROUP BY gid, part)", "ticks")
def visibility_intervals(v):
    return events.visible(v.ticks(), 5)


# ---- events ----


@query("SELECT lost, team, min(frame) AS regained FROM (SELECT a.end_frame AS lost, a.from_team AS team, b.end_frame AS frame FROM ck a JOIN ck b ON b.to_team = a.from_team AND b.from_team <> b.to_team AND b.end_frame > a.end_frame AND b.end_frame <= a.end_frame + 200 WHERE a.from_team <> a.to_team) GROUP BY lost, team", "ck")
def counterpress(v):
    return events.counterpress(v.transitions().select(F.col("end_frame").alias("frame"), "from_team", "to_team"), 200)


OWNED = "SELECT start_frame AS pid, gid, frame, x, y FROM (SELECT gid, start_frame, unnest(range(start_frame, end_frame + 1)) AS frame FROM iv) JOIN dedup USING (gid, frame)"


@query(f"SELECT pid, gid, count(*) AS pressed, min(struct_pack(d := m.d, f := frame, o := m.opp)).f AS frame, min(struct_pack(d := m.d, f := frame, o := m.opp)).o AS opponent, round(min(m.d), 6) AS distance FROM (SELECT pid, gid, frame, min(struct_pack(d := d, opp := opp)) AS m FROM (SELECT o.pid, o.gid, o.frame, sqrt((o.x - p.x) * (o.x - p.x) + (o.y - p.y) * (o.y - p.y)) AS d, p.gid AS opp FROM ({OWNED}) o JOIN dedup p ON p.frame = o.frame AND p.gid <> o.gid LEFT JOIN teams a ON a.gid = o.gid LEFT JOIN teams b ON b.gid = p.gid WHERE a.team IS DISTINCT FROM b.team) GROUP BY ALL) WHERE m.d <= 15 GROUP BY pid, gid HAVING count(*) >= 2", "iv", "teams")
def shielding(v):
    owned = v.intervals().select("gid", F.col("start_frame").alias("pid"), F.explode(F.sequence("start_frame", "end_frame")).alias("frame"))
    p = v.dedup().select("frame", "gid", "x", "y")
    return events.shielding(owned.join(p, ["gid", "frame"]), p, F.broadcast(v.teams()), 15.0, 2)


@query("SELECT a.frame AS shot, min(b.frame) AS frame FROM ball a JOIN ball b ON b.frame BETWEEN a.frame AND a.frame + 20 WHERE a.bx > 44 AND b.bx < 2 AND b.bz BETWEEN 5 AND 20 GROUP BY 1", "ball")
def goal_zone(v):
    b = v.ball()
    return events.first_in_zone(b.where("bx > 44").select(F.col("frame").alias("shot")), b, 20, (F.col("bx") < 2) & F.col("bz").between(5, 20))


@query("SELECT event_id, rank, gid, frame, round(cost, 6) AS cost FROM (SELECT *, CAST(row_number() OVER (PARTITION BY event_id ORDER BY cost, gid) AS INT) AS rank FROM (SELECT event_id, gid, m.cost AS cost, m.frame AS frame FROM (SELECT e.event_id, p.gid, min(struct_pack(cost := sqrt((p.x - b.bx) * (p.x - b.bx) + (p.y - b.bz) * (p.y - b.bz)) + abs(b.frame - e.frame) * 0.18 / 5.0, frame := b.frame)) AS m FROM (SELECT frame AS event_id, frame FROM ball WHERE bx > 44.5) e JOIN ball b ON b.frame BETWEEN e.frame - 5 AND e.frame + 1 JOIN dedup p ON p.frame = b.frame GROUP BY ALL))) WHERE rank <= 3", "dedup", "ball")
def actor_topk(v):
    e = v.ball().where("bx > 44.5").select(F.col("frame").alias("event_id"), "frame")
    return events.actors(e, v.ball(), v.dedup().select("frame", "gid", "x", "y"), 5, 1)


@query("SELECT 'transition' AS kind, end_frame AS frame, from_gid AS gid, to_gid, NULL::DOUBLE AS value FROM ck UNION ALL SELECT 'interval', start_frame, gid, NULL, CAST(n AS DOUBLE) FROM iv", "ck")
def event_union(v):
    a = v.transitions().select(F.lit("transition").alias("kind"), F.col("end_frame").alias("frame"), F.col("from_gid").alias("gid"), "to_gid")
    b = v.intervals().select(F.lit("interval").alias("kind"), F.col("start_frame").alias("frame"), "gid", F.col("n").cast("double").alias("value"))
    return views.timeline(a, b)


@query("SELECT event_id, event_type, user_id FROM events ORDER BY ts, event_id LIMIT 100")
def timeline_topn(v):
    return views.leaders(v.table("events"), [F.col("ts"), F.col("event_id")], 100).select("event_id", "event_type", "user_id")


@query("SELECT event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events) ORDER BY k, event_type LIMIT 40")
def stratified_round_robin(v):
    return seq.round_robin(v.table("events"), "event_type", [F.col("value").desc(), F.col("event_id")], 40).select("event_id", "event_type", "value")


@query("SELECT event_type, event_id, z, smooth FROM (SELECT event_type, event_id, round(smooth, 6) AS smooth, CASE WHEN var <= 1e-12 THEN 0 ELSE round((smooth - mean) / sqrt(greatest(var, 1e-12)), 5) END AS z FROM (SELECT event_type, event_id, smooth, s / n AS mean, q / n - (s / n) * (s / n) AS var FROM (SELECT event_type, event_id, smooth FROM s) JOIN (SELECT event_type, count(*) AS n, CAST(sum(CAST(smooth AS DECIMAL(28,9))) AS DOUBLE) AS s, CAST(sum(CAST(smooth * smooth AS DECIMAL(28,9))) AS DOUBLE) AS q FROM s GROUP BY event_type) USING (event_type)))".replace("FROM s)", "FROM (SELECT event_type, event_id, round(CAST(sum(CAST(value AS DECIMAL(28,9))) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS DOUBLE) / 5, 9) AS smooth FROM events))").replace("FROM s GROUP", "FROM (SELECT event_type, round(CAST(sum(CAST(value AS DECIMAL(28,9))) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS DOUBLE) / 5, 9) AS smooth FROM events) GROUP"))
def zscore_signal(v):
    t = events.signal_z(v.table("events").select("event_type", "event_id", "value"), "event_type", ["event_id"], "value")
    return t.select("event_type", "event_id", "z", rnd("smooth").alias("smooth"))


NMS = "SELECT gid, list_reduce(list([struct_pack(s := -x, frame := frame)] ORDER BY -x, frame), lambda acc, e: CASE WHEN len(list_filter(acc, lambda k: abs(k.frame - e[1].frame) < 5)) > 0 THEN acc ELSE acc || e END) AS k FROM ticks WHERE x > 50 GROUP BY gid"


@query(f"SELECT gid, k.frame AS frame, -k.s AS x FROM (SELECT gid, unnest(k) AS k FROM ({NMS}))", "ticks")
def nms_peaks(v):
    return candidates.suppressed(v.ticks().where("x > 50"), ["gid"], "frame", "x", 5)


# ---- identity ----


@query("SELECT gid, m.mode AS mode, m.c AS support, purity FROM (SELECT gid, max(struct_pack(c := c, f := -f, mode := mode)) AS m, round(max(c) / sum(c), 6) AS purity FROM (SELECT CAST(user_id AS INT) AS gid, event_type AS mode, count(*) AS c, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY gid)")
def partition_purity(v):
    e = v.table("events").select(F.col("user_id").cast("int").alias("gid"), F.col("event_type").alias("mode"), "event_id")
    return identity.majority(e, "gid", "mode", "event_id")


CENTRES = [(0, [0.1] * 64), (1, [-0.1] * 64), (2, [0.1, -0.1] * 32)]
_D = ", ".join(f"struct_pack(d := sqrt(list_reduce(list_prepend(0.0, list_transform(list_zip(embedding, [{', '.join(map(str, c))}]), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2]))), lambda s, e: s + e)), mode := {m})" for m, c in CENTRES)


@query(f"SELECT vec_id, CASE WHEN d[1].d > 1.1 OR d[2].d - d[1].d < 0.02 THEN -1 ELSE d[1].mode END AS mode, round((d[2].d - d[1].d) / d[2].d, 6) AS confidence FROM (SELECT vec_id, list_sort([{_D}]) AS d FROM embeddings)")
def openset_assign(v):
    t = v.table("embeddings").select("vec_id", "embedding")
    return identity.nearest_centre(t, CENTRES, "embedding", 1.1, 0.02).select("vec_id", "mode", "confidence")


MODES = "SELECT gid, frame, CASE WHEN x > 60 THEN 1 WHEN x < 40 THEN 0 ELSE -1 END AS mode FROM ticks"


def _modes(v):
    return v.ticks().select("gid", "frame", F.when(F.col("x") > 60, 1).when(F.col("x") < 40, 0).otherwise(-1).alias("mode"))


_CUTS = f"""SELECT gid, frame AS cut_frame, before AS before_mode, after AS after_mode FROM (SELECT *, lag(after) OVER (PARTITION BY gid ORDER BY frame) AS l FROM (SELECT gid, frame, mode,
 CASE WHEN b0 + b1 >= 2 AND greatest(b0, b1) >= 0.6 * (b0 + b1) THEN CASE WHEN b0 >= b1 THEN 0 ELSE 1 END END AS before, CASE WHEN a0 + a1 >= 2 AND greatest(a0, a1) >= 0.6 * (a0 + a1) THEN CASE WHEN a0 >= a1 THEN 0 ELSE 1 END END AS after FROM (
 SELECT gid, frame, mode, count(*) FILTER (mode = 0) OVER b AS b0, count(*) FILTER (mode = 1) OVER b AS b1, count(*) FILTER (mode = 0) OVER a AS a0, count(*) FILTER (mode = 1) OVER a AS a1 FROM ({MODES})
 WINDOW b AS (PARTITION BY gid ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY gid ORDER BY frame ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))) WHERE before <> after AND mode = after) WHERE l IS NULL OR l <> after"""


@query(_CUTS, "ticks")
def mode_transitions(v):
    return identity.switches(_modes(v), "gid", "frame", "mode", 4, 2, 0.6)


@query(f"SELECT t.gid, t.frame, count(c.cut_frame) AS segment FROM ticks t LEFT JOIN ({_CUTS}) c ON c.gid = t.gid AND c.cut_frame <= t.frame GROUP BY ALL", "ticks")
def segment_split_ids(v):
    m = _modes(v)
    return identity.segments(m.select("gid", "frame"), identity.switches(m, "gid", "frame", "mode", 4, 2, 0.6), "gid", "frame")


@query("SELECT a.gid % 2 AS side, a.gid AS a, b.gid AS b, count(*) AS frames FROM dedup a JOIN dedup b ON a.frame = b.frame AND a.gid < b.gid AND a.gid % 2 = b.gid % 2 GROUP BY ALL HAVING count(*) >= 3", "dedup")
def overlap_conflicts(v):
    return identity.overlaps(v.dedup().withColumn("side", F.col("gid") % 2), "side", 3)


@query("SELECT a.frame, a.gid, round(coalesce(max(CASE WHEN a.gid <> b.gid THEN greatest(0, least(a.x + 3.0, b.x + 3.0) - greatest(a.x, b.x)) * greatest(0, least(a.y + 6.0, b.y + 6.0) - greatest(a.y, b.y)) / (3.0 * 6.0) END), 0), 6) AS overlap FROM dedup a JOIN dedup b USING (frame) GROUP BY ALL", "dedup")
def torso_overlap_max(v):
    return identity.neighbour_overlap(v.dedup().select("frame", "gid", "x", "y", F.lit(3.0).alias("w"), F.lit(6.0).alias("h")))


@query("SELECT person, round(CAST(sum(CAST(distance AS DECIMAL(38,9))) AS DOUBLE), 3) AS distance, max(peak) AS peak, round(CAST(sum(CAST(score * greatest(1.0, seconds) AS DECIMAL(38,9))) AS DOUBLE) / CAST(sum(CAST(greatest(1.0, seconds) AS DECIMAL(38,9))) AS DOUBLE), 4) AS score, array_to_string(list_sort(list(DISTINCT gid)), ';') AS gids FROM (SELECT CAST(c_custkey AS INT) AS gid, CASE WHEN c_custkey % 5 = 0 THEN 'row:' || c_custkey ELSE c_mktsegment || c_nationkey END AS person, c_acctbal AS distance, c_acctbal / 100 AS peak, CAST(c_custkey % 97 AS DOUBLE) AS score, CAST(c_custkey % 31 AS DOUBLE) AS seconds FROM customer) GROUP BY person")
def person_merge(v):
    c = v.table("customer")
    t = c.select(F.col("c_custkey").cast("int").alias("gid"), F.when(F.col("c_custkey") % 5 != 0, F.concat("c_mktsegment", F.col("c_nationkey").cast("string"))).alias("person"), F.col("c_acctbal").alias("distance"), (F.col("c_acctbal") / 100).alias("peak"), (F.col("c_custkey") % 97).cast("double").alias("score"), (F.col("c_custkey") % 31).cast("double").alias("seconds"))
    return identity.merged_people(t, "person")


# ---- views ----


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5")
def leaders_top5(v):
    return views.leaders(v.table("supplier").select("s_suppkey", "s_acctbal"), [F.col("s_acctbal").desc(), F.col("s_suppkey")])


@query("SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS INT) AS rank, count(*) OVER () AS of FROM supplier")
def player_rank(v):
    return views.ranked(v.table("supplier"), "s_acctbal", "s_suppkey").select("s_suppkey", "rank", "of")


@query("SELECT frame, CAST(len(p) AS INT) AS players, p[1].gid AS first_gid, bx, bz FROM (SELECT frame, list_sort(list(struct_pack(gid := gid, x := x, y := y))) AS p FROM dedup GROUP BY frame) LEFT JOIN ball USING (frame)", "dedup", "ball")
def replay_frames(v):
    r = views.replay(v.dedup(), v.ball())
    return r.select("frame", F.size("players").alias("players"), F.get("players", F.lit(0))["gid"].alias("first_gid"), "bx", "bz")


@query("SELECT gid, min(frame) AS frame FROM (SELECT *, floor((frame - min(frame) OVER (PARTITION BY gid)) / 7) AS s FROM ticks) GROUP BY gid, s", "ticks")
def replay_sampling(v):
    return views.first_in_step(v.ticks().select("gid", "frame"), "gid", "frame", 7)


@query("SELECT CAST(least(floor((x - 0.0) / ((45.0 - 0.0) / 30)), 29) AS INT) AS cx, CAST(least(floor((y - 0.0) / ((25.0 - 0.0) / 16)), 15) AS INT) AS cy, count(*) AS n FROM dedup WHERE x BETWEEN 0 AND 45 AND y BETWEEN 0 AND 25 GROUP BY ALL", "dedup")
def heatmap_hist2d(v):
    return views.histogram2d(v.dedup(), "x", "y", (0.0, 45.0, 0.0, 25.0), 30, 16)


@query("SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '#00000001') OR contains(CAST(s_suppkey AS VARCHAR), '#00000001')")
def free_text_filter(v):
    return views.search(v.table("supplier").select("s_suppkey", "s_name"), "#00000001")


@query("SELECT event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE), 4) AS total, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def event_type_counts(v):
    return v.table("events").groupBy("event_type").agg(F.count("*").alias("n"), rnd(F.sum(F.col("value").cast("decimal(28,6)")).cast("double"), 4).alias("total"), rnd(F.percentile("value", F.lit(0.95))).alias("p95"))


@query("SELECT event_type, CAST(user_id % 4 AS INT) AS team, count(*) AS n FROM events GROUP BY CUBE (event_type, user_id % 4)")
def cube_event_type(v):
    return v.table("events").withColumn("team", (F.col("user_id") % 4).cast("int")).cube("event_type", "team").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(v):
    t = windows.tumbling(v.table("events"))
    return t.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOURS AS \"end\", count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s")
def session_windows(v):
    t = windows.sessions(v.table("events"))
    return t.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT gid, frame, CASE WHEN f IS NULL OR frame - b <= f - frame THEN b ELSE f END AS frame_at FROM (SELECT gid, frame, max(k) FILTER (k <= frame) AS b, min(k) FILTER (k >= frame) AS f FROM ticks LEFT JOIN (SELECT gid, frame AS k FROM ticks WHERE x > 80) USING (gid) GROUP BY gid, frame) WHERE b IS NOT NULL OR f IS NOT NULL", "ticks")
def homography_as_of(v):
    t = v.ticks()
    keys = t.where("x > 80").select("gid", "frame", F.col("x").alias("key"))
    return seq.as_of(t.select("gid", "frame"), keys, ["gid"], "frame", "key").where("key_at is not null").select("gid", "frame", F.col("key_at").alias("frame_at"))
