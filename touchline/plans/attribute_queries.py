"""Queries over attributes: names, verdicts, clusters, summaries, interpolated calibrations, id sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import attributes, seq
from touchline.operators import clusters, identity, possession

from .registry import query, rnd


@query("SELECT gid, count(*) FILTER (c > 1) AS collisions, min(frame) FILTER (c > 1) AS first_collision, max(frame) FILTER (c > 1) AS last_collision, coalesce(array_to_string(list_sort(list(frame) FILTER (c > 1)), ';'), '') AS collision_frames, coalesce(max(gap), 0) AS max_gap FROM (SELECT *, frame - lag(frame) OVER (PARTITION BY gid ORDER BY frame) AS gap FROM (SELECT gid, frame, count(*) AS c FROM det GROUP BY ALL)) GROUP BY gid", "det")
def identity_quality(v):
    return identity.quality(v.det()).withColumn("collision_frames", F.array_join(F.col("collision_frames").cast("array<string>"), ";"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, value DESC, event_id) AS k FROM events) ORDER BY k, user_id LIMIT 50")
def focus_round_robin(v):
    priority = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return seq.round_robin(v.table("events"), "user_id", [priority, F.col("value").desc(), F.col("event_id")], 50).select("event_id", "user_id", "event_type")


_MODES = [(0, [0.05] * 64), (1, [-0.05] * 64)]
_DIST = ", ".join(f"sqrt(list_reduce(list_prepend(0.0, list_transform(list_zip(embedding, [{', '.join(map(str, c))}]), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2]))), lambda s, e: s + e)) AS d{m}" for m, c in _MODES)


@query(f"SELECT vec_id, CASE WHEN d0 <= d1 THEN 0 ELSE 1 END AS mode, round((greatest(d0, d1) - least(d0, d1)) / greatest(d0, d1), 6) AS confidence FROM (SELECT vec_id, {_DIST} FROM embeddings)")
def nearest_center(v):
    return identity.nearest_centre(v.table("embeddings").select("vec_id", "embedding"), _MODES, "embedding").select("vec_id", "mode", "confidence")


@query(
    """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL),
 s AS (SELECT label, count(*) AS n, sum(list_sum(list_transform(v, lambda x: x * x))) AS q FROM e GROUP BY label),
 c AS (SELECT label, list(t ORDER BY pos) AS t FROM (SELECT label, pos, sum(x) AS t FROM (SELECT label, unnest(range(64)) AS pos, unnest(v) AS x FROM e) GROUP BY ALL) GROUP BY label),
 d AS (SELECT e.vec_id, e.label AS own, s.label AS other, s.n AS n, s.n * list_sum(list_transform(v, lambda x: x * x)) + s.q - 2 * list_sum(list_transform(list_zip(v, c.t), lambda z: z[1] * z[2])) AS tot FROM e CROSS JOIN s JOIN c ON c.label = s.label),
 r AS (SELECT vec_id, max(CASE WHEN own = other THEN tot / greatest(n - 1, 1) END) AS a, min(CASE WHEN own <> other THEN tot / n END) AS b FROM d GROUP BY vec_id)
 SELECT coalesce(round(avg((b - a) / greatest(a, b, 1e-9)), 4), -1.0) AS silhouette, count(*) AS n FROM r"""
)
def silhouette(v):
    return clusters.silhouette(v.table("embeddings"), "embedding", "label", 64)


@query(None)
def kmeans_modes(v):
    return clusters.modes(v.table("embeddings"), "embedding", 3).select("mode", "n", "share")


@query("SELECT c_nationkey, CAST(m.g AS INT) AS canonical, gids FROM (SELECT c_nationkey, max(struct_pack(c := c_acctbal, n := -c_custkey, g := c_custkey)) AS m, array_to_string(list_sort(list(DISTINCT CAST(c_custkey AS INT))), ';') AS gids FROM customer GROUP BY c_nationkey)")
def canonical_id(v):
    c = v.table("customer").withColumn("gid", F.col("c_custkey").cast("int"))
    return clusters.canonical(c, "c_nationkey", "gid", "c_acctbal")


@query("SELECT (SELECT count(*) FROM iv) AS intervals, (SELECT count(*) FROM ck) AS transitions, (SELECT count(*) FROM ps) AS passes, (SELECT round(CAST(sum(CAST(displacement AS DECIMAL(38,9))) AS DOUBLE), 1) FROM ps) AS pass_m, (SELECT CAST(max(n) AS BIGINT) FROM iv) AS longest", "iv", "ps")
def match_summary(v):
    i = v.intervals().agg(F.count("*").alias("intervals"), F.max("n").alias("longest"))
    directed = F.when(F.col("kind") == "directed", F.col("displacement").cast("decimal(38,9)"))
    t = v.transitions().agg(F.count("*").alias("transitions"), F.count_if(F.col("kind") == "directed").alias("passes"), rnd(F.sum(directed).cast("double"), 1).alias("pass_m"))
    return i.crossJoin(t).select("intervals", "transitions", "passes", "pass_m", "longest")  # one row each


@query("SELECT team, count(DISTINCT gid) AS ids, CAST(sum(n) AS BIGINT) AS frames, round(sum(n) / sum(sum(n)) OVER (), 4) AS share, coalesce(max(p), 0) AS passes FROM (SELECT coalesce(team, 'unassigned') AS team, gid, n FROM iv LEFT JOIN teams USING (gid)) LEFT JOIN (SELECT from_team AS team, count(*) AS p FROM ps GROUP BY 1) USING (team) GROUP BY team", "iv", "teams", "ps")
def team_overview(v):
    return possession.team_overview(v.intervals(), F.broadcast(v.teams()), possession.passes(v.transitions(), 10.0))


@query(
    "SELECT event_type, CASE WHEN s < 0.0015 AND p < 0.0025 AND m < 0.2 AND s * 10 < 0.08 AND s * 100 < 1.8 THEN 'fixed' WHEN st >= 0.6 AND (m >= 0.2 OR p >= 0.0025) THEN 'pan_rotate' ELSE 'handheld_translate' END AS camera FROM (SELECT event_type, quantile_cont(value / 100000, 0.5) AS s, quantile_cont(value / 100000, 0.75) AS p, avg(CAST(value / 100000 >= 0.0015 AS INT)) AS m, avg(CAST(value < 300 AS INT)) AS st FROM events GROUP BY event_type)"
)
def camera_motion_class(v):
    shift = F.col("value") / 100000
    t = v.table("events").groupBy("event_type").agg(
        F.percentile(shift, F.lit(0.5)).alias("s"), F.percentile(shift, F.lit(0.75)).alias("p"),
        F.avg((shift >= 0.0015).cast("int")).alias("m"), F.avg((F.col("value") < 300).cast("int")).alias("st"),
    )
    s = F.col("s")
    return t.select("event_type", attributes.camera_class(s, F.col("p"), F.col("m"), s * 10, s * 100, F.col("st")).alias("camera"))


@query("SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN r >= 2 AND g < 0.15 THEN 'conflict' WHEN v >= 5 AND c >= 0.2 AND h >= 0.55 AND g >= 0.1 AND b THEN 'confirmed' ELSE 'unreadable' END AS verdict FROM (SELECT o_orderkey % 12 AS v, o_custkey % 4 AS r, (o_orderkey % 50) / 100.0::DOUBLE AS g, (o_custkey % 60) / 100.0::DOUBLE AS c, (o_custkey % 100) / 100.0::DOUBLE AS h, o_orderkey % 3 > 0 AS b FROM orders)) GROUP BY verdict")
def number_verdicts(v):
    e = lambda s: F.expr(s)
    t = v.table("orders").select(attributes.number_verdict(e("o_orderkey % 12"), e("o_custkey % 4"), e("o_orderkey % 50") / 100.0, e("o_custkey % 60") / 100.0, e("o_custkey % 100") / 100.0, e("o_orderkey % 3 > 0")).alias("verdict"))
    return t.groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT name, count(*) AS n FROM (SELECT CASE WHEN v < 55 THEN 'black' WHEN s < 45 AND v >= 145 THEN 'white' WHEN s < 45 THEN 'gray' WHEN h < 10 THEN 'red' WHEN h < 24 THEN 'orange' WHEN h < 42 THEN 'yellow' WHEN h < 88 THEN 'green' WHEN h < 135 THEN 'blue' WHEN h < 165 THEN 'purple' ELSE 'red' END AS name FROM (SELECT o_orderkey * 7 % 180 AS h, o_custkey % 256 AS s, o_orderkey * 3 % 256 AS v FROM orders)) GROUP BY name")
def colour_names(v):
    n = attributes.colour_name(F.expr("o_orderkey * 7 % 180"), F.expr("o_custkey % 256"), F.expr("o_orderkey * 3 % 256"))
    return v.table("orders").select(n.alias("name")).groupBy("name").agg(F.count("*").alias("n"))


_WORD = "CASE o_orderkey % 5 WHEN 0 THEN '前场射门' WHEN 1 THEN '后场解围' WHEN 2 THEN '快速转移' WHEN 3 THEN '中场拦截' ELSE 'x' END"


@query(f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN contains(t, '射门') THEN 'shot' WHEN contains(t, '解围') THEN 'clearance' WHEN contains(t, '转移') THEN 'pass_or_distribution' WHEN contains(t, '拦截') THEN 'possession_loss_or_tackle' ELSE 'key_action' END AS kind FROM (SELECT {_WORD} AS t FROM orders)) GROUP BY kind")
def action_kinds(v):
    return v.table("orders").select(attributes.keyword_kind(F.expr(_WORD)).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, round(CASE o_orderkey % 4 WHEN 0 THEN (o_custkey % 5) * 3600 + (o_custkey % 60) * 60 + 7.5 WHEN 1 THEN (o_custkey % 90) * 60 + 30 WHEN 2 THEN 0.25 * 86400 ELSE NULL END, 6) AS seconds FROM orders")
def time_parsing(v):
    s = F.expr("CASE o_orderkey % 4 WHEN 0 THEN concat(o_custkey % 5, ':', o_custkey % 60, ':7.5') WHEN 1 THEN concat(' ', o_custkey % 90, ':30') WHEN 2 THEN '0.25' ELSE 'late' END")
    return v.table("orders").select("o_orderkey", rnd(attributes.seconds(s)).alias("seconds"))


@query(
    "SELECT * FROM (WITH k AS (SELECT gid, frame AS kf, x, y FROM ticks WHERE x > 80), r AS (SELECT t.gid, t.frame, max(kf) FILTER (kf <= t.frame) AS b, min(kf) FILTER (kf >= t.frame) AS f FROM ticks t JOIN k USING (gid) GROUP BY ALL) SELECT r.gid, r.frame, round(CASE WHEN b IS NULL THEN q.x WHEN f IS NULL OR f = b THEN p.x ELSE p.x + (q.x - p.x) * ((r.frame - b) / (f - b)) END, 6) AS hx, round(CASE WHEN b IS NULL THEN q.y WHEN f IS NULL OR f = b THEN p.y ELSE p.y + (q.y - p.y) * ((r.frame - b) / (f - b)) END, 6) AS hy FROM r LEFT JOIN k p ON p.gid = r.gid AND p.kf = b LEFT JOIN k q ON q.gid = r.gid AND q.kf = f)",
    "ticks",
)
def homography_keyframe_interp(v):
    t = v.ticks()
    keys = t.where("x > 80").select("gid", "frame", F.array("x", "y").alias("h"))
    out = seq.between_keys(t.select("gid", "frame"), keys, ["gid"], "frame", "h").where("h is not null")
    return out.select("gid", "frame", rnd(F.get("h", F.lit(0))).alias("hx"), rnd(F.get("h", F.lit(1))).alias("hy"))


@query("SELECT gid, count(*) AS frames FROM (SELECT gid, unnest(range(frame, CASE WHEN nf - frame <= 3 THEN nf ELSE frame + 1 END)) AS pos FROM (SELECT gid, frame, lead(frame) OVER (PARTITION BY gid ORDER BY frame) AS nf FROM ticks)) GROUP BY gid", "ticks")
def ball_interp_actor(v):
    return seq.fill_gaps(v.ticks(), ["gid"], "frame", ["x"], 2).groupBy("gid").agg(F.count("*").alias("frames"))  # frames at most 3 apart


@query("SELECT gid, bucket, m.x AS x, -m.f AS frame FROM (SELECT gid, CAST(least(floor((frame - lo) * 6 / (hi - lo + 1)), 5) AS INT) AS bucket, max(struct_pack(x := x, f := -frame)) AS m FROM (SELECT *, min(frame) OVER (PARTITION BY gid) AS lo, max(frame) OVER (PARTITION BY gid) AS hi FROM ticks) GROUP BY ALL)", "ticks")
def bucket_best(v):
    return clusters.bucket_best(v.ticks().select("gid", "frame", "x"), "gid", "frame", 6, ["x"])


@query("(SELECT DISTINCT CAST(l_suppkey AS INT) AS id, 'both' AS side FROM lineitem WHERE l_suppkey IN (SELECT c_custkey FROM customer)) UNION ALL (SELECT DISTINCT CAST(s_suppkey AS INT), 'idle' FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49))")
def id_sets(v):
    a, s = v.table("lineitem"), v.table("supplier").select(F.col("s_suppkey").cast("int").alias("id"))
    seen = a.select(F.col("l_suppkey").cast("int").alias("id"))
    both = seen.intersect(v.table("customer").select(F.col("c_custkey").cast("int").alias("id")))
    idle = s.subtract(a.where("l_quantity > 49").select(F.col("l_suppkey").cast("int").alias("id")))
    return both.withColumn("side", F.lit("both")).unionByName(idle.withColumn("side", F.lit("idle")))
