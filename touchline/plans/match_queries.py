"""Queries over action candidates, lasting changes, fields, compilations, event tables and packages, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import seq, tables
from touchline.operators import candidates, clusters, events, field, identity, reviews, timeline, transitions
from touchline.sources import track_files

from .registry import query, rnd

# ---- action candidates ----

#: Frames of one match, taken from the orders' keys.
MATCH = 20_000
_GRAD = "CASE WHEN lag({0}) OVER w IS NULL AND lead({0}) OVER w IS NULL THEN 0 WHEN lag({0}) OVER w IS NULL THEN lead({0}) OVER w - {0} WHEN lead({0}) OVER w IS NULL THEN {0} - lag({0}) OVER w ELSE (lead({0}) OVER w - lag({0}) OVER w) / 2 END"
_W = "WINDOW w AS (PARTITION BY match ORDER BY frame)"
_FIVE = "WINDOW w AS (PARTITION BY match ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
_POINTS = f"SELECT *, count(*) OVER (PARTITION BY match) AS c, lead(frame) OVER w AS t, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lag(frame) OVER w AS f0 FROM (SELECT frame // {MATCH} AS match, CAST(frame % {MATCH} AS BIGINT) AS frame, bx AS x, bz AS y FROM ball) {_W}"
_DENSE = f"SELECT match, a AS frame, CASE WHEN a > frame AND t IS NOT NULL THEN x + (nx - x) * ((a - frame) / (t - frame)) ELSE x END AS x, CASE WHEN a > frame AND t IS NOT NULL THEN y + (ny - y) * ((a - frame) / (t - frame)) ELSE y END AS y, a = frame OR (a > frame AND t IS NOT NULL AND t - frame <= 8) AS reliable FROM (SELECT *, unnest(range(CASE WHEN f0 IS NULL THEN 0 ELSE frame END, coalesce(t, {MATCH}))) AS a FROM ({_POINTS}) WHERE c > 1)"
_SMOOTH = f"SELECT match, frame, reliable, sum(x) OVER w / 5 AS x, sum(y) OVER w / 5 AS y FROM ({_DENSE}) {_FIVE}"
_SPEED = f"SELECT match, frame, reliable, vx, vy, sqrt(vx * vx + vy * vy) AS v FROM (SELECT match, frame, reliable, ({_GRAD.format('x')}) * 10 AS vx, ({_GRAD.format('y')}) * 10 AS vy FROM ({_SMOOTH}) {_W})"
_BALL = f"SELECT match, frame, reliable, sqrt(ax * ax + ay * ay) AS acc, CASE WHEN lv > 1 AND v > 1 THEN degrees(acos(greatest(-1.0, least(1.0, (lx * vx + ly * vy) / (lv * v))))) ELSE 0 END AS turn, v FROM (SELECT *, {_GRAD.format('vx')} AS ax, {_GRAD.format('vy')} AS ay, lag(vx) OVER w AS lx, lag(vy) OVER w AS ly, lag(v) OVER w AS lv FROM ({_SPEED}) {_W})"
_STEPS = f"SELECT frame // {MATCH} AS match, CAST(frame % {MATCH} AS BIGINT) AS frame, sqrt((x - lag(x) OVER p) * (x - lag(x) OVER p) + (y - lag(y) OVER p) * (y - lag(y) OVER p)) / (frame - lag(frame) OVER p) * 10 AS s, frame - lag(frame) OVER p AS gap FROM dedup WINDOW p AS (PARTITION BY frame // {MATCH}, gid ORDER BY frame)"
_FAST = f"SELECT match, frame, sum(CAST(s AS DECIMAL(28,9))) / 5.0 AS fast FROM (SELECT match, unnest(range(frame - 2, frame + 3)) AS frame, s FROM (SELECT match, frame, max(s) AS s FROM ({_STEPS}) WHERE gap BETWEEN 1 AND 3 GROUP BY ALL)) WHERE frame BETWEEN 0 AND {MATCH - 1} GROUP BY ALL"
_SIGNALS = f"SELECT f.match, f.frame, reliable, coalesce(acc, 0) AS acc, coalesce(turn, 0) AS turn, coalesce(turn * v, 0) AS push, coalesce(CAST(fast AS DOUBLE), 0) AS fast FROM (SELECT match, unnest(range(0, {MATCH})) AS frame FROM (SELECT frame // {MATCH} AS match FROM ball UNION SELECT frame // {MATCH} FROM dedup)) f LEFT JOIN b ON b.match = f.match AND b.frame = f.frame LEFT JOIN ({_FAST}) p ON p.match = f.match AND p.frame = f.frame"
_Z = "CASE WHEN stddev_pop({0}) OVER m > 1e-6 THEN ({0} - avg({0}) OVER m) / stddev_pop({0}) OVER m ELSE 0 END"
_ACTIONS = f"""SELECT CAST(match AS INT) AS match, row_number() OVER (PARTITION BY match ORDER BY k.frame) AS event_id, k.frame AS frame, k.kind AS event_type, round(-k.s, 3) AS score FROM (
  SELECT match, unnest(list_reduce(list([struct_pack(s := -score, frame := frame, kind := kind)] ORDER BY -score, frame), lambda acc, e: CASE WHEN len(list_filter(acc, lambda k: abs(k.frame - e[1].frame) < 50)) > 0 THEN acc ELSE acc || e END)) AS k
  FROM (SELECT *, quantile_cont(score, 0.95) OVER (PARTITION BY match) AS lim FROM (
    SELECT match, frame, score, CASE WHEN reliable AND acc > kick THEN '{candidates.KICK}' WHEN reliable AND turn > 90 THEN '{candidates.TURN}' ELSE '{candidates.OTHER}' END AS kind
    FROM (SELECT *, {_Z.format('acc')} + {_Z.format('push')} + 0.5 * {_Z.format('fast')} AS score, quantile_cont(acc, 0.95) FILTER (reliable) OVER m AS kick FROM x WINDOW m AS (PARTITION BY match))
    WHERE coalesce(reliable, true) AND frame BETWEEN 100 AND {MATCH - 101}))
  WHERE score >= lim GROUP BY match)"""


def _with(name: str, view: str, rest: str) -> str:
    return f"SELECT * FROM (WITH {name} AS MATERIALIZED ({view}) {rest})"


@query(_with("b", _BALL, f", x AS MATERIALIZED ({_SIGNALS}) {_ACTIONS}"), "ball", "dedup")
def action_candidates(v):
    at = lambda d: d.withColumn("match", F.expr(f"frame div {MATCH}").cast("int")).withColumn("frame", (F.col("frame") % MATCH).cast("long"))
    ball = at(v.ball().select("frame", F.col("bx").alias("x"), F.col("bz").alias("y")))
    return candidates.action_candidates(ball, at(v.dedup()), ["match"], MATCH, 10.0, longest=8, margin=100, apart=25)


@query("SELECT k.frame AS frame, -k.s AS price FROM (SELECT unnest(list_reduce(list([struct_pack(s := -price, frame := frame)] ORDER BY -price, frame), lambda acc, e: CASE WHEN len(list_filter(acc, lambda k: abs(k.frame - e[1].frame) < 400)) > 0 THEN acc ELSE acc || e END)) AS k FROM (SELECT o_orderkey AS frame, o_totalprice AS price FROM orders WHERE o_totalprice > 150000))")
def nms_single_key(v):
    t = v.table("orders").select(F.col("o_orderkey").alias("frame"), F.col("o_totalprice").alias("price")).where("price > 150000")
    return candidates.suppressed(t, [], "frame", "price", 400)


@query("SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.5), 6) AS p50 FROM events GROUP BY event_type")
def key_percentiles(v):
    e = v.table("events")
    a, b = (seq.percentile(e, ["event_type"], "value", p, n) for p, n in ((0.95, "p95"), (0.5, "p50")))
    return a.join(b, "event_type").select("event_type", rnd("p95").alias("p95"), rnd("p50").alias("p50"))


# ---- lasting changes ----

_OBS = "SELECT gid, frame, CASE WHEN x > 60 THEN 2 WHEN x > 50 THEN 1 WHEN x < 40 THEN 0 END AS mode, y / 50 AS confidence FROM ticks"
_SEEN = "SELECT * FROM obs WHERE mode IS NOT NULL AND confidence >= 0.2"
_SIDE = "SELECT m, c, n FROM (SELECT mode AS m, count(*) AS c, sum(count(*)) OVER () AS n, min(k) AS f FROM ({}) GROUP BY mode) ORDER BY c DESC, f LIMIT 1"


def _side(pick: str) -> str:
    """Majority of the four nearest rows of evidence on one side."""
    return f"SELECT gid, frame, list(struct_pack(f := sf, m := mode) ORDER BY sf) AS s FROM (SELECT o.gid, o.frame, t.frame AS sf, t.mode, row_number() OVER (PARTITION BY o.gid, o.frame ORDER BY {pick}"


_LEFT = _side("t.frame DESC) AS k FROM obs o JOIN seen t ON t.gid = o.gid AND t.frame >= o.frame - 12 AND t.frame < o.frame) WHERE k <= 4 GROUP BY ALL")
_RIGHT = _side("t.frame) AS k FROM obs o JOIN seen t ON t.gid = o.gid AND t.frame >= o.frame AND t.frame <= o.frame + 12) WHERE k <= 4 GROUP BY ALL")
_BEST = "list_sort(list_transform(list_distinct(list_transform({0}, lambda r: r.m)), lambda m: struct_pack(n := -len(list_filter({0}, lambda r: r.m = m)), at := list_position(list_transform({0}, lambda r: r.m), m), m := m)))[1]"
_CHANGES = f"SELECT l.gid, l.frame AS pos, lb.m AS b, ra.m AS a, list_filter(r.s, lambda q: q.m = ra.m)[1].f AS f, -lb.n / len(l.s) AS bp, -ra.n / len(r.s) AS ap, len(l.s) AS be, len(r.s) AS ae FROM (SELECT *, {_BEST.format('s')} AS lb FROM lhs) l JOIN (SELECT *, {_BEST.format('s')} AS ra FROM rhs) r ON r.gid = l.gid AND r.frame = l.frame JOIN (SELECT gid, count(*) AS n FROM seen GROUP BY gid) k ON k.gid = l.gid WHERE k.n >= 6 AND len(l.s) >= 3 AND len(r.s) >= 3 AND lb.m <> ra.m AND -lb.n >= 0.75 * len(l.s) AND -ra.n >= 0.75 * len(r.s)"
_TAKEN = "SELECT gid, list_reduce(list([struct_pack(f := f, b := b, a := a, bp := bp, ap := ap, be := be, ae := ae)] ORDER BY pos), lambda acc, e: CASE WHEN e[1].f - acc[-1].f < 4 OR (e[1].b = acc[-1].b AND e[1].a = acc[-1].a) THEN acc ELSE acc || e END) AS c FROM ch GROUP BY gid"
# a pair that undoes itself leaves an empty mark, so that what follows isn't compared with what stood before it
_PAIRED = "SELECT gid, list_reduce(list_transform(c, lambda x: [x]), lambda acc, e: CASE WHEN e[1].f - acc[-1].f <= 8 AND e[1].b = acc[-1].a AND e[1].a = acc[-1].b THEN acc[1:len(acc) - 1] || [struct_pack(f := NULL::INT, b := NULL::INT, a := NULL::INT, bp := NULL::DOUBLE, ap := NULL::DOUBLE, be := NULL::BIGINT, ae := NULL::BIGINT)] ELSE acc || e END) AS c FROM tk"


@query(
    f"SELECT * FROM (WITH obs AS ({_OBS}), seen AS ({_SEEN}), lhs AS ({_LEFT}), rhs AS ({_RIGHT}), ch AS ({_CHANGES}), tk AS ({_TAKEN}) "
    f"SELECT gid, x.f AS cut_frame, x.b AS before_mode, x.a AS after_mode, round(x.bp, 6) AS before_purity, round(x.ap, 6) AS after_purity, x.be AS before_evidence, x.ae AS after_evidence FROM (SELECT gid, unnest(c) AS x FROM ({_PAIRED})) WHERE x.f IS NOT NULL)",
    "ticks",
)
def persistent_transitions(v):
    mode = F.when(F.col("x") > 60, 2).when(F.col("x") > 50, 1).when(F.col("x") < 40, 0)
    t = v.ticks().select("gid", "frame", mode.alias("mode"), (F.col("y") / 50).alias("confidence"))
    out = transitions.persistent(t, ["gid"], window=4, least=3, purity=0.75, trust=0.2, span=12, cooldown=4, horizon=8)
    return out.withColumn("before_purity", rnd("before_purity")).withColumn("after_purity", rnd("after_purity"))


# ---- fields and calibration ----

_KF = "SELECT o_orderkey AS frame, CASE WHEN o_custkey % 4 = 0 THEN [struct_pack(x := 1.0 + a, y := 1.0), struct_pack(x := 44.0, y := 0.5 + b), struct_pack(x := 43.0 - a, y := 24.0), struct_pack(x := 20.0, y := 26.0), struct_pack(x := 0.5, y := 22.0 - b)] ELSE [struct_pack(x := 1.0 + a, y := 1.0), struct_pack(x := 44.0, y := 0.5 + b), struct_pack(x := 43.0 - a, y := 24.0), struct_pack(x := 0.5, y := 22.0 - b)] END AS p FROM (SELECT *, (o_custkey % 50) / 10.0 AS a, (o_custkey % 30) / 10.0 AS b FROM orders WHERE o_orderkey % 512 = 1)"
_SPAN = "SELECT frame AS s, lead(frame) OVER (ORDER BY frame) AS t, p, lead(p) OVER (ORDER BY frame) AS q FROM kf"
_AT = "SELECT d.frame, gid, d.x, d.y, CASE WHEN t IS NULL OR pos = s THEN p WHEN len(p) = len(q) THEN list_transform(range(1, len(p) + 1), lambda i: struct_pack(x := p[i].x * (1 - (pos - s) / (t - s)) + q[i].x * ((pos - s) / (t - s)), y := p[i].y * (1 - (pos - s) / (t - s)) + q[i].y * ((pos - s) / (t - s)))) WHEN pos - s <= t - pos THEN p ELSE q END AS p FROM (SELECT *, greatest((SELECT min(frame) FROM kf), least((SELECT max(frame) FROM kf), frame)) AS pos FROM dedup) d ASOF JOIN sp ON d.pos >= sp.s"
_EDGE = "SELECT frame, gid, x, y, len(p) AS n, unnest(range(1, len(p) + 1)) AS i, p[i].x AS ax, p[i].y AS ay, p[i % n + 1].x AS bx, p[i % n + 1].y AS ty FROM pol"
_DIST = "SELECT *, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (ty - ay)) / ((bx - ax) * (bx - ax) + (ty - ay) * (ty - ay)))) AS u, (ay > y) <> (ty > y) AND x < (bx - ax) * (y - ay) / (ty - ay) + ax AS odd FROM e"


@query(
    f"SELECT * FROM (WITH kf AS ({_KF}), sp AS ({_SPAN}), pol AS ({_AT}), e AS ({_EDGE}), f AS (SELECT frame, gid, min(sqrt((ax + u * (bx - ax) - x) * (ax + u * (bx - ax) - x) + (ay + u * (ty - ay) - y) * (ay + u * (ty - ay) - y))) AS d, count(*) FILTER (odd) AS c FROM ({_DIST}) GROUP BY ALL) "
    "SELECT frame, gid, round(CASE WHEN c % 2 = 1 THEN d ELSE -d END, 6) AS inside_by, CASE WHEN c % 2 = 1 THEN d ELSE -d END >= -0.75 AS on_field FROM f)",
    "dedup",
)
def field_margin(v):
    a, b = (F.col("o_custkey") % 50) / 10.0, (F.col("o_custkey") % 30) / 10.0
    corner = lambda x, y: F.struct(F.lit(x).cast("double").alias("x") if not hasattr(x, "alias") else x.alias("x"), F.lit(y).cast("double").alias("y") if not hasattr(y, "alias") else y.alias("y"))
    four = [corner(1.0 + a, 1.0), corner(44.0, 0.5 + b), corner(43.0 - a, 24.0), corner(0.5, 22.0 - b)]
    five = [*four[:3], corner(20.0, 26.0), four[3]]
    k = v.table("orders").where("o_orderkey % 512 = 1").select(F.col("o_orderkey").alias("frame"), F.when(F.col("o_custkey") % 4 == 0, F.array(*five)).otherwise(F.array(*four)).alias("points"))
    t = field.on_field(v.dedup().select("frame", "gid", "x", "y"), k, [], F.col("x"), F.col("y"), 0.75)
    return t.select("frame", "gid", rnd("inside_by").alias("inside_by"), "on_field")


_RP = "SELECT l_orderkey AS frame, l_quantity AS x, l_discount * 100 AS y, l_quantity * 1.001 + l_tax AS wx, l_discount * 100 - l_tax AS wy, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 9 > 0 OR l_linenumber > 0"
_RE = f"SELECT frame, o_custkey % 9 = 0 AS lacking, sqrt(ex * ex + ey * ey) AS e FROM (SELECT frame, o_custkey, (x + 0.01 * y + (o_custkey % 7) / 100.0) / (0.0001 * x + 1) - wx AS ex, (0.99 * y + 0.02) / (0.0001 * x + 1) - wy AS ey FROM ({_RP}))"
_RF = f"SELECT frame, count(*) AS points, CASE WHEN NOT any_value(lacking) THEN round(sqrt(CAST(sum(CAST(e * e AS DECIMAL(38,12))) AS DOUBLE) / count(*)), 6) END AS rmse, CASE WHEN NOT any_value(lacking) THEN round(max(e), 6) END AS max_error, CASE WHEN any_value(lacking) THEN 'no_matrix' WHEN count(*) < 4 THEN 'too_few_points' WHEN max(e) > 0.5 THEN 'reprojection_error' END AS reason FROM ({_RE}) GROUP BY frame"


def _reprojected(v):
    k = F.col("o_custkey")
    o = v.table("orders").select(F.col("o_orderkey").alias("frame"), "o_custkey")
    points = v.table("lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_quantity") * 1.001 + F.col("l_tax")).alias("wx"), (F.col("l_discount") * 100 - F.col("l_tax")).alias("wy"))
    lit = lambda *c: [F.lit(x) for x in c]
    h = o.where(k % 9 > 0).select("frame", F.array(*lit(1.0, 0.01), (k % 7) / 100.0, *lit(0.0, 0.99, 0.02, 0.0001, 0.0, 1.0)).alias("h"))
    return reviews.reprojection(points, h, [])


@query(f"SELECT frame, points, rmse, max_error, reason IS NULL AS accepted, reason FROM ({_RF})")
def reprojection_errors(v):
    return _reprojected(v)


@query(f"SELECT match, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS frames FROM (SELECT *, sum(CASE WHEN was AND frame - last <= 30 THEN 0 ELSE 1 END) OVER (PARTITION BY match ORDER BY frame) AS k FROM (SELECT frame // {MATCH} AS match, frame, reason IS NULL AS ok, lag(reason IS NULL) OVER w AS was, lag(frame) OVER w AS last FROM ({_RF}) WINDOW w AS (PARTITION BY frame // {MATCH} ORDER BY frame)) WHERE ok) GROUP BY match, k")
def calibrated_segments(v):
    t = _reprojected(v).withColumn("match", F.expr(f"frame div {MATCH}"))
    return reviews.accepted_segments(t, ["match"], apart=30)


# ---- identity ----

_PAIR = "SELECT a.gid % 3 AS side, a.gid AS a, b.gid AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM dedup a JOIN dedup b ON a.frame = b.frame AND a.gid < b.gid AND a.gid % 3 = b.gid % 3"


@query(f"SELECT side, a, b, count(*) AS frames, round(quantile_cont(d, 0.5), 3) AS separation FROM ({_PAIR}) GROUP BY ALL HAVING count(*) >= 15 AND quantile_cont(d, 0.5) > 2", "dedup")
def number_conflicts(v):
    return identity.apart(v.dedup().withColumn("side", F.col("gid") % 3), ["side"], 15, 2.0)


_IDS = "SELECT gid, CASE WHEN gid % 5 = 0 THEN '' ELSE 'team_' || (gid % 2) END AS team, CASE WHEN gid % 3 = 0 THEN 'p' || (gid % 30) END AS person, CASE WHEN gid % 4 = 0 THEN CAST(gid % 11 AS VARCHAR) END AS number FROM (SELECT DISTINCT gid FROM ticks)"


@query(
    f"SELECT gid, candidate, reasons = '' AS compatible, linked, reasons FROM (SELECT a.gid, b.gid AS candidate, coalesce(a.person = b.person, false) AS linked, concat_ws(';', CASE WHEN a.team <> '' AND b.team <> '' AND a.team <> b.team THEN 'team' END, CASE WHEN n > 0 THEN 'together:' || n END, CASE WHEN a.person <> b.person THEN 'person' END, CASE WHEN a.number <> b.number THEN 'number' END) AS reasons FROM ({_IDS}) a JOIN ({_IDS}) b ON a.gid <> b.gid LEFT JOIN (SELECT x.gid AS g, y.gid AS h, count(*) AS n FROM ticks x JOIN ticks y ON x.frame = y.frame AND x.gid <> y.gid WHERE x.gid % 20 = 0 GROUP BY ALL) ON g = a.gid AND h = b.gid WHERE a.gid % 20 = 0)",
    "ticks",
)
def merge_review(v):
    g = F.col("gid")
    ids = v.ticks().select("gid").distinct()
    ids = ids.select("gid", F.when(g % 5 == 0, "").otherwise(F.concat(F.lit("team_"), (g % 2).cast("string"))).alias("team"), F.when(g % 3 == 0, F.concat(F.lit("p"), (g % 30).cast("string"))).alias("person"), F.when(g % 4 == 0, (g % 11).cast("string")).alias("number"))
    return identity.merge_candidates(ids, v.ticks(), ids.where("gid % 20 = 0"))


_CENTRES = [[-0.12, 0.0, 0.0], [0.0, 0.12, 0.05], [0.1, -0.1, 0.0]]
_NEAR = "SELECT vec_id, list_sort(list_transform([" + ", ".join(f"struct_pack(c := {c}::DOUBLE[], m := {k})" for k, c in enumerate(_CENTRES)) + "], lambda z: struct_pack(d := sqrt((e[1]::DOUBLE - z.c[1]) ** 2 + (e[2]::DOUBLE - z.c[2]) ** 2 + (e[3]::DOUBLE - z.c[3]) ** 2), m := z.m)))[1] AS n, e FROM (SELECT vec_id, embedding AS e FROM embeddings WHERE embedding IS NOT NULL)"
_TWO = f"SELECT * FROM (SELECT m, n, r, row_number() OVER (ORDER BY n DESC, m) - 1 AS mode FROM (SELECT n.m AS m, count(*) AS n, quantile_cont(n.d, 0.97) AS r FROM ({_NEAR}) GROUP BY ALL)) WHERE mode < 2"
_C = "CASE {0} WHEN 0 THEN [-0.12, 0.0, 0.0] WHEN 1 THEN [0.0, 0.12, 0.05] ELSE [0.1, -0.1, 0.0] END"


def _small(v):
    return v.table("embeddings").where("embedding is not null").select("vec_id", F.slice("embedding", 1, 3).cast("array<double>").alias("v"))


@query(
    f"SELECT vec_id, CASE WHEN q[1].d <= q[1].r AND q[2].d - q[1].d >= 0.08 * q[1].s THEN q[1].mode ELSE -1 END AS mode FROM (SELECT vec_id, list_sort(list(struct_pack(d := sqrt((e[1]::DOUBLE - c[1]) ** 2 + (e[2]::DOUBLE - c[2]) ** 2 + (e[3]::DOUBLE - c[3]) ** 2), mode := mode, r := r, s := s))) AS q FROM embeddings_e, (SELECT *, sqrt(list_sum(list_transform(range(1, 4), lambda i: (c[i] - o[i]) ** 2))) AS s FROM (SELECT t.*, {_C.format('t.m')}::DOUBLE[] AS c, {_C.format('u.m')}::DOUBLE[] AS o FROM ({_TWO}) t JOIN ({_TWO}) u ON t.mode <> u.mode)) GROUP BY vec_id)".replace("embeddings_e", "(SELECT vec_id, embedding AS e FROM embeddings WHERE embedding IS NOT NULL) x")
)
def open_modes_assigned(v):
    x = _small(v)
    model = clusters.radii(x, "v", _CENTRES, 0.12, 0.1, 0.97)
    return clusters.assigned(x, "v", model).select("vec_id", "mode")


# ---- compilations ----

_IV = "SELECT person, greatest(0.0, min(frame) / 30.0 - 0.35) AS a, (max(frame) + 1) / 30.0 + 0.35 AS b FROM (SELECT *, sum(CASE WHEN frame - last <= 45 THEN 0 ELSE 1 END) OVER (PARTITION BY person ORDER BY frame) AS k FROM (SELECT person, frame, lag(frame) OVER (PARTITION BY person ORDER BY frame) AS last FROM (SELECT DISTINCT gid % 3 AS person, frame FROM dedup WHERE x > 30))) GROUP BY person, k"
_TL = f"SELECT *, coalesce(sum(b - a) OVER (PARTITION BY person ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM ({_IV})"


@query(f"SELECT person, frame, gid, x, y, round(frame / 30.0, 3) AS source_time, round(o + frame / 30.0 - a, 3) AS time FROM (SELECT *, gid % 3 AS person FROM dedup WHERE frame % 2 = 0) d JOIN ({_TL}) t USING (person) WHERE frame / 30.0 >= a AND frame / 30.0 < b QUALIFY row_number() OVER (PARTITION BY person, frame, gid ORDER BY a) = 1", "dedup")
def compilation_boxes(v):
    d = v.dedup().select((F.col("gid") % 3).alias("person"), "frame", "gid", "x", "y")
    line = events.compilation(events.seen_times(d.where("x > 30"), "person", 30.0), "person")
    return events.retimed(d, line, "person", 30.0).select("person", "frame", "gid", "x", "y", "source_time", "time")


# ---- event tables ----

_FRAMES = "SELECT b.frame, bx, bz AS by, frame % 5 > 0 AS reliable FROM ball b"
_BOXES = "SELECT frame, gid, x, y, 1.0 AS w, 2.0 AS h FROM dedup"
_COST = "SELECT event_id, gid, min(struct_pack(cost := d + 0.18 * (abs(frame - pos) / 5.0), frame := frame, d := d)) AS m FROM (SELECT e.event_id, e.frame AS pos, p.gid, b.frame, sqrt(greatest(p.x - 0.2 - b.bx, 0, b.bx - (p.x + 1.2)) ** 2 + greatest(p.y + 0.7 - b.by, 0, b.by - (p.y + 2.4)) ** 2) / 2.0 AS d FROM act e JOIN fr b ON b.reliable AND b.frame BETWEEN greatest(0, e.frame - 6 + CAST(e.frame % 2 AS INT)) AND e.frame + 2 - CASE WHEN e.frame % 2 = 0 THEN 0 ELSE 1 END JOIN dedup p ON p.frame = b.frame) GROUP BY ALL"
_ACT = "SELECT frame AS event_id, frame, CASE WHEN frame % 3 = 0 THEN 'shot' ELSE 'cross' END AS event_type, bx + bz / 100 AS score FROM ball WHERE bx > 43"
_RANKED = f"SELECT event_id, list(struct_pack(g := gid, s := round(exp(-m.cost), 4), f := m.frame, d := round(m.d, 4)) ORDER BY m.cost, gid)[1:3] AS c FROM ({_COST}) GROUP BY event_id"
_DECIDED = f"SELECT event_id, c, CASE WHEN c[1].d <= 1.25 THEN c[1].g END AS primary_global_id, CASE WHEN c[1].d <= 1.25 AND (c[1].s - coalesce(c[2].s, 0) >= 0.12 OR c[1].d <= 0.15) THEN 'auto' ELSE 'review' END AS actor_status, CASE WHEN c IS NULL THEN 'no_reliable_ball_player_overlap' WHEN c[1].d <= 1.25 THEN 'nearest_player_before_event_peak' ELSE 'nearest_player_too_far_from_ball' END AS actor_reason FROM act LEFT JOIN ({_RANKED}) USING (event_id)"


def _actions(v):
    return v.ball().where("bx > 43").select(F.col("frame").alias("event_id"), "frame", F.when(F.col("frame") % 3 == 0, "shot").otherwise("cross").alias("event_type"), (F.col("bx") + F.col("bz") / 100).alias("score"))


def _actors(v):
    ball = v.ball().select("frame", "bx", F.col("bz").alias("by"), (F.col("frame") % 5 > 0).alias("reliable"))
    boxes = v.dedup().select("frame", "gid", "x", "y", F.lit(1.0).alias("w"), F.lit(2.0).alias("h"))
    return timeline.attributed(_actions(v).select("event_id", "frame"), ball, boxes, 10.0)


@query(f"SELECT * FROM (WITH act AS ({_ACT}), fr AS ({_FRAMES}) SELECT event_id, primary_global_id, actor_status, actor_reason, coalesce(len(c), 0) AS n, c[1].s AS best, c[2].g AS second, c[1].f AS evidence FROM ({_DECIDED}))", "ball", "dedup")
def actor_decisions(v):
    c = lambda k: F.get("actor_candidates", F.lit(k))
    return _actors(v).select("event_id", "primary_global_id", "actor_status", "actor_reason", F.size("actor_candidates").alias("n"), c(0)["attribution_score"].alias("best"), c(1)["global_id"].alias("second"), c(0)["evidence_frame_proc"].alias("evidence"))


def _machine_events(v):
    tr = v.transitions()
    t = tr.withColumn("transition_id", F.col("end_frame"))
    angle = F.degrees(F.atan2(F.col("sby") - F.col("eby"), F.col("sbx") - F.col("ebx")))
    p = tr.where("kind = 'directed'").withColumn("pass_id", F.col("end_frame")).withColumn("angle_deg", angle)
    lost = events.counterpress(tr.select(F.col("end_frame").alias("frame"), "from_team", "to_team"), 1000)
    s = lost.select(F.col("lost").alias("event_id"), F.col("regained").alias("frame"), F.lit("counterpress").alias("event_type"), F.lit(None).cast("int").alias("gid"), F.lit(None).cast("int").alias("other"))
    return timeline.machine_events(_actions(v), _actors(v), t, p, s, 10.0, 5000.0, 40)


_SEL = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, event_id) AS k FROM act) ORDER BY k, event_type LIMIT 40"
_WIN = "round(greatest(0.0, {0} / 10.0 - 3.0), 3) AS start_time, round(least(5000.0, {0} / 10.0 + 2.0), 3) AS end_time"
_MOVED = "SELECT format('{{}}_{{:04d}}', '{0}', end_frame) AS event_id, " + _WIN.format("end_frame") + ", from_gid AS primary_global_id, to_gid AS secondary_global_id, '{1}' AS event_type, '{2}' AS source_kind, 0 AS n, NULL::INT AS best, round(end_frame / 10.0, 6) AS released, round({3}, 6) AS measured FROM {4}"
_EVENTS = " UNION ALL ".join(
    [
        f"SELECT format('action_{{:03d}}', s.event_id) AS event_id, {_WIN.format('frame')}, primary_global_id, NULL::INT AS secondary_global_id, event_type, 'stage4_action_candidate' AS source_kind, coalesce(len(c), 0) AS n, c[1].g AS best, NULL::DOUBLE AS released, round(score, 6) AS measured FROM ({_SEL}) s JOIN ({_DECIDED}) USING (event_id)",
        _MOVED.format("transition", "possession_transition", "stable_possession_transition", "displacement", "ck"),
        _MOVED.format("pass", "active_directed_pass_candidate", "pass_network_candidate", "degrees(atan2(sby - eby, sbx - ebx))", "ps"),
        f"SELECT format('semantic_{{:04d}}', lost) AS event_id, {_WIN.format('regained')}, NULL, NULL, 'counterpress', 'semantic_event_candidate', 0, NULL, NULL, CAST(regained AS DOUBLE) FROM (SELECT a.end_frame AS lost, min(b.end_frame) AS regained FROM ck a JOIN ck b ON b.to_team = a.from_team AND b.from_team <> b.to_team AND b.end_frame > a.end_frame AND b.end_frame <= a.end_frame + 1000 WHERE a.from_team <> a.to_team GROUP BY a.end_frame, a.from_team)",
    ]
)


@query(f"SELECT * FROM (WITH act AS ({_ACT}), fr AS ({_FRAMES}) SELECT event_id, start_time, end_time, primary_global_id, secondary_global_id, event_type, source_kind, n, best, released, measured FROM ({_EVENTS}))", "ck", "ps", "ball", "dedup")
def machine_event_table(v):
    e = F.col("evidence")
    measured = F.coalesce(e["source_signal_score"], e["displacement_m"], e["direction_angle_deg"], e["source_event_frame_proc"])
    n = F.coalesce(F.size(F.filter("actor_candidates", lambda c: c.isNotNull())), F.lit(0))
    return _machine_events(v).select(
        "event_id", "start_time", "end_time", "primary_global_id", "secondary_global_id", "event_type", "source_kind", F.greatest(n, F.lit(0)).alias("n"),
        F.get("actor_candidates", F.lit(0))["global_id"].alias("best"), rnd(e["release_time_seconds"]).alias("released"), rnd(measured).alias("measured"),
    )


@query(
    f"SELECT * FROM (WITH act AS ({_ACT}), fr AS ({_FRAMES}), ev AS ({_EVENTS}) SELECT 'events-for-annotation-v1' AS schema_version, count(*) AS total_events, " + ", ".join(f"count(*) FILTER (source_kind = '{k}') AS {n}" for k, n in timeline.SOURCES.items()) + " FROM ev)",
    "ck", "ps", "ball", "dedup",
)
def machine_event_envelope(v):
    h = timeline.envelope(_machine_events(v))
    return h.select("schema_version", "total_events", *[F.col("counts")[n].alias(n) for n in timeline.SOURCES.values()])


_LEDGER = "SELECT event_id, user_id, CASE WHEN event_id % 4 = 0 THEN (event_id % 50) / 60.0 / 24.0 * 86400 WHEN event_id % 4 = 1 THEN (event_id % 90) * 60.0 + 5 WHEN event_id % 4 = 3 THEN CAST(event_id % 5000 + 1 AS DOUBLE) END AS t, event_type FROM events WHERE event_id % 3 = 0"
_DET = "SELECT user_id, pos, min_by(struct_pack(pos := pos, p := p, c := c, score := score), event_id) AS f FROM (SELECT user_id, event_id, CAST(event_id % 5003 AS DOUBLE) AS pos, CAST(CASE WHEN event_id % 8 > 0 THEN event_id % 40 END AS INT) AS p, [CAST(event_id % 40 AS INT), CAST(event_id % 7 AS INT)] AS c, value AS score FROM events WHERE event_id % 3 > 0) GROUP BY user_id, pos"
_MET = "SELECT l.event_id, l.user_id, any_value(l.t) AS t, any_value(l.event_type) AS event_type, min(struct_pack(d := abs(d.pos - l.t), pos := d.pos, f := d.f)) FILTER (abs(d.pos - l.t) <= 60) AS m FROM lg l LEFT JOIN dt d ON d.user_id = l.user_id GROUP BY ALL"


@query(
    f"SELECT * FROM (WITH lg AS ({_LEDGER}), dt AS ({_DET}), mt AS ({_MET}) SELECT event_id, user_id, round(t, 3) AS anchor_time, round(t, 3) AS start_time, round(t, 3) AS end_time, CASE WHEN event_type = 'click' THEN 'shot' WHEN event_type = 'view' THEN 'dribble' ELSE 'key_action' END AS event_type, m.f.p AS primary_global_id, list_filter(m.f.c, lambda x: x IS DISTINCT FROM m.f.p)[1] AS secondary_global_id, CASE WHEN m IS NULL THEN 0.0 ELSE round(m.f.score / 100, 4) END AS confidence, round(m.d, 3) AS delta, CASE WHEN m IS NULL THEN 'unassigned' ELSE 'provisional_nearest_detector_event' END AS actor_status, CASE WHEN m.f.p % 2 = 0 THEN 'eligible_confirmed' ELSE 'not_confirmed' END AS identity_status, CASE WHEN m.f.p % 2 = 0 THEN 'player_' || m.f.p END AS player_id, CASE WHEN m.f.p % 2 = 0 THEN CAST(m.f.p % 23 AS INT) END AS jersey_number FROM mt)"
)
def ledger_matched(v):
    k, e = F.col("event_id"), v.table("events")
    at = F.when(k % 4 == 0, ((k % 50) / 60.0 / 24.0).cast("string")).when(k % 4 == 1, F.concat((k % 90).cast("string"), F.lit(":05"))).when(k % 4 == 2, "soon").otherwise((k % 5000 + 1).cast("string"))
    said = F.when(F.col("event_type") == "click", "第一次射门").when(F.col("event_type") == "view", "盘带突破").otherwise(F.col("event_type"))
    ledger = e.where(k % 3 == 0).select("event_id", "user_id", at.alias("anchor"), at.alias("start"), at.alias("end"), said.alias("tags"))
    found = e.where(k % 3 > 0).select("user_id", k.alias("order"), (k % 5003).cast("double").alias("at"), F.when(k % 8 > 0, (k % 40).cast("int")).alias("primary"), F.array((k % 40).cast("int"), (k % 7).cast("int")).alias("candidates"), F.col("value").alias("score"))
    ids = v.spark.range(0, 40, 2).select(F.col("id").cast("int").alias("gid"), F.concat(F.lit("player_"), F.col("id").cast("string")).alias("player_id"), (F.col("id") % 23).cast("int").alias("number"))
    return timeline.annotated(ledger, found, ids, 60.0, ["user_id"])


# ---- files ----


@query("SELECT frame, gid, round(x, 1) AS x, round(y, 1) AS y, round(conf, 3) AS conf FROM dedup WHERE gid IN (1, 3) AND frame >= 100 AND frame < 30000", "dedup")
def track_source(v):
    """Detections written and read back by the track source, which tests ids and frames itself."""
    track_files.register(v.spark)
    path = tables.new_path(v.spark, "tracks")
    d = v.dedup().select(F.col("frame").alias("frame_proc"), F.col("gid").alias("global_id"), "x", "y", F.lit(1.0).alias("w"), F.lit(2.0).alias("h"), F.col("conf").alias("confidence"))
    d.write.format("tracks").mode("append").save(path)
    t = v.spark.read.format("tracks").load(path).where("global_id in (1, 3) and frame_proc >= 100 and frame_proc < 30000")
    return t.select(F.col("frame_proc").alias("frame"), F.col("global_id").alias("gid"), "x", "y", F.col("confidence").alias("conf"))


# ---- packages ----

_PK = "SELECT c_custkey AS player, * FROM customer"
_PF = "SELECT o_custkey AS player, 'f' || o_orderkey AS file, CASE o_orderkey % 3 WHEN 0 THEN 'heatmap' WHEN 1 THEN 'clip' ELSE 'other' END AS kind, CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE 10 END AS length, 'h' || o_orderkey % 50 AS sha256, CASE WHEN o_orderkey % 2 = 0 THEN 600 ELSE 300 END AS width, 400 AS height, o_totalprice / 40000 AS seconds FROM orders"
_RULES = {
    "folders": "SELECT 'no player' AS what WHERE (SELECT count(*) FROM pk) = 0",
    "identity": "SELECT CAST(player AS VARCHAR) AS what FROM pk WHERE NOT (CASE WHEN player % 10 = 0 THEN player % 4 > 0 ELSE true END)",
    "running": "SELECT CAST(player AS VARCHAR) AS what FROM pk WHERE NOT (player % 17 < 15 AND c_acctbal >= 0)",
    "heatmap": "SELECT CAST(player AS VARCHAR) AS what FROM pk WHERE player NOT IN (SELECT player FROM pf WHERE kind = 'heatmap' AND width = 600 AND length > 0)",
    "clips": "SELECT player || '/' || file AS what FROM pf WHERE kind = 'clip' AND NOT seconds BETWEEN 4 AND 8",
    "events": "SELECT player || ':' || k AS what FROM ev WHERE (player, file) NOT IN (SELECT player, file FROM pf) UNION ALL SELECT CAST(player AS VARCHAR) FROM (SELECT player, count(*) AS n, min(total) AS lo, max(total) AS hi FROM ev GROUP BY player) WHERE n <> lo OR n <> hi",
    "manifest": "SELECT player || '/f' || k AS what FROM (SELECT o_custkey AS player, o_orderkey AS k, 'f' || o_orderkey AS file, 'h' || o_orderkey % 49 AS sha256 FROM orders WHERE o_orderkey % 5 = 0) WHERE (player, file, sha256) NOT IN (SELECT player, file, sha256 FROM pf WHERE length > 0)",
}


@query(
    f"SELECT * FROM (WITH pk AS ({_PK}), pf AS ({_PF}), ev AS (SELECT o_custkey AS player, o_orderkey AS k, CASE WHEN o_orderkey % 31 = 0 THEN 'lost' ELSE 'f' || o_orderkey END AS file, count(*) OVER (PARTITION BY o_custkey) + CASE WHEN o_custkey % 13 = 0 THEN 1 ELSE 0 END AS total FROM orders), b AS ("
    + " UNION ALL ".join(f"SELECT '{r}' AS rule, what FROM ({q})" for r, q in _RULES.items())
    + "), n AS (SELECT rule, count(*) AS failures, array_to_string(list_sort(list(what))[1:10], ';') AS examples FROM b GROUP BY rule) SELECT rule, failures IS NULL AS passed, coalesce(failures, 0) AS failures, coalesce(examples, '') AS examples FROM (SELECT unnest(["
    + ", ".join(f"'{r}'" for r in _RULES)
    + "]) AS rule) LEFT JOIN n USING (rule))"
)
def package_checks(v):
    c, o = v.table("customer"), v.table("orders")
    k, player = F.col("c_custkey"), F.col("o_custkey").alias("player")
    key = F.col("o_orderkey")
    name = F.concat(F.lit("f"), key.cast("string")).alias("file")
    # ids divisible by 10 are confirmed, but some of them lack a number
    ids = c.select(k.alias("player"), k.alias("global_id"), F.when(k % 10 == 0, "eligible_confirmed").otherwise("unreadable").alias("status"), F.when((k % 10 == 0) & (k % 4 > 0), k % 99).alias("number"))
    ran = c.select(k.alias("player"), (k % 17).alias("max_speed"), F.col("c_acctbal").alias("distance"), F.lit(0).alias("sprints"))
    from pyspark.sql.window import Window

    total = F.count("*").over(Window.partitionBy("o_custkey")) + F.when(F.col("o_custkey") % 13 == 0, 1).otherwise(0)
    ev = o.select(player, key.alias("event_id"), F.when(key % 31 == 0, "lost").otherwise(name).alias("file"), total.alias("total"))
    kind = F.when(key % 3 == 0, "heatmap").when(key % 3 == 1, "clip").otherwise("other")
    sha = lambda m: F.concat(F.lit("h"), (key % m).cast("string")).alias("sha256")
    files = o.select(player, name, kind.alias("kind"), F.when(key % 97 == 0, 0).otherwise(10).alias("length"), sha(50), F.when(key % 2 == 0, 600).otherwise(300).alias("width"), F.lit(400).alias("height"), (F.col("o_totalprice") / 40000).alias("seconds"))
    return reviews.package(c.select(k.alias("player")), ids, ran, ev, files, o.where(key % 5 == 0).select(player, name, sha(49)))
