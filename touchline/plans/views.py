"""Tracking-shaped views of the driver's tables, by integer arithmetic, so that any engine agrees on them; and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.functions import tables
from touchline.operators import possession, tracks

REACH, RUN, GAP = 12.0, 2, 15


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._intervals = spark, sf_dir, None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def det(self) -> DataFrame:
        gid = F.expr("(l_orderkey div 8 + l_suppkey) % 7").cast("int")
        return self.table("lineitem").select(F.col("l_orderkey").cast("int").alias("frame"), gid.alias("gid"), (F.col("l_quantity") * 0.9).alias("x"), (F.col("l_discount") * 250).alias("y"), F.col("l_tax").alias("conf"))

    def dedup(self) -> DataFrame:
        return tracks.best_per_frame(self.det(), ["frame", "gid"], ["conf", "x", "y"], by="frame")

    def ball(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").cast("int").alias("frame"), (F.expr("o_custkey % 450") / 10.0).alias("bx"), (F.expr("o_custkey % 250") / 10.0).alias("bz"))

    def teams(self) -> DataFrame:
        """Ids 0 to 5; 6 has no team."""
        return self.spark.range(6).select(F.col("id").cast("int").alias("gid"), F.concat(F.lit("team_"), (F.col("id") % 2).cast("string")).alias("team"))

    def match(self) -> DataFrame:
        return possession.nearest_player(self.dedup(), self.ball(), REACH)

    def intervals(self) -> DataFrame:
        """Written once for each query: its branches, and what follows, read the table."""
        if self._intervals is None:
            self._intervals = tables.cut(possession.intervals(self.match(), RUN), "intervals")
        return self._intervals

    def transitions(self) -> DataFrame:
        return possession.classified(possession.transitions(self.intervals(), GAP), F.broadcast(self.teams()), 2.0)

    def ticks(self) -> DataFrame:
        """One frame per user and day, with two coordinates."""
        e = self.table("events").select(F.col("user_id").cast("int").alias("gid"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400).cast("int").alias("frame"), "value", "event_id")
        return e.groupBy("gid", "frame").agg(F.round(F.max("value"), 4).alias("x"), F.round(F.min("value"), 4).alias("y"))


    def rel(self) -> DataFrame:
        """ticks with frames counted from their first one."""
        t = self.ticks()
        low = t.agg(F.min("frame").alias("_lo"))  # one row
        return t.crossJoin(F.broadcast(low)).withColumn("frame", F.col("frame") - F.col("_lo")).drop("_lo")

    def steps(self) -> DataFrame:
        """ticks with the step from the frame before, if there is one, and a speed."""
        w = Window.partitionBy("gid").orderBy("frame")
        dx, dy = (F.col(c) - F.lag(c).over(w) for c in "xy")
        t = self.ticks().withColumn("step", F.when(F.col("frame") - F.lag("frame").over(w) == 1, F.sqrt(dx * dx + dy * dy)))
        return t.select("gid", "frame", "step", (F.col("step") * 0.2).alias("speed"))


SQL = {
    "det": "SELECT CAST(l_orderkey AS INT) AS frame, CAST((l_orderkey // 8 + l_suppkey) % 7 AS INT) AS gid, l_quantity * 0.9 AS x, l_discount * 250 AS y, l_tax AS conf FROM lineitem",
    "dedup": "SELECT frame, gid, m.conf AS conf, m.x AS x, m.y AS y FROM (SELECT frame, gid, max(struct_pack(conf := conf, x := x, y := y)) AS m FROM det GROUP BY ALL)",
    "ball": "SELECT CAST(o_orderkey AS INT) AS frame, CAST(o_custkey % 450 AS DOUBLE) / 10.0 AS bx, CAST(o_custkey % 250 AS DOUBLE) / 10.0 AS bz FROM orders",
    "teams": "SELECT CAST(range AS INT) AS gid, 'team_' || (range % 2) AS team FROM range(6)",
    "match": "SELECT frame, m.d AS d, m.gid AS gid, m.x AS x, m.y AS y, m.bx AS bx, m.bz AS bz FROM (SELECT frame, min(struct_pack(d := sqrt((x - bx) * (x - bx) + (y - bz) * (y - bz)), gid := gid, x := x, y := y, bx := bx, bz := bz)) AS m FROM dedup JOIN ball USING (frame) GROUP BY frame) WHERE m.d < 12.0",
    "iv": "SELECT gid, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n, min(d) AS min_d, max(d) AS max_d, min_by(bx, frame) AS sbx, min_by(bz, frame) AS sby, max_by(bx, frame) AS ebx, max_by(bz, frame) AS eby, min(frame) + 1 AS confirmed_frame FROM (SELECT *, frame - row_number() OVER (PARTITION BY gid ORDER BY frame) AS run FROM match) GROUP BY gid, run HAVING count(*) >= 2",
    "tr0": "SELECT gid AS from_gid, lead(gid) OVER w AS to_gid, end_frame, lead(start_frame) OVER w AS to_start_frame, lead(confirmed_frame) OVER w AS confirmed_frame, ebx, eby, lead(sbx) OVER w AS sbx, lead(sby) OVER w AS sby FROM iv WINDOW w AS (ORDER BY start_frame)",
    "tr": "SELECT t.*, to_start_frame - end_frame - 1 AS gap, sqrt((ebx - sbx) * (ebx - sbx) + (eby - sby) * (eby - sby)) AS displacement, coalesce(a.team, 'unassigned') AS from_team, coalesce(b.team, 'unassigned') AS to_team FROM tr0 t LEFT JOIN teams a ON a.gid = from_gid LEFT JOIN teams b ON b.gid = to_gid WHERE from_gid <> to_gid AND to_start_frame - end_frame - 1 BETWEEN 0 AND 15",
    "ck": "SELECT *, CASE WHEN from_team = 'unassigned' OR to_team = 'unassigned' THEN 'unknown' WHEN from_team <> to_team THEN 'opponent' WHEN displacement < 2.0 THEN 'short' ELSE 'directed' END AS kind FROM tr",
    "ps": "SELECT * FROM ck WHERE kind = 'directed'",
    "ticks": "SELECT CAST(user_id AS INT) AS gid, CAST(floor(floor(epoch(ts)) / 86400) AS INT) AS frame, round(max(value), 4) AS x, round(min(value), 4) AS y FROM events GROUP BY 1, 2",
    "s": "SELECT k, label AS l, embedding::DOUBLE[] AS v FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS k, count(*) OVER () AS n FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL) WHERE k % CAST(ceil(n / 120) AS BIGINT) = 0",
    "rel": "SELECT gid, CAST(frame - (SELECT min(frame) FROM ticks) AS INT) AS frame, x, y FROM ticks",
    "tickrun": "SELECT *, frame - row_number() OVER (PARTITION BY gid ORDER BY frame) AS run FROM ticks",
}
NEEDS = {"dedup": ["det"], "match": ["dedup", "ball"], "iv": ["match"], "tr0": ["iv"], "tr": ["tr0", "teams"], "ck": ["tr"], "ps": ["ck"], "tickrun": ["ticks"], "rel": ["ticks"]}


def sql(query: str, *views: str) -> str:
    """The query after the views that it needs."""
    order: list[str] = []

    def add(v: str) -> None:
        for n in NEEDS.get(v, []):
            add(n)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    return (f"WITH {', '.join(f'{v} AS ({SQL[v]})' for v in order)} " if order else "") + query
