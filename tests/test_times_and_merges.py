"""Times beyond 99 minutes, before zero and missing; ids that may merge, on frames of any sign and distance."""

import random

import duckdb
from pyspark.sql import functions as F

from touchline.functions import scalars
from touchline.operators import identity
from touchline.plans import queries


def test_time_formats_of_long_negative_and_missing_values(spark, tmp_path):
    values = [0.0, 0.5, 11.11, 666.66, 666.67, 700.0, 7000.0, -0.56, -6.7, -70.05, -6700.0, None]
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    cols = ["event_id", "rounded", "cut"]
    got = sorted(map(tuple, queries.QUERIES["time_formats"](spark, str(tmp_path)).select(cols).collect()))
    assert got == sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES['time_formats']})").fetchall())


def test_minutes_take_the_digits_they_need(spark):
    rows = spark.createDataFrame([(6000.4,), (59.6,), (None,)], "s double")
    assert [tuple(r) for r in rows.select(scalars.minutes(F.col("s")), scalars.minutes(F.col("s"), True)).collect()] == [("100:00", "100:00"), ("01:00", "00:59"), (None, None)]


def test_merges_count_frames_of_any_sign_and_distance(spark):
    rng = random.Random(5)
    places = [*range(-130, 130), *range(10**12, 10**12 + 70), -(2**40)]
    seen = [(g, f) for g in range(12) for f in rng.sample(places, 150)] + [(12, 3)] * 4 + [(13, 3), (13, 4), (14, None), (None, 3)]
    ids = spark.createDataFrame([(g, None, None, None) for g in (*range(16), None)], "gid int, team string, person string, number string")
    rows = spark.createDataFrame(seen, "gid int, frame long").repartition(5)
    got = {(r.gid, r.candidate): r.reasons for r in identity.merge_candidates(ids, rows, ids.where("gid % 4 = 0")).collect()}
    held = {g: {f for k, f in seen if k == g and f is not None} for g in range(16)}
    n = {(a, b): len(held[a] & held[b]) for a in range(0, 16, 4) for b in range(16) if a != b}
    assert got == {p: f"together:{k}" if k else "" for p, k in n.items()} and n[12, 13] == 1


def test_merges_make_pairs_without_shuffling_them(spark):
    ids = spark.range(40).select("id", F.lit("a").alias("team"), F.lit("p").alias("person"), F.lit("1").alias("number")).withColumnRenamed("id", "gid")
    rows = ids.select("gid", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("frame"))
    t = identity.merge_candidates(ids, rows, ids.where("gid < 4"))
    assert t.count() == 4 * 39 and t.where("reasons = 'together:21'").count() == 4 * 39
    plan = t._jdf.queryExecution().executedPlan().toString()
    # the ids alone are dealt out; what comes after the pairs is projected in place
    assert plan.count("Exchange RoundRobinPartitioning") == 1 and "hashpartitioning" not in plan and "Aggregate" not in plan
