"""Streams against the same rows taken at once."""

import random

from touchline.functions import seq
from touchline.streaming import possession, windows


def write(spark, rows, schema, folder, parts):
    """A file per part, so that each is a micro-batch."""
    for k in range(parts):
        n = -(-len(rows) // parts)
        spark.createDataFrame(rows[k * n : (k + 1) * n], schema).coalesce(1).write.mode("append").parquet(folder)


def collect(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_possession_intervals(spark, tmp_path):
    rng = random.Random(4)
    rows, frame, gid = [], 0, 1
    for _ in range(300):
        frame += 1 if rng.random() < 0.9 else 3
        gid = gid if rng.random() < 0.7 else rng.randint(1, 3)
        rows.append((5, frame, gid))
    rows += [(6, f, g) for _, f, g in rows]
    rows.sort(key=lambda r: r[1])
    schema = "match long, frame long, gid long"
    write(spark, rows, schema, str(tmp_path / "in"), 4)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).selectExpr("*", "timestamp_seconds(frame) AS at").withWatermark("at", "1 second")
    got = {(r.match, r.gid, r.start_frame, r.end_frame, r.n) for r in collect(spark, possession.intervals(stream, 2), "owned")}
    batch = seq.runs(spark.createDataFrame(rows, schema).where("match = 5"), "gid", "frame").groupBy("gid", "run").agg({"frame": "min", "*": "count"}).collect()
    spans = {(r["min(frame)"], r.gid, r["count(1)"]) for r in batch if r["count(1)"] >= 2}
    last = max(r[1] for r in rows)
    want = {(m, g, a, a + n - 1, n) for a, g, n in spans for m in (5, 6) if a + n - 1 < last}
    assert got == want and len(want) > 20


def test_repeated_events_count_once(spark, tmp_path):
    rows = [(k % 20, k) for k in range(60)]
    write(spark, rows, "event_id long, second long", str(tmp_path / "in"), 3)
    stream = spark.readStream.schema("event_id long, second long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).selectExpr("event_id", "timestamp_seconds(second) AS ts")
    got = collect(spark, windows.first_seen(stream, ["event_id"], "1 hour"), "once")
    assert sorted(r.event_id for r in got) == list(range(20))
