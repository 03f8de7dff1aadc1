from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionlake.operators.sessions import assign_events, pair_sessions
from sessionlake.sources.telemetry import telemetry
from sessionlake.streaming.assignment import assign, stream_assignments
from sessionlake.streaming.pairing import stream_sessions
from tests.conftest import SMALL


def test_stream_gives_the_batch_sessions(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    folder = str(tmp_path / "in")
    ordered = events.orderBy("ts").limit(400).cache()
    bounds = ordered.stat.approxQuantile("event_id", [0.5], 0.0)
    assert bounds
    cut = ordered.selectExpr("percentile(unix_micros(cast(ts AS timestamp)), 0.5)").first()[0]
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    ordered.filter(micros <= cut).coalesce(1).write.mode("append").parquet(folder)
    ordered.filter(micros > cut).coalesce(1).write.mode("append").parquet(folder)
    last = ordered.agg(F.max("ts")).first()[0]
    # A mark of another player, a day on, lets the watermark pass all others.
    flush = spark.createDataFrame([(10**9, last, 10**9, "view", 0.0, '{"k": 1}')], events.schema).withColumn("ts", F.expr("ts + INTERVAL 1 DAY"))
    flush.coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = stream_sessions(telemetry(source), "1 hour").writeStream.format("memory").queryName("sessions_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.pid, r.login_time, r.exit_time) for r in spark.sql("SELECT * FROM sessions_out").collect()}
    want = {(r.pid, r.login_time, r.exit_time) for r in pair_sessions(telemetry(ordered)).collect()}
    assert want
    assert got == want


def spans(df):
    return {(r.event_id, r.pid, r.event_table, r.event_time, r.login_time, r.exit_time) for r in df.collect()}


def test_stream_assigns_what_the_batch_assigns(spark, tmp_path):
    """Three batches in time order, rows late within the delay, and rows of one instant; a last row of another player flushes the watermark."""
    events = spark.read.parquet(f"{SMALL}/events.parquet").orderBy("ts").limit(600).withColumn("ts", F.date_trunc("minute", "ts").cast(dict(spark.read.parquet(f"{SMALL}/events.parquet").dtypes)["ts"])).cache()
    folder, rank = str(tmp_path / "in"), F.percent_rank().over(Window.orderBy("ts", "event_id"))
    # Every ninth row comes a batch late, which the delay allows.
    placed = events.withColumn("b", F.least(F.lit(2), F.floor(rank * 3) + (F.col("event_id") % 9 == 0).cast("int"))).cache()
    for b in range(3):
        placed.filter(F.col("b") == b).drop("b").coalesce(1).write.mode("append").parquet(folder)
    last = events.agg(F.max("ts")).first()[0]
    flush = spark.createDataFrame([(10**9, last, 10**9, "view", 0.0, '{"k": 1}')], events.schema).withColumn("ts", F.expr("ts + INTERVAL 90 DAY"))
    flush.coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = stream_assignments(telemetry(source), "60 days").writeStream.format("memory").queryName("assigned_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    state = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    got = spans(spark.table("assigned_out"))
    tele = telemetry(events)
    sessions = pair_sessions(tele)
    want = spans(assign_events(tele, sessions).join(sessions.select("session_id", "login_time", "exit_time"), "session_id", "left"))
    assert len([w for w in want if w[4]]) > 50
    # Events since a login that no mark follows are still held.
    ends = {r.pid: r.t for r in tele.filter("event_table in ('player_logged_in', 'exited_game')").groupBy("pid").agg(F.expr("max_by(struct(event_table, event_time), struct(event_time, event_table = 'exited_game', event_id))").alias("m")).filter("m.event_table = 'player_logged_in'").select("pid", F.col("m.event_time").alias("t")).collect()}
    assert got == {w for w in want if w[1] not in ends or w[3] < ends[w[1]]}
    assert state == len(ends) + 1


def test_assignment_in_steps_is_that_at_once():
    """Any cuts between times give the same events; each event is given out once or held."""
    rng = random.Random(3)
    for _ in range(200):
        rows = [(rng.randrange(12), rng.choice([0, 0, 1, 2, 2, 2]), i, "e") for i in range(rng.randrange(25))]
        whole = assign(None, [], rows)
        open_us, since, out = None, [], []
        for t in range(12):
            open_us, since, more = assign(open_us, since, [r for r in rows if r[0] == t])
            out += more
        assert (open_us, since, sorted(out, key=str)) == (whole[0], whole[1], sorted(whole[2], key=str))
        assert sorted(m for m, *_ in out) == sorted(m for m in rows if m[1] and m not in since)
