import random
from datetime import timedelta

from pyspark.sql import functions as F

from turnweave.streaming import audience, totals

SHAPE = "event_id long, at long, user_id long, event_type string, value double"


def put(spark, folder, rows):
    """One more file of events; at: seconds of some day."""
    df = spark.createDataFrame(rows, SHAPE).select("event_id", F.timestamp_seconds(F.col("at") + 1_700_000_000).alias("ts"), "user_id", "event_type", "value")
    df.coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_totals_close_idle_users_drop_late_events_and_survive_a_restart(spark, tmp_path):
    folder, target, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    run = lambda: totals.keep_totals(stream(spark, folder), target, log, timedelta(seconds=100), "10 seconds").awaitTermination()
    put(spark, folder, [(1, 0, 1, "view", 1.5), (2, 3, 1, "purchase", 2.0), (3, 1, 1, "click", None)])
    put(spark, folder, [(4, 10_000, 2, "view", 1.0)])
    run()
    put(spark, folder, [(5, 5, 1, "view", 9.0), (6, 10_001, 2, "click", 1.0), (7, None, 2, "view", 1.0)])  # the first is late
    put(spark, folder, [(8, 10_005, 1, "view", 4.0)])
    run()
    got = {(r.user_id, r.opened_by): (r.n, r.cents, r.n_purchases, r.last_type, r.closed) for r in totals.stored_totals(spark, target).collect()}
    (first,) = [k for k in got if k[0] == 1 and k[1] != 8]
    assert got == {first: (3, 350, 1, "purchase", True), (1, 8): (1, 400, 0, "view", False), (2, 4): (2, 200, 0, "click", False)}


def test_totals_of_closed_users_are_those_of_the_batch(spark, tmp_path):
    draw, folder = random.Random(3), str(tmp_path / "in")
    for part in range(4):
        put(spark, folder, [(part * 50 + i, part * 600 + draw.randrange(500), draw.randrange(6), draw.choice(["view", "purchase"]), draw.randrange(100) / 4) for i in range(50)])
    batch = spark.read.parquet(folder)
    put(spark, folder, [(999, 100_000, 99, "view", 1.0)])  # closes all others
    put(spark, folder, [(1000, 100_001, 99, "view", 1.0)])
    totals.keep_totals(stream(spark, folder), str(tmp_path / "out"), str(tmp_path / "log"), timedelta(hours=1), "10 minutes").awaitTermination()
    shown = ["user_id", "n", "cents", "n_purchases", "last_ts", "last_type"]
    closed = totals.stored_totals(spark, str(tmp_path / "out")).where("closed").select(*shown)
    assert sorted(map(tuple, closed.collect())) == sorted(map(tuple, audience.user_state(batch).select(*shown).collect()))


def test_trending_of_a_stream_is_that_of_the_batch_for_closed_windows(spark, tmp_path):
    draw, folder = random.Random(4), str(tmp_path / "in")
    for part in range(3):
        put(spark, folder, [(part * 80 + i, part * 100 + draw.randrange(120), draw.randrange(5), "view", 1.0) for i in range(80)])
    audience.keep_trending(stream(spark, folder), str(tmp_path / "out"), str(tmp_path / "log"), "60 seconds", 2, "30 seconds").awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()))
    want = sorted(map(tuple, audience.trending(spark.read.parquet(folder), "60 seconds", 2).collect()))
    ends = {x[0] for x in got}
    assert len(ends) >= 3 and got == [x for x in want if x[0] in ends] and want[-1][0] not in ends


def brute_touches(events, seconds):
    out = {}
    for e in events:
        if e[3] == "purchase":
            before = [t for t in events if t[2] == e[2] and t[3] in audience.TOUCHES and (t[1], t[0]) < (e[1], e[0])]
            last = max(before, key=lambda t: (t[1], t[0]), default=None)
            out[e[0]] = last[0] if last and last[1] >= e[1] - seconds else None
    return out


def test_last_touches_of_a_user_with_half_of_the_events(spark, tmp_path):
    draw = random.Random(6)
    events = [(i, draw.randrange(4000), draw.choice([1, 1, 1, 2, 3, 4]), draw.choice(["view", "click", "purchase", "error"]), 1.0) for i in range(400)]
    put(spark, str(tmp_path / "in"), events)
    rows = spark.read.parquet(str(tmp_path / "in"))
    for limit, bucket in ((100, "1 minute"), (3000, "7 seconds"), (3000, "2 hours")):
        got = {r.purchase_id: r.touch_id for r in audience.last_touch(rows, f"{limit} seconds", bucket).collect()}
        assert got == brute_touches(events, limit)


def test_last_touches_of_two_streams(spark, tmp_path):
    draw = random.Random(7)
    events = [(i, i * 5 + draw.randrange(20), draw.randrange(3), draw.choice(["view", "purchase", "error"]), 1.0) for i in range(200)]
    for part in range(4):  # each stream is as late as its own watermark allows
        put(spark, str(tmp_path / "touches"), events[part * 50 : part * 50 + 50])
        put(spark, str(tmp_path / "bought"), events[part * 50 : part * 50 + 50])
    for folder in ("touches", "bought"):
        put(spark, str(tmp_path / folder), [(1000, 90_000, 9, "view", 1.0), (1001, 90_000, 9, "purchase", 1.0)])
    met = audience.last_touch_stream(stream(spark, str(tmp_path / "touches")), stream(spark, str(tmp_path / "bought")), "60 seconds", "30 seconds", "40 seconds")
    run = met.writeStream.format("memory").queryName("touched").outputMode("append").option("checkpointLocation", str(tmp_path / "log"))
    run.trigger(availableNow=True).start().awaitTermination()
    got = {r.purchase_id: r.touch_id for r in spark.table("touched").collect()}
    want = brute_touches(events, 60)
    assert got == want and None in want.values() and len(want) > 40
