"""Audience events (event_id, ts, user_id, event_type, value), batch or streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def timed(events: DataFrame) -> DataFrame:
    """ts as a timestamp with zone, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def engagement(events: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Events and value of each type in windows; with slide they overlap."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    by = timed(events).withWatermark("ts", delay).groupBy(w.alias("w"), "event_type")
    by = by.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    return by.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("v", 4).alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of each user: events no further apart than gap."""
    by = timed(events).withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("s"), "user_id")
    by = by.agg(F.count(F.lit(1)).alias("n"))
    return by.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("session_start"), "n")


def dedup_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events without repeats of an event_id within the watermark."""
    rows = timed(events).withWatermark("ts", delay)
    return rows.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else rows.dropDuplicates(["event_id"])


def counted(events: DataFrame, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(window_start, user_id, n): events of each user in windows; on a stream one counter for each user of an open window."""
    by = timed(events).withWatermark("ts", delay).groupBy(F.window("ts", size).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return by.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "user_id", "n")


def first_of_windows(counts: DataFrame, k: int = 3) -> DataFrame:
    """The k users with most events in each window of counts, which has whole windows."""
    order = Window.partitionBy("window_start").orderBy(F.desc("n"), "user_id")
    return counts.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("window_start", "rank", "user_id", "n")


def trending(events: DataFrame, size: str = "1 day", k: int = 3) -> DataFrame:
    """The k users with most events in each window (batch)."""
    return first_of_windows(counted(events, size), k)


def keep_trending(events: DataFrame, target: str, checkpoint: str, size: str = "1 day", k: int = 3, delay: str = "1 hour"):
    """A streaming query that writes the k users with most events of each window once the watermark has closed it, all its counters
    then come in one micro-batch. A micro-batch writes into a folder of its own number, so that a retry gives nothing twice."""
    put = lambda rows, batch: first_of_windows(rows, k).write.mode("overwrite").parquet(f"{target}/batch={batch}")
    out = counted(events, size, delay).writeStream.outputMode("append").foreachBatch(put)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


TOUCHES = ("view", "click")


def _longest(limit: str) -> Column:
    return F.expr(f"INTERVAL {limit}")


def last_touch(events: DataFrame, limit: str = "7 days", bucket: str = "6 hours") -> DataFrame:
    """The last view or click of the user before each purchase, in the order of ts and event_id, if not older than limit.

    An as-of join in buckets of time: a bucket of a user's events is looked through alone, and what is the last touch before it is
    handed on from one row for each bucket; so a user with most of the events is as many tasks as there are buckets."""
    rows = timed(events).where("ts IS NOT NULL").select("event_id", "ts", "user_id", "event_type", F.window("ts", bucket)["start"].alias("bucket"))
    touch = F.when(F.col("event_type").isin(*TOUCHES), F.struct("ts", "event_id"))
    by = rows.groupBy("user_id", "bucket").agg(F.max(touch).alias("last"))
    before = Window.partitionBy("user_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    handed = by.select(F.col("user_id").alias("of"), F.col("bucket").alias("at"), F.last("last", True).over(before).alias("handed"))
    inside = Window.partitionBy("user_id", "bucket").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    bought = rows.withColumn("touch", F.last(touch, True).over(inside)).where("event_type = 'purchase'")
    x = bought.join(handed, F.col("user_id").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at")), "left").withColumn("touch", F.coalesce("touch", "handed"))
    near = F.col("touch.ts") >= F.col("ts") - _longest(limit)
    return x.select(F.col("event_id").alias("purchase_id"), "user_id", F.when(near, F.col("touch.event_id")).alias("touch_id"))


def last_touch_stream(touches: DataFrame, purchases: DataFrame, limit: str = "1 day", touch_delay: str = "1 hour", purchase_delay: str = "1 hour") -> DataFrame:
    """last_touch() of two streams of events, each with a watermark of its own: an interval join keeps touches for ``limit`` and no
    longer, and a purchase comes out once no touch before it can still come. Purchases are told apart by event_id and ts."""
    t = timed(touches).where(F.col("event_type").isin(*TOUCHES)).withWatermark("ts", touch_delay)
    t = t.select(F.col("user_id").alias("of"), F.col("ts").alias("touch_ts"), F.col("event_id").alias("touch_id"))
    p = timed(purchases).where("event_type = 'purchase'").withWatermark("ts", purchase_delay).select(F.col("event_id").alias("purchase_id"), "ts", "user_id")
    earlier = (F.col("touch_ts") < F.col("ts")) | ((F.col("touch_ts") == F.col("ts")) & (F.col("touch_id") < F.col("purchase_id")))
    near = (F.col("touch_ts") <= F.col("ts")) & (F.col("touch_ts") >= F.col("ts") - _longest(limit))
    met = p.join(t, (F.col("user_id") == F.col("of")) & near & earlier, "leftOuter")
    last = F.max(F.struct("touch_ts", "touch_id"))["touch_id"].alias("touch_id")
    return met.groupBy("ts", "purchase_id", "user_id").agg(last).select("purchase_id", "user_id", "touch_id")


def user_state(events: DataFrame) -> DataFrame:
    """Totals of each user (batch); totals.py keeps them for a stream."""
    latest = F.max(F.struct("ts", "event_id", "event_type")).alias("latest")
    value = F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")
    by = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), value, F.count_if(F.col("event_type") == "purchase").alias("n_purchases"), latest)
    return by.select("user_id", "n", "cents", "n_purchases", F.col("latest.ts").alias("last_ts"), F.col("latest.event_type").alias("last_type"))


def properties(events: DataFrame) -> DataFrame:
    """Of the numbers in props, a JSON object: (event_type, name, n, total, least, most). What is no object or no number counts nowhere."""
    told = F.from_json("props", "map<string,double>")
    rows = events.select("event_type", F.explode(F.map_filter(told, lambda _, v: v.isNotNull())).alias("name", "x"))
    by = rows.groupBy("event_type", "name")
    return by.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("total"), F.min("x").alias("least"), F.max("x").alias("most"))


def profiles(events: DataFrame) -> DataFrame:
    """(user_id, n, main, profile): each user's events by type as a map, written as JSON in the order of names, and the type with most, ties to the first name."""
    by = events.where("event_type IS NOT NULL").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    rows = by.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", "n"))).alias("t"), F.sum("n").alias("n"))
    told = rows.withColumn("profile", F.map_from_entries("t"))
    most = F.array_max(F.map_values("profile"))
    main = F.array_min(F.map_keys(F.map_filter("profile", lambda _, v: v == most)))
    return told.select("user_id", "n", main.alias("main"), F.to_json("profile").alias("profile"))


def daily(events: DataFrame) -> DataFrame:
    """Events and value in cents by week, day and type, with the subtotals of each day, each week and all."""
    ts = F.col("ts").cast("timestamp")
    day = lambda unit: F.date_trunc(unit, ts).cast("date")
    rows = events.select(day("week").alias("week"), day("day").alias("day"), "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    by = rows.rollup("week", "day", "event_type").agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    return by.select(F.col("week").cast("string").alias("week"), F.col("day").cast("string").alias("day"), "event_type", "level", "n", "cents")
