"""Running totals of each user in a state of its own, closed when the user has been idle."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.lineage import shared_folder
from .audience import timed

#: Times are microseconds since 1970, which no zone of a worker can shift. opened_by: id of the event that began the period.
STATE = "n long, cents long, n_purchases long, last_at long, last_id long, last_type string, opened_by long"
TOTALS = f"user_id long, {STATE}, closed boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Totals(StatefulProcessor):
    """A user's totals as a value state. A timer stands at the last event plus ``idle``; when the watermark passes it, the totals come out as
    closed and the state goes. Each micro-batch that has events of the user gives the totals after it."""

    def __init__(self, idle: timedelta):
        self.idle = idle // timedelta(milliseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, cents, bought, last, opened = 0, 0, 0, None, None
        if self.totals.exists():
            n, cents, bought, *last, opened = self.totals.get()
            self.handle.deleteTimer(last[0] // 1000 + self.idle)
        for r in rows:
            if last is None:
                opened = r.event_id
            here = [r.at, r.event_id, r.event_type]
            last = here if last is None or (here[0], here[1] or 0) > (last[0], last[1] or 0) else last
            n, cents, bought = n + 1, cents + (r.cents or 0), bought + (r.event_type == "purchase")
        told = (n, cents, bought, *last, opened)
        self.totals.update(told)
        self.handle.registerTimer(last[0] // 1000 + self.idle)
        yield self._row(key, told, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.totals.exists():
            told = self.totals.get()
            self.totals.clear()
            yield self._row(key, told, True)

    def _row(self, key, told: tuple, closed: bool) -> Row:
        names = ("user_id", *(x.split()[0] for x in STATE.split(", ")), "closed")
        return Row(**dict(zip(names, (key[0], *told, closed), strict=True)))

    def close(self) -> None:
        pass


def user_totals(events: DataFrame, idle: timedelta = timedelta(days=30), delay: str = "1 hour") -> DataFrame:
    """Of a stream of events: the totals (TOTALS) of each user after each micro-batch that has events of it, and closed ones once the
    user has been idle. Events older than the watermark when they come are dropped; a user who comes back after closing begins
    anew. Events without ts or user_id are dropped. Needs the RocksDB state store; its timers are of event time, in which state
    has no other time to live."""
    rows = timed(events).where("ts IS NOT NULL AND user_id IS NOT NULL").withWatermark("ts", delay)
    rows = rows.select("user_id", "ts", F.unix_micros("ts").alias("at"), "event_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return rows.groupBy("user_id").transformWithState(Totals(idle), TOTALS, "update", "EventTime")


def keep_totals(events: DataFrame, target: str, checkpoint: str, idle: timedelta = timedelta(days=30), delay: str = "1 hour"):
    """A streaming query that takes what is there and ends. A micro-batch writes its totals into a folder of its own number, so that a
    retry counts nothing twice."""
    conf = events.sparkSession.conf
    key = "spark.sql.streaming.stateStore.providerClass"
    old = conf.get(key)
    conf.set(key, ROCKSDB)  # a query takes it when it starts
    try:
        put = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{target}/batch={batch}")
        out = user_totals(events, idle, delay).writeStream.outputMode("update").foreachBatch(put)
        return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(key, old)


def stored_totals(spark: SparkSession, target: str) -> DataFrame:
    """The last totals of each user and period: (user_id, opened_by, n, cents, n_purchases, last_ts, last_type, closed)."""
    rows = spark.read.schema(f"{TOTALS}, batch long").option("basePath", target).parquet(target).withColumn("last_ts", F.timestamp_micros("last_at"))
    last = F.max_by(F.struct("n", "cents", "n_purchases", "last_ts", "last_type", "closed"), F.struct("batch", "closed"))
    return rows.groupBy("user_id", "opened_by").agg(last.alias("x")).select("user_id", "opened_by", "x.*")


def streamed_user_state(spark: SparkSession, path: str) -> DataFrame:
    """Totals of each user of a table of events that is read as a stream; no one is idle long enough to be closed."""
    root = f"{shared_folder(spark)}/totals-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 64).parquet(f"{path[:-1]}[{path[-1]}]")
    keep_totals(stream, f"{root}/parts", f"{root}/log", timedelta(days=36_500)).awaitTermination()
    return stored_totals(spark, f"{root}/parts").select("user_id", "n", "cents", "n_purchases", F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "last_type")
