"""Joins of points with ranges that hold them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words


def range_join(points: DataFrame, ranges: DataFrame, point: Column, low: Column, high: Column, width: int, keys: list[str] | None = None) -> DataFrame:
    """Rows of points with each range that holds them: low <= point < high, all whole numbers, and equal keys. Both are cut into bins of
    ``width``; a range is a row for each bin that it meets, so points and ranges of a bin are joined by equality and the
    rest is a filter. A width near the length of the ranges makes the fewest rows. Null and empty ranges hold nothing."""
    keys = keys or []
    p = points.withColumn("__point", point.cast("long")).withColumn("__bin", F.floor(F.col("__point") / width).cast("long"))
    r = ranges.withColumn("__low", low.cast("long")).withColumn("__high", high.cast("long")).where("__low < __high")
    r = r.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("__low") / width).cast("long"), F.floor((F.col("__high") - 1) / width).cast("long"))))
    return p.join(r, [*keys, "__bin"]).where("__low <= __point AND __point < __high").drop("__bin", "__point", "__low", "__high")


def passages(turns: DataFrame, size: int = 50, step: int = 40) -> DataFrame:
    """(conv_id, turn, first, last): windows of ``size`` terms of each turn that start every ``step`` terms; last is one past the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            yield pa.RecordBatch.from_arrays([*rb.columns[:2], pa.array([len(t) for t in words(rb.column(2))], pa.int32())], ["conv_id", "turn", "n"])

    kinds = ", ".join(f"{c} {turns.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn"))
    n = turns.select("conv_id", "turn", "text").mapInArrow(run, f"{kinds}, n int").where("n > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col("n") - size) / step).cast("int") * step), F.lit(step))
    rows = n.select("conv_id", "turn", "n", F.explode(starts).alias("first"))
    return rows.select("conv_id", "turn", F.col("first").cast("long").alias("first"), F.least(F.col("first") + size, "n").cast("long").alias("last"))


def passage_mentions(turns: DataFrame, mentions: DataFrame, size: int = 50, step: int = 40) -> DataFrame:
    """Mentions (conv_id, turn, pos, phrase) that begin in each passage of the turns, and their phrases; passages without any are left out."""
    found = range_join(mentions, passages(turns, size, step), F.col("pos"), F.col("first"), F.col("last"), step, ["conv_id", "turn"])
    return found.groupBy("conv_id", "turn", "first").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("phrase").alias("n_phrases"))


def after_errors(events: DataFrame, minutes: int = 10) -> DataFrame:
    """For each error event the purchases of anyone in the ``minutes`` from it on, their number and value in cents, and how many are its own user's."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    errors = events.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("user_id").alias("error_user"), micros.alias("at"))
    bought = events.where("event_type = 'purchase'").select("user_id", "value", micros.alias("when"))
    length = minutes * 60_000_000
    met = range_join(bought, errors, F.col("when"), F.col("at"), F.col("at") + length, length)
    cents = F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")
    return met.groupBy("error_id").agg(F.count(F.lit(1)).alias("n"), cents, F.count_if(F.col("user_id") == F.col("error_user")).alias("n_own"))
