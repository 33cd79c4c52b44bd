"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


#: Parts of a node's edges; each is a key of its own, so that no task has all edges of a hub.
SALTS = 128


def with_least(rows: DataFrame, key: str, value: str, spread: str, name: str) -> DataFrame:
    """rows with the least value of their key as column ``name``. A key's rows are parted by the hash of column
    ``spread``; its parts are at most SALTS rows, and only those that it has are made."""
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    parts = rows.groupBy(F.col(key).alias("__key"), F.col("__salt").alias("__of")).agg(F.min(value).alias("__least"))
    least = parts.withColumn("__least", F.min("__least").over(Window.partitionBy("__key"))).hint("merge")
    out = rows.join(least, (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__of")))
    return out.withColumn(name, F.col("__least")).drop("__salt", "__key", "__of", "__least")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    out = with_least(both, "a", "b", "b", "m").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    return out.where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # b's new neighbour is the least; a itself is linked to it where b is
    out = with_least(down, "a", "b", "b", "m").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of an edge but the roots; root is the smallest node it reaches.

    edges: (a, b), not null. Ends once a round changes nothing; each round is written, so
    the plan stays short and a lost executor costs one round. A hub's edges are parted by hash."""
    now = scratch.write("stars", edges.where("a <> b").distinct())
    print_of = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    was = print_of(now)
    for _ in range(rounds):
        before = scratch.paths.pop("stars")
        nxt = scratch.write("stars", _small(_large(now)))
        scratch.paths["stars-old"] = before
        scratch.drop("stars-old")
        now, seen = nxt, print_of(nxt)
        if seen == was:
            return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        was = seen
    raise RuntimeError("components did not settle")
