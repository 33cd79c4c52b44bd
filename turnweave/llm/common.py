"""What the operators share: word class, shared folder, written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Space and the ASCII controls from tab to carriage return part words.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_digest(name: str = "text") -> Column:
    """Tells apart rows that share an id; rows equal in both have the same text."""
    return F.unhex(F.md5(text_or_empty(name).cast("binary")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a
    folder of this machine where the session has none and runs on this machine only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints/turnweave"


class Scratch:
    """Intermediate tables in the shared folder. A written table cuts lineage and
    outlives the executors that made it; ``drop`` frees the ones no longer read. What is left goes when the driver ends."""

    #: Those that still have tables, in the order they were made.
    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        system, path = self._path(self.root)
        system.mkdirs(path)  # a path that is not there is not noted
        system.deleteOnExit(path)
        Scratch.made.append(self)

    @staticmethod
    def release(after: int) -> None:
        """Drops all tables of those made since there were ``after``, once nothing reads what they led to."""
        for scratch in Scratch.made[after:]:
            scratch.drop_but()
            system, path = scratch._path(scratch.root)
            system.delete(path, True)
        del Scratch.made[after:]

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        if name in self.paths:  # it is freed with the others
            self.paths[self.paths[name]] = self.paths[name]
        self.paths[name] = path
        keys = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
        old = {k: self.spark.conf.get(k) for k in keys}
        for k, v in keys.items():
            self.spark.conf.set(k, v)
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            for k, v in old.items():
                self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            system, path = self._path(self.paths.pop(name))
            system.delete(path, True)

    def drop_but(self, *names: str) -> None:
        """Frees all tables but the named ones, which are still read."""
        self.drop(*[n for n in self.paths if n not in names])


def in_order(rows: DataFrame, scratch: Scratch, name: str, order: list[Column], sums: list[str] = [], parts: int = 32) -> DataFrame:
    """rows with nth, their place from 1 in an order without ties, and before_x for each x of sums, its sum over the
    rows before. Rows are dealt by range and written, so that no task sees all of them."""
    dealt = rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    dealt = scratch.write(name, dealt)
    by = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__{c}") for c in sums])
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each part
    starts = by.select("__part", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in ("__n", *[f"__{c}" for c in sums])])
    inside = Window.partitionBy("__part").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(starts.hint("broadcast"), "__part")  # parts rows
    return out.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        (F.col("__n") + F.row_number().over(inside)).cast("long").alias("nth"),
        *[(F.col(f"__{c}") + F.coalesce(F.sum(c).over(earlier), F.lit(0))).alias(f"before_{c}") for c in sums],
    )


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that no extra column of the input can clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])
