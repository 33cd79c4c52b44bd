"""Written tables that cut the lineage of later plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows, as JSON, up to which a table goes to every task.
MOST_BYTES = 64 << 20
_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, or below a folder of this machine where that is unset and the
    session runs here only. It goes when the driver ends, or earlier by clear()."""
    context = spark.sparkContext
    if context.applicationId not in _folders:
        found = context.getConf().get("spark.checkpoint.dir")
        if not found:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            found = f"file://{tempfile.gettempdir()}/checkpoints/turnweave"
        folder = f"{found}/tables-{context.applicationId}"
        system, path = _path(spark, folder)
        system.mkdirs(path)
        system.deleteOnExit(path)
        _folders[context.applicationId] = folder
    return _folders[context.applicationId]


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def clear(spark: SparkSession) -> None:
    """Deletes all tables that cut() has written in this application; DataFrames that read them are no longer of use."""
    folder = _folders.pop(spark.sparkContext.applicationId, None)
    if folder:
        system, path = _path(spark, folder)
        system.delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df as a written table: later plans start from it with its columns pruned and its size known, and it outlives the
    executors that made it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, most: int = 500_000, most_bytes: int = MOST_BYTES) -> DataFrame:
    """df, written once, for a join: broadcast if it has at most ``most`` rows and ``most_bytes`` bytes when measured, else merged."""
    df = cut(df)
    few = df.count() <= most
    if few:
        text = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
        few = (df.agg(F.sum(text)).first()[0] or 0) <= most_bytes
    return df.hint("broadcast" if few else "merge")
