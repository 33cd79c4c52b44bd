"""Term statistics kept up to date from a stream of documents (doc_id, text)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.knowledge import term_counts
from ..operators.lineage import shared_folder

PARTS = "batch long, term string, df long, cf long"


def incremental(docs: DataFrame, target: str, checkpoint: str):
    """A streaming query that takes what is there and ends. A micro-batch writes its counts into a folder of its
    own number, over what a failed try has left there, so that a retry counts nothing twice. Documents come once."""

    def put(rows: DataFrame, batch: int) -> None:
        by = term_counts(rows).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
        by.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, target: str) -> DataFrame:
    """Documents and occurrences of each term over all micro-batches."""
    parts = spark.read.schema(PARTS).option("basePath", target).parquet(target)
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def streamed_term_stats(spark: SparkSession, path: str) -> DataFrame:
    """The statistics of a table of documents that is read as a stream. A stream takes a bare path for a folder,
    a pattern for whatever matches it; so the table's last letter is given as a pattern."""
    root = f"{shared_folder(spark)}/terms-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 64).parquet(f"{path[:-1]}[{path[-1]}]")
    incremental(stream.select("doc_id", "text"), f"{root}/parts", f"{root}/log").awaitTermination()
    return stored(spark, f"{root}/parts")
