"""Bounded samples of documents with their n-gram features, and fits of them in one task, for the classifiers.

What the driver gets is a model: a weight for each bucket. Ids of any type are compared as
text; of rows that share a sampled id one counts, that of the least features, so that the
bound on ids bounds rows too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import Linear, features


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_ids(labels: DataFrame, most: int, seed: int, label: int | None = None) -> DataFrame:
    """(id, y) of at most ``most`` doc_ids of the training fold, those of the smallest hash."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
    rows = rows.groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.max("quality").cast("int").alias("y"))
    if label is not None:
        rows = rows.where(F.col("y") == label)
    return rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most)


def any_ids(docs: DataFrame, id_col: str, most: int, seed: int) -> DataFrame:
    """(id, y) of at most ``most`` ids of docs, those of the smallest hash; y is null."""
    ids = docs.select(F.col(f"`{id_col}`").cast("string").alias("id")).where("id IS NOT NULL").distinct()
    return ids.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most).withColumn("y", F.lit(None).cast("int"))


def sample_features(docs: DataFrame, picked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, part, y, x) of the documents picked; picked: (id, part, y), bounded by the samples' parameters and so
    broadcast; x: WIDTH 32-bit shares as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            x = features(rb.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([*rb.columns[:3], pa.array([r.tobytes() for r in x], pa.binary())], ["id", "part", "y", "x"])

    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.join(picked.hint("broadcast"), "id").select("id", "part", "y", "text")
    return rows.mapInArrow(run, "id string, part int, y int, x binary").groupBy("id", "part", "y").agg(F.min("x").alias("x"))


def fit_in_one_task(rows: DataFrame, fit: Callable[[np.ndarray, np.ndarray, np.ndarray], Linear | None]) -> Linear | None:
    """fit(part, y, x), in order of id, of all rows of sample_features, run by an executor. None if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [rb for rb in batches if rb.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by([("id", "ascending"), ("part", "ascending")]).combine_chunks()
        x = np.stack([np.frombuffer(r.as_py(), np.float32) for r in t.column("x")])
        model = fit(t.column("part").to_numpy(), t.column("y").to_numpy(), x)
        if model is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([model.weights.astype("<f8").tobytes()], pa.binary()), *(pa.array([float(v)]) for v in (model.bias, model.slope, model.shift))], ["w", "bias", "slope", "shift"]
            )

    found = rows.coalesce(1).mapInArrow(run, "w binary, bias double, slope double, shift double").collect()  # one row
    return Linear(np.frombuffer(found[0].w, "<f8"), found[0].bias, found[0].slope, found[0].shift) if found else None
