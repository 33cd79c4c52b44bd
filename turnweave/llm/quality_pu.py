"""Quality classifier from positive and unlabelled texts.

Trusted positives are labelled rows of the training fold; unlabelled are any documents. A
linear model over hashed n-grams minimises the non-negative unbiased risk
``prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))`` with the logistic
loss. Where the second part is negative, its gradient is reversed. The class prior is
estimated from the same two samples, without negatives. Labelled rows of the training fold that are in
neither sample calibrate the scores; negative labels are used for nothing else.

Bounds of the fit: at most ``positives`` + ``unlabelled`` + ``calibration`` documents, those
whose id has the smallest hash, in one task; the rest of the work covers every row.

Defined cases: null and empty texts are scored like any text without n-grams; rows that repeat
an id have a row each; a null id is not held out; without positives every score is 0.5; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick
from .ngrams import SCALE, WIDTH, Linear, batches, calibrated, descend, sigmoid
from .training import any_ids, fit_in_one_task, held_out, labelled_ids, sample_features

LEAST_SCORE = 0.3
POSITIVES, UNLABELLED, CALIBRATION = 1000, 2000, 800
SEED = 9


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, decay: float = 1e-3) -> float:
    """Estimated share of positives among the unlabelled (best bin estimation, Garg et al. 2021).

    A logistic model tells one half of the two samples apart. Above any of its scores the other half
    of the unlabelled has the prior times the positives' share, or more where negatives are; so the prior is
    the ratio of the shares at the score where it, with what chance may add, is least."""
    p, p_back, u, u_back = positive[::2], positive[1::2], unlabelled[::2], unlabelled[1::2]
    if not len(p_back) or not len(u_back):
        return 0.5
    z, y = np.concatenate((p, u)), np.arange(len(p) + len(u)) < len(p)
    side = np.where(y, 0.5 / len(p), 0.5 / len(u))

    def grad(w):
        off = (sigmoid(z @ w[:-1].astype(np.float32) + w[-1]) - y) * side
        return np.append(z.T @ off.astype(np.float32) + decay * w[:-1], off.sum())

    w = descend(grad, z.shape[1] + 1, 200)[:-1]
    at, of = np.sort(p_back @ w), np.sort(u_back @ w)
    share_p = 1 - np.arange(len(at)) / len(at)
    share_u = 1 - np.searchsorted(of, at) / len(of)
    chance = sum(np.sqrt(np.log(40) / (2 * n)) for n in (len(at), len(of)))
    best = np.argmin((share_u + chance) / share_p)
    share = share_u[best] / share_p[best]
    # too high a prior takes negatives for positives; so one standard error less
    return float(np.clip(share - np.sqrt(max(share * (1 - share), 0) / len(of)), 0.05, 0.95))


def nn_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, decay: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative risk."""

    def grad(w):
        w32 = w[:-1].astype(np.float32)
        zp, zu = (positive @ w32).astype(float) + w[-1], (unlabelled @ w32).astype(float) + w[-1]
        minus = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up = -prior * sigmoid(-zp) / len(zp)
        gp, gu = -prior * sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
        if minus < 0:
            up, gp, gu = 0 * up, -gp, -gu
        whole = up + gp
        pull = positive.T @ whole.astype(np.float32) + unlabelled.T @ gu.astype(np.float32)
        return np.append(pull + decay * w[:-1], whole.sum() + gu.sum())

    w = descend(grad, positive.shape[1] + 1, steps)
    return w[:-1], float(w[-1])


def _fit(part: np.ndarray, y: np.ndarray, x: np.ndarray) -> Linear | None:
    is_p, is_u, is_c = ((part & bit) > 0 for bit in (1, 2, 4))
    if not is_p.any() or not is_u.any():
        return None
    p, u = (np.float32(SCALE) * x[mine] for mine in (is_p, is_u))
    w, bias = nn_pu(p, u, class_prior(p, u))
    model = Linear(w * SCALE, bias)
    model.slope, model.shift = calibrated(x[is_c] @ model.weights + bias, y[is_c].astype(float))
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", positives: int = POSITIVES, unlabelled: int = UNLABELLED, calibration: int = CALIBRATION) -> Linear:
    trusted = labelled_ids(labels, positives, SEED, 1).withColumn("part", F.lit(1))
    others = any_ids(docs, id_col, unlabelled, SEED).withColumn("part", F.lit(2))
    shown = labelled_ids(labels, calibration, SEED + 1).withColumn("part", F.lit(4))
    picked = trusted.unionByName(others).unionByName(shown).groupBy("id").agg(F.sum("part").cast("int").alias("part"), F.max("y").alias("y"))
    # a trusted positive does not calibrate
    picked = picked.select("id", F.when(F.col("part").bitwiseAND(1) > 0, F.col("part").bitwiseAND(3)).otherwise(F.col("part")).alias("part"), F.coalesce("y", F.lit(-1)).alias("y"))
    return fit_in_one_task(sample_features(docs, picked, id_col, text_col), _fit) or Linear(np.zeros(WIDTH), 0.0)


def score(docs: DataFrame, model: Linear, id_col: str = "doc_id", text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the calibrated probability of good quality, in place of a column of that name."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in found:
            got = [model.probability(model.raw(b)) for _, b in batches(rb.column("__text").to_pylist())]
            scores = np.concatenate(got) if got else np.zeros(0)
            kept = [rb.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores)], [*names, name])

    names = [n for n in docs.columns if n != name]
    fields = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    rows = docs.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{text_col}`").cast("string").alias("__text"))
    return rows.mapInArrow(run, f"{fields}, {name} double")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs that score ``least`` or more."""
    scored = score(docs, fit(docs, labels, id_col, text_col), id_col, text_col, "__score")
    return scored.where(F.col("__score") >= least).drop("__score")


def op9_quality_pu(spark, sf_dir: str) -> DataFrame:
    """Per document: whether its label is held out, its score and the verdict."""
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))
