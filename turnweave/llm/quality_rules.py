"""Quality rules: counted rules and a hashed n-gram logistic regression, against fixed thresholds.

The regression is trained on at most ``sample`` labelled quality rows of the training fold,
those whose id has the smallest hash, by one task; a fifth of them is held back to calibrate its
probabilities. Every text is scored whole, in Arrow batches.

Defined cases: a null or empty text has no words and fails the rules; rows that repeat an id
have a row each; without labels of both kinds the rules alone decide; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick
from .ngrams import _SPACE, SCALE, Batch, Linear, batches, calibrated, descend, mix, sigmoid
from .training import fit_in_one_task, labelled_ids, sample_features

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # in hundredths of the words
LEAST_PROBABILITY = 0.3
SAMPLE = 3000
SEED = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACES = " \t\n\v\f\r"


def repeated_words(b: Batch) -> np.ndarray:
    """For each text, its words in windows of WINDOW words that are found twice or more in it."""
    n = len(b.hash) - WINDOW + 1
    if n <= 0:
        return np.zeros(b.n, np.int64)
    gram = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + b.hash[i : i + n]
    gram = mix(gram ^ mix(b.doc[:n].astype(np.uint64) + np.uint64(1)))
    whole = np.flatnonzero(b.doc[:n] == b.doc[WINDOW - 1 :])
    order = whole[np.argsort(gram[whole], kind="stable")]
    same = gram[order][1:] == gram[order][:-1]
    twice = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))] if len(order) else order
    mark = np.zeros(len(b.hash) + 1, np.int64)
    np.add.at(mark, twice, 1)
    np.add.at(mark, twice + WINDOW, -1)
    return np.bincount(b.doc, weights=np.cumsum(mark)[:-1] > 0, minlength=b.n).astype(np.int64)


def repeated_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return len(lines) - len(set(lines))


def rule_counts(b: Batch) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_repeat_words of each text."""
    words = np.bincount(b.doc, minlength=b.n).astype(np.int64)
    begins = ((b.buf & 0xC0) != 0x80) & ~_SPACE[b.buf]
    chars, symbols = (np.add.reduceat(x, b.begin[:-1], dtype=np.int64) for x in (begins, _SYMBOL[b.buf]))
    return [words, chars, symbols, repeated_words(b)]


def _fit(part: np.ndarray, y: np.ndarray, x: np.ndarray) -> Linear | None:
    if y.min() == y.max():
        return None
    back = np.arange(len(y)) % 5 == 4
    z, goal = np.float32(SCALE) * x[~back], y[~back].astype(float)
    side = np.where(goal == 1, 0.5 / max(goal.sum(), 1), 0.5 / max((1 - goal).sum(), 1))

    def grad(w):
        off = (sigmoid(z @ w[:-1].astype(np.float32) + w[-1]) - goal) * side
        return np.append(z.T @ off.astype(np.float32) + 1e-3 * w[:-1], off.sum())

    w = descend(grad, z.shape[1] + 1)
    model = Linear(w[:-1] * SCALE, float(w[-1]))
    model.slope, model.shift = calibrated(x[back] @ model.weights + model.bias, y[back].astype(float))
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Linear | None:
    """The calibrated model, or None without labels of both kinds."""
    picked = labelled_ids(labels, sample, SEED).select("id", F.lit(0).alias("part"), "y")
    return fit_in_one_task(sample_features(docs, picked, id_col, text_col), _fit)


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"


def apply_rules(docs: DataFrame, model: Linear | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, base_failed, quality, kept) of every row; quality is null without a model."""
    names = ["id", *[f.split()[0] for f in SCHEMA.split(", ")]]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in found:
            texts = rb.column(1).to_pylist()
            cols: list[list] = [[] for _ in range(5)]
            for _, b in batches(texts):
                for held, got in zip(cols, [*rule_counts(b), model.probability(model.raw(b)) if model else np.full(b.n, np.nan)], strict=True):
                    held.append(got)
            if not texts:
                continue
            words, chars, symbols, repeats, p = (np.concatenate(c) for c in cols)
            failed = (words < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * words)
            kept = ~failed & ((p >= LEAST_PROBABILITY) | np.isnan(p))
            lines = np.array([repeated_lines(t) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([rb.column(0), *map(pa.array, (words, chars, symbols, lines, repeats, failed)), pa.array(p, from_pandas=True), pa.array(kept)], names)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, {SCHEMA}")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Per document: the rules' counts, whether they fail it, and the verdict."""
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return apply_rules(docs, model).withColumnRenamed("id", "doc_id")
