"""Hashed word and character n-grams of batches of texts, in numpy, and linear models over them.

A batch of texts is one byte array; hashes of words come from prefix sums of a polynomial
modulo 2**64, so that no word is a Python object. Features of a text are the shares of its
words, word pairs and byte trigrams in each hash bucket. Wide arrays are made for CHUNK bytes
at a time, also inside a text or a word; of a longer text only its bytes and one entry for each word are held whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Buckets of words, word pairs and byte trigrams.
WORDS, PAIRS, TRIGRAMS = 1024, 1024, 2048
WIDTH = WORDS + PAIRS + TRIGRAMS
#: Added to a text's number of n-grams, so that a few words do not make extreme shares.
DAMPING = 30
#: Shares are small numbers; one factor for all keeps rare n-grams from weighing as much as frequent ones.
SCALE = 30.0
#: Bytes of text that are looked at together.
CHUNK = 1 << 20
#: Texts that are looked at together.
TEXTS = 1000
_B = 0x9E3779B97F4A7C15
_BINV = pow(_B, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Batch:
    """Texts as bytes, with a space after each; words with their text, place and hash."""

    n: int
    buf: np.ndarray
    begin: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def batches(texts: list[str | None]) -> Iterator[tuple[int, Batch]]:
    """Number of the first text, and batch, of stretches of texts of about CHUNK bytes."""
    at, size, held = 0, 0, []
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if held and (size + len(b) > CHUNK or len(held) == TEXTS):
            yield at, _batch(held)
            at, size, held = i, 0, []
        held.append(b)
        size += len(b) + 1
    if held:
        yield at, _batch(held)


def _batch(raw: list[bytes]) -> Batch:
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    begin = np.concatenate(([0], np.cumsum([len(b) + 1 for b in raw])))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[buf])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    return Batch(len(raw), buf, begin, np.searchsorted(begin, start, side="right") - 1, start, end, mix(_hashes(buf, start, end)))


def _hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial of each word's bytes, summed chunk by chunk."""
    h = np.zeros(len(start), np.uint64)
    for a in range(0, len(buf), CHUNK):
        part = buf[a : a + CHUNK]
        i, j = int(np.searchsorted(end, a, side="right")), int(np.searchsorted(start, a + len(part)))
        if i == j:
            continue
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _power(_B, len(part)), dtype=np.uint64)))
        lo, hi = np.maximum(start[i:j] - a, 0), np.minimum(end[i:j] - a, len(part))
        got = (sums[hi] - sums[lo]) * _power(_BINV, len(part))[lo]
        got[:1] *= np.uint64(pow(_B, max(a - int(start[i]), 0), 1 << 64))  # only the first may have begun before
        h[i:j] += got
    return h


def slots(b: Batch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, text, bucket) of every n-gram; a kind comes in one or more parts."""
    yield 0, b.doc, (b.hash >> np.uint64(40)).astype(np.int64) % WORDS
    one = b.doc[1:] == b.doc[:-1]
    first, second = b.hash[:-1][one], b.hash[1:][one]
    pair = 1 + (mix(first * np.uint64(3) + second) >> np.uint64(40)).astype(np.int64) % (PAIRS - 1)
    yield 1, b.doc[1:][one], WORDS + np.where(first == second, 0, pair)  # a word said twice has a bucket of its own
    for a in range(0, len(b.buf) - 2, CHUNK):
        x = b.buf[a : a + CHUNK + 2].astype(np.uint32)
        tri = ((x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]) * np.uint32(2654435761)
        doc = np.repeat(np.arange(b.n), np.diff(np.clip(b.begin, a, a + len(tri))))
        inside = np.arange(a, a + len(tri)) + 3 <= b.begin[1:][doc]
        yield 2, doc[inside], WORDS + PAIRS + (tri[inside] >> np.uint32(16)).astype(np.int64) % TRIGRAMS


def features(texts: list[str | None]) -> np.ndarray:
    """A row of WIDTH shares for each text."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for at, b in batches(texts):
        counts, flat = np.zeros((3, b.n)), np.zeros((b.n, WIDTH), np.float32)
        for kind, doc, slot in slots(b):
            counts[kind] += np.bincount(doc, minlength=b.n)
            flat += np.bincount(doc * WIDTH + slot, minlength=b.n * WIDTH).reshape(b.n, WIDTH)
        share = 1 / (counts + DAMPING)
        out[at : at + b.n] = flat * np.repeat(share, (WORDS, PAIRS, TRIGRAMS), axis=0).T
    return out


@dataclass
class Linear:
    """A score for the shares of a text: bias plus weights, then a slope and shift that calibrate it."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, b: Batch) -> np.ndarray:
        counts, sums = np.zeros((3, b.n)), np.zeros((3, b.n))
        for kind, doc, slot in slots(b):
            counts[kind] += np.bincount(doc, minlength=b.n)
            sums[kind] += np.bincount(doc, weights=self.weights[slot], minlength=b.n)
        return self.bias + (sums / (counts + DAMPING)).sum(axis=0)

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -40, 40)))


def descend(grad, n: int, steps: int = 300, rate: float = 0.05) -> np.ndarray:
    """Adam from zero; grad: of n parameters."""
    w, m, v = np.zeros(n), np.zeros(n), np.zeros(n)
    for t in range(1, steps + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def calibrated(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through held-back scores (Platt)."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    n1, n0 = y.sum(), (1 - y).sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    spread = max(float(raw.std()), 1e-9)

    def grad(w):
        off = sigmoid(w[0] * raw / spread + w[1]) - goal
        return np.array([(off * raw / spread).mean(), off.mean()])

    w = descend(grad, 2, 500)
    return (float(w[0] / spread), float(w[1])) if w[0] > 0 else (1.0, 0.0)
