"""Hard negatives by an inverted multi-index with certified windows.

A vector is cut into two halves, and each half is dealt to the nearest word of that half's codebook; a pair of words is a
cell. For an anchor each word has a bound on what a half dealt to it can add to the inner product: the product with the
word plus the product of the anchor half's norm and the word's radius, the distance of its farthest half. A cell's bound is the sum of its
two words' bounds. A heap over the two lists of words, each by falling bound, gives cells by falling bound
(multi-sequence), so that when it is at a cell no vector that is left scores above that cell's bound; cells are looked at together until they
have STEP vectors. A window
(the best rows of the anchor's own label; for a positive, the best rows of other labels with a score from 80 to 100 percent of its)
is certified once it is full with scores above the bound, or ends above it; when all windows of an anchor
are certified, the search stops. What it returns is exact, whatever the codebooks are; these decide the amount of work alone.

The codebooks are fitted on at most SAMPLE vectors, those of the smallest hash, in one task; every vector is in the index. The index is made
of blocks of at most BLOCK vectors, sorted by cell, with the radii of the block, so that bounds are tight. Anchors and
blocks meet in the cells of a grid as in the exact top-k search; an anchor's windows in a block are merged by score over
all blocks. Nothing but the codebooks is broadcast.

Defined cases: a row whose label, id or vector is null, or whose vector has a null or non-finite component, takes no part.
Vectors of unequal length are padded with zeros. If ids repeat, each row is a candidate, and each row of an anchor's id an anchor
of its own; rows with the anchor's id are not its candidates. A component or a score that does not fit a long ends the
job with an error. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .topk import EXACT_DOUBLE, EXACT_LONG, grid

SCALE = 256
#: Words of a half's codebook, rounds of fitting and vectors of the fit.
WORDS, ROUNDS, SAMPLE = 16, 12, 8192
#: Vectors of a block of the index, and anchors that meet it together.
BLOCK, ANCHORS = 8192, 1024
#: Vectors that are scored together.
STEP = 1024
#: Scores of a cell of the grid.
WORK = 1 << 29
POSITIVES = NEGATIVES = 5
#: A negative's score is between these hundredths of the positive's.
FROM, UPTO = 80, 100
SEED = 12


def codebook(half: np.ndarray, words: int, rounds: int = ROUNDS) -> np.ndarray:
    """Means of k-means over rows, from rows at even steps of their order along the widest dimension."""
    if not len(half) or not half.shape[1]:
        return np.zeros((1, half.shape[1]))
    order = np.argsort(half[:, np.argmax(half.var(axis=0))], kind="stable")
    book = half[order[np.linspace(0, len(half) - 1, min(words, len(half))).astype(int)]].copy()
    for _ in range(rounds):
        near = nearest(half, book)
        for w in range(len(book)):
            mine = half[near == w]
            if len(mine):
                book[w] = mine.mean(axis=0)
    return book


def nearest(half: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book * book).sum(axis=1) - 2 * (half @ book.T), axis=1)


def _fit(rows: DataFrame, words: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks of the two halves, fitted by one task: 2 x words vectors."""
    some = rows.select("id", "v").orderBy(F.xxhash64("id", "v", F.lit(SEED)), "id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted(r for rb in batches for r in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True))
        m = _matrix([v for _, v in held]).astype(float)
        cut = m.shape[1] // 2
        books = [codebook(x, words) for x in (m[:, :cut], m[:, cut:])]
        yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([len(b) for b in books]), pa.array([b.astype("<f8").tobytes() for b in books], pa.binary())], ["half", "n", "book"])

    found = {r.half: np.frombuffer(r.book, "<f8").reshape(r.n, -1) for r in some.coalesce(1).mapInArrow(run, "half long, n long, book binary").collect()}  # two rows
    return found[0], found[1]


def _matrix(vectors: list, width: int | None = None) -> np.ndarray:
    out = np.zeros((len(vectors), width or max((len(v) for v in vectors), default=0)), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Index:
    """A block of vectors by cell: cell (i, j) has rows first[i, j] to first[i, j + 1]."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], ids: np.ndarray, labels: np.ndarray, m: np.ndarray):
        cut = books[0].shape[1]
        width = max(m.shape[1], cut + books[1].shape[1])
        m = np.pad(m, ((0, 0), (0, width - m.shape[1])))
        books = (books[0], np.pad(books[1], ((0, 0), (0, width - cut - books[1].shape[1]))))  # what the sample had not is zero there
        halves = (m[:, :cut].astype(float), m[:, cut:].astype(float))
        of = [nearest(h, b) for h, b in zip(halves, books, strict=True)]
        self.radius = [np.zeros(len(b)) for b in books]
        for r, h, b, w in zip(self.radius, halves, books, of, strict=True):
            np.maximum.at(r, w, np.sqrt(((h - b[w]) ** 2).sum(axis=1)))
        cell = of[0] * len(books[1]) + of[1]
        order = np.lexsort((ids, cell))
        self.books, self.cut, self.width = books, cut, width
        self.ids, self.labels, self.m = ids[order], labels[order], m[order]
        self.first = np.searchsorted(cell[order], np.arange(len(books[0]) * len(books[1]) + 1)).tolist()
        self.largest = float(np.abs(m.astype(float)).max(initial=0))
        self.real = self.m.astype(float)

    def steps(self, a: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """(bound, rows) of stretches of cells; the bound is that of the first, and holds for all that come later."""
        held, size, most = [], 0, 0.0
        for bound, lo, hi in self.cells(a):
            if not held:
                most = bound
            held.append(np.arange(lo, hi))
            size += hi - lo
            if size >= STEP:
                yield most, np.concatenate(held)
                held, size = [], 0
        if held:
            yield most, np.concatenate(held)

    def cells(self, a: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(bound, from, to) of the cells with rows by falling bound for anchor a."""
        lists = []
        for book, r, half in zip(self.books, self.radius, (a[: self.cut].astype(float), a[self.cut :].astype(float)), strict=True):
            bound = book @ half + np.sqrt(half @ half) * r
            order = np.argsort(-bound, kind="stable")
            lists.append((order.tolist(), bound[order].tolist()))
        (rows, one), (cols, two) = lists
        n = len(cols)
        heap, seen = [(-(one[0] + two[0]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            c = rows[i] * n + cols[j]
            if self.first[c] < self.first[c + 1]:
                # some slack, as bounds are rounded
                yield -bound + 1 + 1e-9 * abs(bound), self.first[c], self.first[c + 1]
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(rows) and y < n and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (-(one[x] + two[y]), x, y))

    def scores(self, a: np.ndarray, rows: np.ndarray) -> np.ndarray:
        large = self.width * self.largest * float(np.abs(a.astype(float)).max(initial=0))
        if large < EXACT_DOUBLE:
            return (self.real[rows] @ a.astype(float)).astype(np.int64)
        kind = np.int64 if large < EXACT_LONG else object
        return (self.m[rows].astype(kind) @ a.astype(kind)).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(scores) > k:  # all that tie with the k-th stay for the order by id
        stay = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[stay], ids[stay]
    top = np.lexsort((ids, -scores))[:k]
    return scores[top], ids[top]


def positives(index: Index, a: np.ndarray, own: int, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows of the block of the anchor's label."""
    s, i = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for bound, rows in index.steps(a):
        if len(s) == k and s[-1] > bound:
            break
        rows = rows[(index.labels[rows] == label) & (index.ids[rows] != own)]
        if len(rows):
            s, i = _best(np.concatenate((s, index.scores(a, rows))), np.concatenate((i, index.ids[rows])), k)
    return s, i


def negatives(index: Index, a: np.ndarray, own: int, label: int, windows: list[int], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each positive's score in ``windows`` the k best rows of other labels from FROM to UPTO percent of it."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
    # whole scores s with FROM * w <= 100 * s <= UPTO * w; no float, so any size is exact
    ends = [(-(-FROM * w // 100), UPTO * w // 100) for w in windows]
    left = [x for x, (low, high) in enumerate(ends) if low <= high]
    for bound, rows in index.steps(a):
        left = [x for x in left if ends[x][0] <= bound and not (len(found[x][0]) == k and found[x][0][-1] > bound)]
        if not left:
            break
        rows = rows[(index.labels[rows] != label) & (index.ids[rows] != own)]
        if not len(rows):
            continue
        s, i = index.scores(a, rows), index.ids[rows]
        for x in left:
            inside = (s >= ends[x][0]) & (s <= ends[x][1])
            if inside.any():
                found[x] = _best(np.concatenate((found[x][0], s[inside])), np.concatenate((found[x][1], i[inside])), k)
    return found


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(ids, labels, width, m): blocks of at most ``size`` vectors. The task that reads a block sorts it by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[tuple]) -> pa.RecordBatch:
            m = _matrix([v for _, _, v in held])
            ids, labels = (np.array(x, np.int64) for x in list(zip(*held, strict=True))[:2])
            return pa.RecordBatch.from_arrays([*(pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (ids, labels, m)), pa.array([m.shape[1]])], ["ids", "labels", "m", "width"])

        held = []
        for rb in batches:
            for r in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                held.append(r)
                if len(held) == size:
                    yield out(held)
                    held = []
        if held:
            yield out(held)

    return rows.select("id", "label", "v").mapInArrow(run, "ids binary, labels binary, m binary, width long")


def _met(blocks: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> DataFrame:
    """Each block with each group of anchors: (ids, labels, m, width, anchors), dealt as a grid of cells."""
    spark = blocks.sparkSession
    rows, columns = grid(n_anchors, n_rows, int(spark.conf.get("spark.sql.shuffle.partitions")), WORK)
    groups = max(rows, -(-n_anchors // ANCHORS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = anchors.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    # at most some ANCHORS in a list, as they are dealt by hash
    lists = of.groupBy("group").agg(F.collect_list(F.struct(*[F.col(c) for c in anchors.columns])).alias("anchors"))
    lists = lists.select("anchors", F.pmod(F.col("group"), F.lit(rows)).alias("r"), every(columns).alias("c"))
    dealt = blocks.select("*", F.pmod(F.xxhash64("ids"), F.lit(columns)).cast("int").alias("c"), every(rows).alias("r"))
    return dealt.join(lists.hint("merge"), ["r", "c"]).select("ids", "labels", "m", "width", "anchors")


def _searched(met: DataFrame, books, find, schema: str) -> DataFrame:
    """find(index, anchor) of each anchor that meets a block; it gives rows of the schema."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, index = None, None
        for rb in batches:
            for i in range(rb.num_rows):
                ids, labels, m, width = (c[i].as_py() for c in rb.columns[:4])
                if ids != key:
                    ids_, labels_ = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
                    key, index = ids, Index(books, ids_, labels_, np.frombuffer(m, "<i8").reshape(len(ids_), width))
                found = []
                for a in rb.column(4)[i].as_py():
                    v = np.array(a["v"], np.int64)
                    a["v"] = np.pad(v, (0, max(index.width - len(v), 0)))[: index.width]  # a dimension that the block lacks adds nothing
                    found += find(index, a)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * len(names), names)

    return met.mapInArrow(run, schema)


def mine(rows: DataFrame, anchor: Column, scratch: Scratch, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, words: int = WORDS, sample: int = SAMPLE) -> DataFrame:
    """(anchor_id, positive_id, place, rank, negative_id, positive_score, negative_score). rows: (id, label, v), written;
    anchor: a condition on id."""
    rows = scratch.write("rows", rows.withColumn("row", F.monotonically_increasing_id()))
    anchors = rows.where(anchor)
    n_rows, n_anchors = rows.count(), anchors.count()
    if not n_anchors:
        nothing = "anchor_id long, positive_id long, place int, rank int, negative_id long, positive_score long, negative_score long"
        return rows.sparkSession.createDataFrame([], nothing)
    books = _fit(rows, words, sample)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // BLOCK))
    blocks = scratch.write("blocks", _blocks(rows.repartition(parts, "row"), BLOCK))

    def best_of_label(index: Index, a: dict) -> list[tuple]:
        s, i = positives(index, a["v"], a["id"], a["label"], n_positives)
        return [(a["row"], *x) for x in zip(i.tolist(), s.tolist(), strict=True)]

    found = _searched(_met(blocks, anchors, n_rows, n_anchors), books, best_of_label, "row long, id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n_positives)
    found = scratch.write("positives", found)

    windows = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("w"))  # n_positives at most
    asked = anchors.join(windows.hint("merge"), "row").select("row", "id", "label", "v", F.transform("w", lambda x: x["score"]).alias("windows"))

    def window_rows(index: Index, a: dict) -> list[tuple]:
        got = negatives(index, a["v"], a["id"], a["label"], a["windows"], n_negatives)
        return [(a["row"], p, *x) for p, (s, i) in enumerate(got, 1) for x in zip(i.tolist(), s.tolist(), strict=True)]

    got = _searched(_met(blocks, asked, n_rows, n_anchors), books, window_rows, "row long, place long, negative_id long, negative_score long")
    order = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id")
    got = got.withColumn("place", F.col("place").cast("int")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    got = scratch.write("negatives", got)
    scratch.drop_but("rows", "positives", "negatives")
    of = found.select("row", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.select("row", F.col("id").alias("anchor_id"))
    return got.join(of.hint("merge"), ["row", "place"]).join(named.hint("merge"), "row").select("anchor_id", "positive_id", "place", "rank", "negative_id", "positive_score", "negative_score")


def labelled_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, label: Column, scale: int = SCALE) -> DataFrame:
    """(id, label, v) of the rows that take part, v of whole numbers; label: as an expression of columns id and label."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    odd = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    large = F.raise_error(F.lit("a component does not fit a long")).cast("long")
    whole = F.transform("x", lambda x: F.when(F.abs(x * scale) < 2.0**63, F.floor(x * scale).cast("long")).otherwise(large))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~odd).select("id", label.alias("label"), whole.alias("v"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of the vectors whose id is divisible by 100; where it is divisible by 7 the label is the next of ten."""
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = labelled_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label", label)
    found = mine(rows, F.col("id") % 100 == 0, Scratch(spark, "hard-negatives"))
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
