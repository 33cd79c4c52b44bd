"""Phrases in transcripts, the graph of those said near each other, and its ranks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strings, words
from .lineage import cut, sized

LENGTHS = (2, 3)
#: Turns whose phrases are made together.
ROWS = 256
#: Each length is as many rows again.
MOST_LENGTHS = 20


def _kinds(rows: DataFrame, *names: str) -> str:
    return ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)


def _runs(t: list[str], n: int) -> list[str]:
    return list(map(" ".join, zip(*(t[i:] for i in range(n)), strict=False)))


def grams(turns: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """(conv_id, turn, pos, len, phrase): every run of as many terms. A text is cut once for all lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for at in range(0, rb.num_rows, ROWS):
                part = rb.slice(at, ROWS)
                of, pos, size, found = [], [], [], []
                for i, t in enumerate(words(part.column(2))):
                    for n in lengths:
                        more = _runs(t, n)
                        found += more
                        of.append(np.full(len(more), i))
                        pos.append(np.arange(len(more), dtype=np.int32))
                        size.append(np.full(len(more), n, np.int32))
                whose = pa.array(np.concatenate(of))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(whose), part.column(1).take(whose), pa.array(np.concatenate(pos)), pa.array(np.concatenate(size)), strings(found)], ["conv_id", "turn", "pos", "len", "phrase"]
                )

    return turns.select("conv_id", "turn", "text").mapInArrow(run, f"{_kinds(turns, 'conv_id', 'turn')}, pos int, len int, phrase string")


def phrases(turns: DataFrame, min_count: int = 5) -> DataFrame:
    """Phrases said min_count times: a gazetteer where none is given. Each task counts what it has at hand before it sends it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            seen = Counter()
            for t in words(rb.column(0)):
                for n in LENGTHS:
                    seen.update(_runs(t, n))
            yield pa.RecordBatch.from_arrays([strings(list(seen)), pa.array(list(seen.values()), pa.int64())], ["phrase", "n"])

    counted = turns.select("text").mapInArrow(run, "phrase string, n long")
    return counted.groupBy("phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).select("phrase")


def numbered(gazetteer: DataFrame) -> DataFrame:
    """(phrase, id) of a gazetteer, written: whole numbers in the order of the phrases, for use in their place."""
    return cut(gazetteer.select("phrase").distinct().orderBy("phrase").select("phrase", F.monotonically_increasing_id().alias("id")))


def link_mentions(turns: DataFrame, gazetteer: DataFrame, lengths: tuple[int, ...] | None = None, name: str = "phrase") -> DataFrame:
    """Phrases of the gazetteer in each turn, leftmost first and the longest of those that begin there; none overlap.
    lengths: in terms, of the phrases; else those that the gazetteer has. name: a column of the gazetteer that is given for a phrase, if not itself."""
    if lengths is None:
        told = gazetteer.select(F.size(F.split("phrase", " ")).alias("n")).distinct().orderBy("n").limit(MOST_LENGTHS + 1)
        lengths = tuple(r.n for r in told.collect()) or LENGTHS
        if len(lengths) > MOST_LENGTHS:
            raise ValueError(f"phrases of over {MOST_LENGTHS} lengths")
    known = sized(gazetteer.select("phrase", F.col(name).alias("name")).dropDuplicates(["phrase"]))
    hits = grams(turns, lengths).join(known, "phrase").select("conv_id", "turn", "pos", "len", "name")
    # a turn's hits in order, the longest first of those that begin at one term
    dealt = hits.repartition("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "pos", F.desc("len"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, end = None, 0
        for rb in batches:
            conv, turn, pos, size = (c.to_pylist() for c in rb.columns[:4])
            kept = []
            for i in range(rb.num_rows):
                if (conv[i], turn[i]) != last:
                    last, end = (conv[i], turn[i]), 0
                if pos[i] >= end:
                    kept.append(i)
                    end = pos[i] + size[i]
            yield rb.take(pa.array(kept, pa.int64()))

    kept = dealt.mapInArrow(run, f"{_kinds(dealt, 'conv_id', 'turn', 'pos', 'len', 'name')}")
    return kept.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.col("len").cast("long").alias("len"), F.col("name").alias("phrase"))


def near_pairs(mentions: DataFrame, reach: int = 20) -> DataFrame:
    """(src, dst, n), written: phrases that begin at most reach terms apart in a turn and how often. A mention meets those within reach only, so rows
    grow with the text."""
    near = Window.partitionBy("conv_id", "turn").orderBy("pos").rangeBetween(1, reach)
    met = mentions.select("phrase", F.collect_list("phrase").over(near).alias("others"))
    pairs = met.select("phrase", F.explode_outer("others").alias("other")).where("phrase <> other")
    return cut(pairs.groupBy(F.least("phrase", "other").alias("src"), F.greatest("phrase", "other").alias("dst")).agg(F.count(F.lit(1)).alias("n")))


def cooccurrence(mentions: DataFrame, reach: int = 20, gazetteer: DataFrame | None = None) -> DataFrame:
    """Edges between phrases that begin at most reach terms apart in a turn, with their count and
    pointwise mutual information. gazetteer: of numbered(), if mentions have its numbers for phrases."""
    edges = near_pairs(mentions, reach)
    ends = edges.select("n", F.explode(F.array("src", "dst")).alias("id"))
    degree = ends.groupBy("id").agg(F.sum("n").alias("d"))
    degree = degree.withColumn("phrase", F.col("id")) if gazetteer is None else degree.join(gazetteer, "id")
    degree = sized(degree)
    total = edges.agg(F.sum("n").alias("total"))
    x = edges.join(degree.select(F.col("id").alias("src"), F.col("d").alias("ds"), F.col("phrase").alias("a")), "src")
    x = x.join(degree.select(F.col("id").alias("dst"), F.col("d").alias("dd"), F.col("phrase").alias("b")), "dst").join(F.broadcast(total))  # total is one row
    pmi = F.ln(4.0 * F.col("n") * F.col("total") / (F.col("ds").cast("double") * F.col("dd")))
    return x.select(F.col("a").alias("src"), F.col("b").alias("dst"), "n", F.round(pmi, 5).alias("pmi"))


def rank_entities(edges: DataFrame, iters: int = 10, damping: float = 0.85) -> DataFrame:
    """PageRank over undirected edges (src, dst, n), a fixed number of rounds; every fifth and the last are written. The shares of the
    edges are dealt by src once and kept, so that a round moves sums for phrases alone."""
    both = edges.select("src", "dst", "n").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = F.sum("n").over(Window.partitionBy("src"))
    share = both.repartition(parts, "src").select("src", "dst", (F.col("n") / out).alias("share")).persist(StorageLevel.DISK_ONLY)
    ranks = share.groupBy("src").agg(F.lit(1.0).alias("rank"))
    size = ranks.count()
    ranks = ranks.select("src", (F.col("rank") / F.lit(float(max(size, 1)))).alias("rank"))
    for i in range(1, iters + 1):
        flow = share.join(ranks.hint("merge"), "src").groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("in"))
        ranks = flow.select(F.col("dst").alias("src"), (F.lit((1 - damping) / max(size, 1)) + damping * F.col("in")).alias("rank"))
        if i % 5 == 0 or i == iters:
            ranks = cut(ranks)
    share.unpersist()
    return ranks.select(F.col("src").alias("phrase"), F.round("rank", 9).alias("rank"))


def named_ranks(ranks: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """rank_entities() by phrase, of one by the numbers of numbered()."""
    return ranks.withColumnRenamed("phrase", "id").join(gazetteer, "id").select("phrase", "rank")


def centroid_classify(vectors: DataFrame, most_labels: int = 1000, learn: Column | None = None) -> DataFrame:
    """Vectors (embedding, label) by label and by the label of the nearest mean vector, counted. The means are
    those of the rows where ``learn`` holds and the others are classified; without it, all are both.
    The means go to every task, as one row; more labels than most_labels are refused."""
    rows = vectors.where("embedding IS NOT NULL AND label IS NOT NULL")
    known = rows if learn is None else rows.where(learn)
    x = known.select("label", F.posexplode("embedding").alias("dim", "x"))
    means = x.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("c"))
    means = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "c"))).alias("c"))
    if known.select("label").distinct().limit(most_labels + 1).count() > most_labels:
        raise ValueError(f"over {most_labels} labels")
    whole = means.select("label", F.transform("c", lambda y: y["c"]).alias("c")).agg(F.collect_list(F.struct("label", "c")).alias("means"))

    def distance(c):
        parts = F.zip_with("embedding", c, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
        return F.aggregate(parts, F.lit(0.0), lambda s, d: s + d)

    best = F.array_min(F.transform("means", lambda m: F.struct(distance(m["c"]).alias("d"), m["label"].alias("label"))))
    tried = rows if learn is None else rows.where(~F.coalesce(learn, F.lit(False)))
    found = tried.join(F.broadcast(whole)).select("label", best["label"].alias("predicted"))
    return found.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
