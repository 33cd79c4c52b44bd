"""Links between texts whose sets of word shingles have a Jaccard similarity of LEAST or more, by prefix filter.

Shingles are 64-bit hashes in one order, from rare to frequent. Spark counts the shingles of all texts in counters, which
shingles share by hash: one for every LOAD shingles, COUNTERS at most. Every task gets these, and a shingle stands where the power of two of its
counter, as a multiple of the mean, puts it, then by value. The counters decide the order alone and with it how much work there is, never which
pairs are found; once there are COUNTERS of them, a shingle is told to be frequent if it has twice an even share of all. Of a set of n, any other that is similar enough
holds one of its n - ceil(4n/5) + 1 first, so texts meet at those only. Pairs that length, place and number of the
shingles they met at cannot rule out are confirmed by whole sets; a text in more than HOT pairs meets them in parts.

For components a group of copies need not be all its pairs. In a first round the texts of a shingle meet one of
them, another for each shingle, and in a second round only texts that links so far have not joined
meet each other; so no link between components is lost, and a group of m copies makes some m pairs a
shingle. A shingle that many texts hold is parted over tasks as a SimHash shard is.

Defined cases: texts of fewer words than a shingle are in no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_digest
from .ngrams import batches, mix

SHINGLE = 5
#: The least similarity, in tenths.
LEAST = 8
#: Rows of whole shingles that a task holds at a time, and pairs it looks at together.
CHUNK = 1_000_000
#: The most counters of shingles (a byte each in a task), shingles for each below that, and counters that are summed together.
COUNTERS, LOAD, TOGETHER = 1 << 24, 8, 1 << 16
#: Pairs of one text that a task confirms.
HOT = 2000


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, in order."""
    low = [(t or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass") for t in texts]
    for _, b in batches(low):
        n = max(len(b.hash) - SHINGLE + 1, 0)
        gram = np.zeros(n, np.uint64)
        for i in range(SHINGLE):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + b.hash[i : i + n]
        whole = b.doc[:n] == b.doc[SHINGLE - 1 :][:n]
        doc, gram = b.doc[:n][whole], mix(gram[whole])
        order = np.lexsort((gram, doc))
        doc, gram = doc[order], gram[order]
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])))[: len(doc)]
        doc, gram = doc[new], gram[new]
        yield from np.split(gram, np.searchsorted(doc, np.arange(1, b.n)))


def prefix(n: int) -> int:
    """How many of the smallest of n shingles a similar set must meet."""
    return n - -(-LEAST * n // 10) + 1 if n else 0


def counter(shingle: np.ndarray, counters: int) -> np.ndarray:
    return (mix(shingle ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(counters)).astype(np.int64)


def classes(counts: np.ndarray, mean: float) -> np.ndarray:
    return np.floor(np.log2(np.maximum(counts / mean, 1))).astype(np.uint8)


class Order:
    """The order of shingles by the class of their counter, then by value."""

    def __init__(self, rank: np.ndarray):
        self.rank = rank

    def sorted(self, s: np.ndarray) -> np.ndarray:
        return s[np.lexsort((s, self.rank[counter(s, len(self.rank))]))]


def _sets(rows: DataFrame, shared=None) -> DataFrame:
    """(digest, n, shingles) of (digest, text): the prefix of each set in a broadcast order, or else all shingles."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value if shared else None
        for rb in found:
            sets = list(shingle_sets(rb.column(1).to_pylist()))
            cut = [order.sorted(s)[: prefix(len(s))] if order else s for s in sets]
            ends = np.concatenate(([0], np.cumsum([len(s) for s in cut]))).astype(np.int32)
            flat = np.concatenate(cut).view(np.int64) if cut else np.zeros(0, np.int64)
            held = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([len(s) for s in sets], pa.int32()), held], ["digest", "n", "shingles"])

    return rows.mapInArrow(run, "digest binary, n int, shingles array<long>")


def counted_order(rows: DataFrame, scratch: Scratch, most: int = COUNTERS) -> Order:
    """The order by the number of rows (digest, text) that hold a shingle. A task sends the counters it has used; they are summed in stretches of
    TOGETHER, and the driver gets ``most`` bytes at most, whatever the number of rows."""
    words = rows.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), " ")))).first()[0] or 0  # about as many as shingles
    counters = max(TOGETHER, min(most, 1 << (words // LOAD).bit_length()))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(counters, np.uint16)
        for rb in found:
            for s in shingle_sets(rb.column(0).to_pylist()):
                at = np.unique(counter(s, counters))  # a set's shingles that share a counter count once
                counts[at] += counts[at] < 65535
        used = np.flatnonzero(counts)
        for part in np.split(used, np.searchsorted(used, np.arange(TOGETHER, counters, TOGETHER))):
            if len(part):
                at, n = (part % TOGETHER).astype("<u2"), counts[part].astype("<u2")
                yield pa.RecordBatch.from_arrays([pa.array([int(part[0]) // TOGETHER]), *(pa.array([x.tobytes()], pa.binary()) for x in (at, n))], ["stretch", "at", "n"])

    def add(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for rb in found:
            for stretch, at, n in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                sums.setdefault(stretch, np.zeros(TOGETHER, np.uint64))[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<u2")
        for stretch, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([stretch]), pa.array([x.astype("<u8").tobytes()], pa.binary()), pa.array([int(x.sum())])], ["stretch", "n", "total"])

    parts = rows.select("text").mapInArrow(run, "stretch long, at binary, n binary").repartition("stretch")
    found = scratch.write("counts", parts.mapInArrow(add, "stretch long, n binary, total long"))
    mean = max(float(found.agg(F.sum("total")).first()[0] or 0) / counters, 1e-9)

    def classed(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches_:
            ranks = [classes(np.frombuffer(x.as_py(), "<u8"), mean).tobytes() for x in rb.column(1)]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(ranks, pa.binary())], ["stretch", "rank"])

    rank = np.zeros(counters, np.uint8)
    for r in found.select("stretch", "n").mapInArrow(classed, "stretch long, rank binary").toLocalIterator():  # a byte for each counter in all
        rank[r.stretch * TOGETHER : (r.stretch + 1) * TOGETHER] = np.frombuffer(r.rank, np.uint8)
    scratch.drop("counts")
    return Order(rank)


def _allowed(i: np.ndarray, j: np.ndarray, unit: np.ndarray, n: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Of the pairs of places i, j those that their lengths and the place of the shingle in both allow."""
    most = np.minimum(at[i], at[j]) + np.minimum(n[i] - at[i], n[j] - at[j])
    ok = ((10 + LEAST) * most >= LEAST * (n[i] + n[j])) & (10 * np.minimum(n[i], n[j]) >= LEAST * np.maximum(n[i], n[j])) & (unit[i] != unit[j])
    i, j = i[ok], j[ok]
    swap = unit[i] > unit[j]
    a, b = np.where(swap, j, i), np.where(swap, i, j)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (unit[a], unit[b], n[a], n[b])], ["a", "b", "na", "nb"])


def _hub_pairs(unit: np.ndarray, n: np.ndarray, at: np.ndarray, comp: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each shingle's texts with one of them that the shingle chooses."""
    chosen = mix(unit.view(np.uint64) ^ mix(key.view(np.uint64)))
    order = np.lexsort((chosen, key))
    unit, n, at, comp, key = (x[order] for x in (unit, n, at, comp, key))
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    hub = np.repeat(begin, np.diff(np.append(begin, len(key))))
    j = np.flatnonzero(comp != comp[hub])
    yield _allowed(hub[j], j, unit, n, at)


def _cross_pairs(unit: np.ndarray, n: np.ndarray, at: np.ndarray, comp: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each shingle's pairs of texts of different components."""
    order = np.lexsort((comp, key))
    unit, n, at, comp, key = (x[order] for x in (unit, n, at, comp, key))

    def end(new: np.ndarray) -> np.ndarray:
        begin = np.flatnonzero(np.concatenate(([True], new)))
        return np.repeat(np.append(begin[1:], len(key)), np.diff(np.append(begin, len(key))))

    other = key[1:] != key[:-1]
    run = end(other | (comp[1:] != comp[:-1]))
    count = end(other) - run
    upto = np.concatenate(([0], np.cumsum(count)))
    first = 0
    while first < len(n):
        last = max(int(np.searchsorted(upto, upto[first] + CHUNK, side="right")) - 1, first + 1)
        c = count[first:last]
        i = np.repeat(np.arange(first, last), c)
        yield _allowed(i, run[i] + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c), unit, n, at)
        first = last


def _shared(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shard, those whose shard has other rows too."""
    held, last = None, None  # a row that may be alone; the shard of the rows before, if they went on
    for rb in found:
        if held is not None:
            rb, held = pa.Table.from_batches([held, rb]).combine_chunks().to_batches()[0], None
        if not rb.num_rows:
            continue
        key = rb.column("shard").to_numpy()
        same = key[1:] == key[:-1]
        stay = np.concatenate(([key[0] == last], same)) | np.concatenate((same, [False]))
        if stay[-1]:
            last = key[-1]
        else:
            held = rb.slice(rb.num_rows - 1)
        yield rb.filter(pa.array(stay))


class SimilarSets:
    """The texts of docs with the prefixes of their sets. prints: (digest, fp) of the rows of docs."""

    def __init__(self, docs: DataFrame, prints: DataFrame, scratch: Scratch, text_col: str = "text"):
        self.scratch = scratch
        self.rows = docs.select(text_digest(text_col).alias("digest"), F.col(f"`{text_col}`").cast("string").alias("text"))
        order = docs.sparkSession.sparkContext.broadcast(counted_order(self.rows, scratch))  # COUNTERS bytes at most
        heads = _sets(self.rows, order).where("n > 0").dropDuplicates(["digest"])
        heads = scratch.write("heads", heads.withColumn("unit", F.monotonically_increasing_id()))
        order.destroy()
        of = prints.select("digest", "fp").dropDuplicates(["digest"])
        posted = heads.select("unit", "n", F.posexplode("shingles").alias("at", "shard")).repartition("shard").sortWithinPartitions("shard")
        self.posted = scratch.write("posted", posted.mapInArrow(_shared, "unit long, n int, at int, shard long"))
        self.units = scratch.write("units", heads.join(of.hint("merge"), "digest").select("unit", "digest", "fp"))
        scratch.drop("heads")

    def _met(self, joined: DataFrame | None, pairs) -> DataFrame:
        """(a, b, na, nb) units that meet at a shingle, for each; joined: (node, root) of fingerprints that links join."""
        from .simhash import MOST, _split

        if joined is None:
            posted = self.posted.withColumn("comp", F.col("unit"))
        else:
            of = self.units.join(joined.hint("merge"), F.col("fp") == F.col("node"), "left").select("unit", F.coalesce("root", "fp").alias("comp"))
            posted = self.posted.join(of.hint("merge"), "unit")
        posted = posted.select(F.struct("unit", "n", "at", "comp").alias("fp"), "shard")

        def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for rb in found:
                held.append([rb.column(c).to_numpy().astype(np.int64) for c in range(5)])
                size += rb.num_rows
                if size >= CHUNK:
                    cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                    cut = int(np.searchsorted(cols[4], cols[4][-1]))  # where the last shingle begins; it may go on
                    if cut:
                        yield from pairs(*[c[:cut] for c in cols])
                    held, size = [[c[cut:] for c in cols]], size - cut
            if size:
                yield from pairs(*[np.concatenate(c) for c in zip(*held, strict=True)])

        dealt = _split(posted, self.scratch, MOST).select("fp.unit", "fp.n", "fp.at", "fp.comp", "shard").repartition("shard").sortWithinPartitions("shard")
        return dealt.mapInArrow(run, "a long, b long, na long, nb long")

    def _confirmed(self, met: DataFrame) -> DataFrame:
        """(a, b) fingerprints, not equal, of the pairs of units that are similar by their whole sets."""
        one = lambda s: self.units.select(F.col("unit").alias(s), F.col("digest").alias(f"digest_{s}"), F.col("fp").alias(f"fp_{s}")).hint("merge")
        maybe = self.scratch.write("maybe", met.join(one("a"), "a").join(one("b"), "b").where("fp_a <> fp_b"))
        need = maybe.select(F.col("digest_a").alias("digest")).union(maybe.select("digest_b")).distinct()
        whole = self.scratch.write("whole", _sets(self.rows.join(need.hint("merge"), "digest", "left_semi").dropDuplicates(["digest"])))
        side = lambda s: whole.select(F.col("digest").alias(f"digest_{s}"), F.col("shingles").alias(f"s_{s}"))
        both = F.size(F.array_intersect("s_a", "s_b")).cast("long")
        sides = self._with(self._with(maybe, side("a"), "digest_a", "b"), side("b"), "digest_b", "a")
        sure = sides.where((10 + LEAST) * both >= LEAST * (F.col("na") + F.col("nb")))
        sure = self.scratch.write("sure", sure.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")))
        self.scratch.drop("maybe", "whole")
        return sure

    def _with(self, pairs: DataFrame, table: DataFrame, key: str, other: str) -> DataFrame:
        """pairs, written, with the row of table that has their key. A key of more than HOT pairs is as many rows of table as it needs parts, and its
        pairs are dealt to them by column ``other``. The list of such keys is broadcast if it is short."""
        from .simhash import SHORT

        hot = pairs.groupBy(F.col(key).alias("__key")).agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("__parts")).where("__parts > 1")
        hot = self.scratch.write("hot", hot)
        n = hot.count()
        if not n:
            return pairs.join(table.hint("merge"), key)
        hot = hot.hint("broadcast" if n <= SHORT else "merge")
        told = lambda rows: rows.join(hot, F.col(key) == F.col("__key"), "left").withColumn("__parts", F.coalesce("__parts", F.lit(1))).drop("__key")
        left = told(pairs).withColumn("__part", F.pmod(F.xxhash64(other), F.col("__parts")).cast("int")).drop("__parts")
        right = told(table).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
        return left.join(right.hint("merge"), [key, "__part"]).drop("__part")

    def hub_links(self) -> DataFrame:
        """Similar pairs of the first round."""
        return self._confirmed(self._met(None, _hub_pairs).distinct())

    def cross_links(self, joined: DataFrame | None = None) -> DataFrame:
        """All similar pairs of fingerprints that ``joined`` does not join; without it, all."""
        met = self._met(joined, _cross_pairs).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
        left = lambda n: F.expr(f"{n} - ({n} - ceil({LEAST} * {n} / 10) + 1)")  # noqa: E731  shingles that are not of the prefix
        most = F.col("c") + F.greatest(left("na"), left("nb"))
        return self._confirmed(met.where((10 + LEAST) * most >= LEAST * (F.col("na") + F.col("nb"))))


def similar_pairs(docs: DataFrame, prints: DataFrame, scratch: Scratch, text_col: str = "text") -> DataFrame:
    """(a, b) fingerprints, not equal, of all texts that are similar. prints: (digest, fp) of the rows of docs."""
    return SimilarSets(docs, prints, scratch, text_col).cross_links()
