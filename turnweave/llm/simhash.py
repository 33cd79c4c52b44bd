"""SimHash near-dedup: BK-trees over fingerprints, in shards that no link can miss.

A fingerprint has 64 bits; two that differ in ``radius`` bits agree on at least ``agree``
of ``radius + agree`` bit blocks, so every choice of ``agree`` blocks and their bits is a
shard, and linked fingerprints share one. Each shard holds a BK-tree: a node's children
are keyed by their Hamming distance to it, and a search follows only edges within the
radius of the distance it has found. The trees of a partition are built and searched level
by level in numpy. A shard returns a star for each of its components, not its pairs;
alternating stars join them over shards.

The trees are dealt out by shard instead of broadcast, as all of them together grow with
the corpus. Copies are one fingerprint before anything is dealt. A shard of over MOST
fingerprints is parted by hash, and each two parts are a shard in its place; a task reads
its shards in order and holds some CHUNK rows at a time.

Defined cases: null or empty texts have fingerprint zero and are linked like others; a null
doc_id keeps its row, and its component's id is the smallest id that is not null; rows that
repeat a doc_id have a row each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick, text_digest
from .near_sets import SimilarSets
from .stars import components, with_least

SHINGLE = 4
RADIUS = 4
AGREE = 2
SEED = 42
#: Pairs of query and node that are looked at together.
FRONTIER = 2_000_000
#: Fingerprints of a shard beyond which it is split over tasks.
MOST = 50_000
#: Large shards whose list is broadcast.
SHORT = 100_000
#: Parts of the rows of one fingerprint.
PARTS = 128
#: Rows of whole shards that a task holds at a time.
CHUNK = 1_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; a bit is set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, digest: bool = False) -> DataFrame:
    """(id, fp) of every row, with digest also that of its text; fp is the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], ["id", "fp", *b.schema.names[2:]])

    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *([text_digest(text_col).alias("digest")] if digest else [])
    )
    return rows.mapInArrow(run, f"id {kind}, fp long" + ", digest binary" * digest)


def _blocks(n: int) -> list[tuple[int, int]]:
    """First bit and width of n blocks that part 64 bits."""
    at = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def build_trees(fp: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, ...]:
    """BK-trees over distinct fingerprints, one for each shard, all grown level by level.
    Returns each item's root, its edge's distance, and its children as a range of ``kids``."""
    n = len(fp)
    parent, edge, root = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    cur, key, first_level = np.arange(n), shard, True
    above = np.full(n, -1)
    dist = np.zeros(n, np.int64)
    while len(cur):
        order = np.argsort(key, kind="stable")
        cur, key, above, dist = cur[order], key[order], above[order], dist[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        node = cur[np.flatnonzero(new)][np.cumsum(new) - 1]
        if first_level:
            root[cur], first_level = node, False
        parent[cur[new]], edge[cur[new]] = above[new], dist[new]
        rest = ~new
        cur, above = cur[rest], node[rest]
        dist = np.bitwise_count(fp[cur] ^ fp[above]).astype(np.int64)
        key = above * 65 + dist
    kids = np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[kids], np.arange(n))
    count = np.searchsorted(parent[kids], np.arange(n), side="right") - first
    return root, edge, kids, first, count


def shard_stars(fp: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each item linked to others of its shard: itself and the root of its component there."""
    root, edge, kids, first, count = build_trees(fp, shard)
    label = np.arange(len(fp))

    def join(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            la, lb = label[a], label[b]
            off = la != lb
            a, b, la, lb = a[off], b[off], la[off], lb[off]
            if len(a):
                np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
                while not np.array_equal(up := label[label], label):
                    label[:] = up

    todo = [(np.arange(at, min(at + 65536, len(fp))), None) for at in range(0, len(fp), 65536)]
    while todo:
        q, at = todo.pop()
        if at is None:
            at = root[q]
        if len(q) > FRONTIER:
            half = len(q) // 2
            todo += [(q[:half], at[:half]), (q[half:], at[half:])]
            continue
        d = np.bitwise_count(fp[q] ^ fp[at]).astype(np.int64)
        hit = (d <= radius) & (q != at)
        join(q[hit], at[hit])
        n = count[at]
        q2, d2 = np.repeat(q, n), np.repeat(d, n)
        kid = kids[np.repeat(first[at], n) + np.arange(len(q2)) - np.repeat(np.cumsum(n) - n, n)]
        near = np.abs(edge[kid] - d2) <= radius
        if near.any():
            todo.append((q2[near], kid[near]))
    off = np.flatnonzero(label != np.arange(len(fp)))
    return off, label[off]


def _linked(fp: np.ndarray, shard: np.ndarray, radius: int) -> pa.RecordBatch:
    """The stars of whole shards."""
    order = np.lexsort((fp, shard))
    fp, shard = fp[order], shard[order]
    lone = np.concatenate(([True], shard[1:] != shard[:-1])) & np.concatenate((shard[1:] != shard[:-1], [True]))
    fp, shard = fp[~lone], shard[~lone]
    a, b = shard_stars(fp.view(np.uint64), shard, radius)
    pairs = np.unique(np.stack((fp[a], fp[b]), axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _split(rows: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """(fp, shard) with shards of over ``most`` fingerprints as smaller ones: of its parts, each two are a shard,
    so that any two fingerprints still meet and no shard is much over ``most``. The list of such shards is
    broadcast if it is short."""
    large = scratch.write("large", rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most))
    n = large.count()
    if not n:
        return rows
    large = large.hint("broadcast" if n <= SHORT else "merge")
    parts = F.when(F.col("n").isNull(), 1).otherwise(F.ceil(2 * F.col("n") / most)).cast("int")
    x = rows.join(large, "shard", "left").select("fp", "shard", parts.alias("parts"))
    x = x.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: j != F.col("own"))
    cells = F.transform(others, lambda j: F.xxhash64("shard", F.least(j, "own"), F.greatest(j, "own")))
    return x.select("fp", F.explode(F.when(F.col("parts") == 1, F.array("shard")).otherwise(cells)).alias("shard"))


def near_links(distinct: DataFrame, scratch: Scratch, radius: int = RADIUS, agree: int = AGREE, most: int = MOST) -> DataFrame:
    """(a, b) edges between distinct fingerprints (column fp) that connect just what links within radius connect."""
    parts = _blocks(radius + agree)
    keys = []
    for i, chosen in enumerate(combinations(parts, agree)):
        mask = sum(((1 << w) - 1) << at for at, w in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("bits")))
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("shard")).select("fp", F.xxhash64("shard").alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append([b.column(c).to_numpy() for c in ("fp", "shard")])
            n += b.num_rows
            if n >= CHUNK:
                fp, shard = map(np.concatenate, zip(*held, strict=True))
                cut = int(np.searchsorted(shard, shard[-1]))  # where the last shard begins; it may go on
                if cut:
                    yield _linked(fp[:cut], shard[:cut], radius)
                held, n = [[fp[cut:], shard[cut:]]], n - cut
        if n:
            yield _linked(*map(np.concatenate, zip(*held, strict=True)), radius)

    return _split(rows, scratch, most).repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, agree: int = AGREE, digest: bool = False, similar: bool = False
) -> DataFrame:
    """(id, fp, component) of every row, with digest also that; component: the smallest id that links reach from it.
    With similar (which needs digest) also texts of similar shingle sets are linked."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = fingerprints(docs, id_col, text_col, shingle, digest).withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int"))
    prints = scratch.write("prints", prints)
    # a fingerprint's rows in parts, so that many copies are not one key
    parts = scratch.write("parts", prints.groupBy("fp", "part").agg(F.min("id").alias("rep")))
    reps = scratch.write("reps", parts.groupBy("fp").agg(F.min("rep").alias("rep")))
    links = near_links(reps.select("fp"), scratch, radius, agree)
    sets = SimilarSets(docs, prints, scratch, text_col) if similar else None
    roots = scratch.write("roots", components(links.unionByName(sets.hub_links()) if sets else links, scratch))
    if sets:
        edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(sets.cross_links(roots))
        roots = scratch.write("roots", components(edges, scratch))
    joined = reps.join(roots.hint("merge"), reps["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    joined = scratch.write("rooted", joined)
    scratch.drop_but("prints", "parts", "rooted")
    by_fp = with_least(joined, "root", "rep", "fp", "component").select("fp", "component")
    by_part = parts.select("fp", "part").join(by_fp.hint("merge"), "fp")
    found = prints.join(by_part.hint("merge"), ["fp", "part"])
    return found.select("id", "fp", *["digest"] * digest, "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: bool = False) -> DataFrame:
    """The rows whose id is the smallest of the component of their text; rows without an id stay. similar: see near_duplicates."""
    scratch = Scratch(docs.sparkSession, "simhash-keep")
    found = near_duplicates(docs, id_col, text_col, digest=True, similar=similar).where("id <> component")
    gone = scratch.write("gone", found.select(F.col("id").alias("__gone"), F.col("digest").alias("__of")).distinct())
    return docs.join(gone.hint("merge"), (docs[f"`{id_col}`"] == gone["__gone"]) & (text_digest(text_col) == gone["__of"]), "left_anti")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """Per document: its fingerprint and the smallest id of its component."""
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return near_duplicates(docs).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )
