"""Best-fit packing by exact-complement hashing.

Documents become token ids; those longer than a sequence are cut into full pieces, and the
first may be shorter. What is packed is the histogram of piece lengths, at most ``size``
counts whatever the corpus. The lengths at hand are indexed by single and pair sums; a triple
of a given sum is a length joined to the pairs of the rest. For each length, longest first,
the combinations that exactly fill its gap are used as often as the counts of all allow. What no combination
completes goes, longest first, into the least open gap that takes it, or opens a sequence. The
plan is a list of patterns with multiplicities, a few for each length. Pieces get ranks within
their length from sums over hash ranges, and a rank gives the sequence and the place in it by
search in the plan.

Texts are tokenised whole, once. A file that holds byte-level BPE with the common splitter and merges in
the order of their ids is run by its ranks, which gives the same ids sooner; any other file is
run by the tokenizers library as it is.

Defined cases: a null or empty text is the end id alone; rows that repeat an id are documents
of their own; extra columns are ignored; an empty table gives an empty result. If a text
holds an added token's string, the tokenizer's id for it is used.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, pick

SIZE = 1024
END = 2
RANGES = 512
# The byte-level splitter's pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Ids of the byte strings of a byte-level BPE file in which a merge's rank is its id; None for any other file."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, split = told["model"], told.get("pre_tokenizer") or {}
    plain = told.get("normalizer") is None and model.get("type") == "BPE"
    plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) != ("ByteLevel", False, True):
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that stand for themselves
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    added = {t["content"] for t in told.get("added_tokens", [])}
    vocab = {w: i for w, i in model["vocab"].items() if w not in added}
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in merged or merged != sorted(set(merged)) or len(vocab) != 256 + len(merged) or any(c not in vocab for c in byte):
        return None
    if merged and max(vocab[c] for c in byte) > merged[0]:
        return None
    return {bytes(byte[c] for c in w): i for w, i in vocab.items()}


class Encoder:
    """Ids of texts by a file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks := byte_ranks(path):
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> array:
        if self.fast and not any(s in text for s in self.added):
            return array("I", self.fast.encode_ordinary(text))
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids)


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, with_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): ids as little-endian unsigned 32-bit bytes."""
    names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for b in batches:
            rows, number, start, length, crc, raw = [], [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = encoder.ids(text or "")
                ids.append(end)
                if sys.byteorder == "big":
                    ids.byteswap()
                told = memoryview(ids).cast("B")
                at, n, k = 0, len(ids) % size or size, 0
                while at < len(ids):
                    part = told[4 * at : 4 * (at + n)]
                    rows.append(i)
                    number.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        raw.append(bytes(part))
                    at, n, k = at + n, size, k + 1
            cols = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(raw, pa.binary())] * with_ids], names)

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; uses every piece of counts. Of two plans, that of fewer sequences:
    what a new sequence has left is filled at once, by the longest that fit, or stays open for shorter ones."""
    return min((_plan(counts, size, now) for now in (False, True)), key=lambda found: sum(times for _, times in found))


def _plan(counts: dict[int, int], size: int, now: bool) -> list[tuple[tuple[int, ...], int]]:
    left = Counter({n: c for n, c in counts.items() if c})
    out: list[tuple[tuple[int, ...], int]] = []
    if left[size]:
        out.append(((size,), left.pop(size)))
    lengths = sorted((n for n in left if left[n]), reverse=True)
    pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, a in enumerate(lengths):
        for b in lengths[i:]:
            if a + b < size:
                pairs[a + b].append((a, b))

    def fillers(gap: int, most: int = 3) -> Iterator[tuple[int, ...]]:
        """Singles, pairs and triples of lengths whose sum is gap."""
        if gap in left:
            yield (gap,)
        yield from pairs.get(gap, ())
        for a in lengths if most > 2 else ():
            if a < gap <= 3 * a and left[a]:
                yield from ((a, b, c) for b, c in pairs.get(gap - a, ()) if b <= a and left[b] and left[c])

    open_at: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    gaps: list[int] = []

    def put(pattern: tuple[int, ...], gap: int, times: int) -> None:
        if times:
            if not open_at[gap]:
                insort(gaps, gap)
            open_at[gap].append((pattern, times))

    def use(pattern: tuple[int, ...], combo: tuple[int, ...], gap: int, most: int) -> int:
        """Puts combo, at most ``most`` times, behind pattern, which leaves gap; how often."""
        need = Counter(combo)
        times = min(most, *(left[m] // k for m, k in need.items()))
        put(pattern + combo, gap, times)
        for m, k in need.items():
            left[m] -= k * times
        return times

    def take(n: int) -> bool:
        """Puts n into an open gap: one that it fills, alone or with others, or else the least that takes it."""
        i = bisect_left(gaps, n)
        if i == len(gaps):
            return False
        fits = ((gap, (n, *combo)) for gap in gaps[i:] for combo in ([()] if gap == n else fillers(gap - n, 2)) if all(left[m] >= k for m, k in Counter((n, *combo)).items()))
        gap, combo = next(fits, (gaps[i], (n,)))
        pattern, times = open_at[gap].pop()
        if not open_at[gap]:
            gaps.remove(gap)
        put(pattern, gap, times - use(pattern, combo, gap - sum(combo), times))
        return True

    for n in lengths:
        while left[n] and take(n):
            pass
        for combo in fillers(size - n):
            if not left[n]:
                break
            use((), (n, *combo), 0, left[n])
        while now and left[n]:
            combo, gap, taken = (n,), size - n, Counter((n,))
            while m := next((m for m in lengths if m <= gap and left[m] > taken[m]), 0):
                combo, gap = (*combo, m), gap - m
                taken[m] += 1
            use((), combo, gap, left[n])
        if left[n]:  # new sequences
            each = size // n
            use((), (n,) * each, size - n * each, left[n])
            if left[n]:
                use((), (n,) * left[n], size - n * left[n], 1)
    return out + [p for gap in gaps for p in open_at[gap]]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first sequence and offset of each stretch of its pieces."""
    table: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    given: Counter = Counter()
    first = 0
    for pattern, times in patterns:
        at = 0
        for n in pattern:
            table[n].append((given[n], first, at))
            given[n] += times
            at += n
        first += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for n, rows in table.items()}


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, with_ids: bool = True) -> DataFrame:
    """Every piece with its sequence_id and offset there; with_ids keeps the ids themselves."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut = pieces(docs, path, id_col, text_col, size, end, with_ids)
    key = F.xxhash64("id", "piece", "start", "ids_crc32")
    cut = scratch.write("pieces", cut.withColumn("key", key).withColumn("rng", F.shiftrightunsigned("key", 64 - RANGES.bit_length() + 1)))
    by = scratch.write("counts", cut.groupBy("length", "rng").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in by.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size rows
    table = slots(plan(histogram, size))
    upto = Window.partitionBy("length").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    before = by.select("length", "rng", F.coalesce(F.sum("n").over(upto), F.lit(0)).cast("long").alias("before"))
    inside = Window.partitionBy("length", "rng").orderBy("key", "id", "piece")
    ranked = cut.withColumn("nth", F.row_number().over(inside) - 1)
    ranked = ranked.join(before.hint("merge"), ["length", "rng"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before", "nth", "key", "rng")
    names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                mine = length == n
                starts, firsts, offsets = table[n]
                at = np.searchsorted(starts, rank[mine], side="right") - 1
                seq[mine], off[mine] = firsts[at] + rank[mine] - starts[at], offsets[at]
            cols = {"sequence_id": pa.array(seq), "offset": pa.array(off)}
            yield pa.RecordBatch.from_arrays([cols.get(n, b.column(n) if n not in cols else None) for n in names], names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids
    return ranked.mapInArrow(place, schema)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """Per piece of a document: where it stands in its document and in which sequence it is put."""
    import public_tokenizers

    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).withColumnRenamed("id", "doc_id")
