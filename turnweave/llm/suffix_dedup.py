"""Suffix-array dedup: every byte that a ``length``-byte string covers which also starts earlier goes.

Prefix doubling names the substrings at each position: the name of 2h bytes is made of the
names of h bytes there and h further on. Names up to the window length are made where the text
is; being hashes of content, they are the same in every task, so no round of renaming by a
sort over all positions is needed for the short lengths, which would shuffle some 20 bytes
for each byte of text and round. What Spark sorts and reranks is fewer positions at longer
offsets:

1. Of each ``length``-byte window, the position with the least name of ``SEED_BYTES`` bytes is
   its anchor (the leftmost of equals); windows next to each other mostly share it. Equal windows
   have equal anchors. An anchor's context is the text from the first to the end of the last of
   its windows. Contexts are ranked by their names: all but the first of equals have only
   windows that start earlier somewhere else.
2. First contexts are reranked by the names of their anchors. Those alone with it are unique.
3. The others are reranked at a longer offset: a window reaches from its anchor at least half of
   what it has besides the anchor to the right, or else to the left, so each context falls into
   two halves, named by the text up to there. Halves alone with their name are unique.
4. The windows of the others are ranked one by one, past the threshold; the first of equals stay.

A document then keeps what no window that fell covers. Names that are compared in 1 and 4 have
128 bits; in 2 and 3 a clash of shorter ones only leaves more for 4. Ties are broken by id, then text, then start.
Equal contexts meet only as map-side minima, so
a passage that a third of all documents hold is one row for each task; no task sees a group whole.
A text is looked at in chunks, and what falls and stays is told in stretches, so that a long text needs
little more memory than its own bytes.

Defined cases: a null text is empty; a null doc_id comes before all others. Rows that repeat an id are
documents of their own, one after the other in the order of a hash of their texts; of rows equal in id and text,
which are the same but for that, one counts as the first. Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick, text_or_empty

LENGTH = 100
SEED_BYTES = 24
#: Bytes of text that are looked at together.
CHUNK = 1 << 20
#: Repeated ids whose list is broadcast.
SHORT = 100_000
_A, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of a string from the names of two that cover it."""
    h = a * _A + b * _C
    return h ^ (h >> np.uint64(29))


def _double(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every stretch of ``width`` elements, by doubling its length."""
    have = 1
    while have * 2 <= width:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def reach(length: int) -> int:
    """Half of what a window has besides its anchor."""
    return (length - min(SEED_BYTES, length)) // 2


def anchors(buf: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(doc, first window, last window, anchor, its name, those of the text up to half a window's
    rest before and after it) of each anchor of the texts in buf, which start at begin."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 3
    if len(buf) < length:
        return none
    k = min(SEED_BYTES, length)
    letters = buf.astype(np.uint64) + np.uint64(1)
    name = _double(letters, k, _pair)
    packed = ((name * _C) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(name), dtype=np.uint64)
    least = (_double(packed, length - k + 1, np.minimum) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(begin)
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + length <= begin[1:][doc])
    if not len(at):
        return none
    doc, least = doc[at], least[at]
    new = np.concatenate(([True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(at)])) - 1
    place = least[first]
    half = reach(length)
    left, right = _double(letters, half + k, _pair), _double(letters, length - half, _pair)
    before = left[np.clip(place - half, 0, len(left) - 1)]  # of no use, and not used, where no window reaches so far
    after = right[np.clip(place, 0, len(right) - 1)]
    return doc[first], at[first], at[last], place, name[place], before, after


def _chunks(texts: list, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, bytes, np.ndarray]]:
    """(text, its bytes before, bytes, where each piece begins) of stretches of pieces of texts. Pieces of
    a text overlap by length - 1 bytes, so that each window is in one of them."""
    doc, before, held, size = [], [], [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(len(b) - length + 1, 1), CHUNK):
            piece = b[at : at + CHUNK + length - 1]
            if held and size + len(piece) > CHUNK:
                yield np.array(doc), np.array(before), b"".join(held), np.concatenate(([0], np.cumsum([len(x) for x in held])))
                doc, before, held, size = [], [], [], 0
            doc.append(i)
            before.append(at)
            held.append(piece)
            size += len(piece)
    if held:
        yield np.array(doc), np.array(before), b"".join(held), np.concatenate(([0], np.cumsum([len(x) for x in held])))


def _digests(raw: bytes, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """128-bit names of raw[lo:hi], as two longs each."""
    view, name = memoryview(raw), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([name(view[a:b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]), "<i8").reshape(-1, 2)


def contexts(docs: DataFrame, length: int) -> DataFrame:
    """(c1, c2, anchor, id, of, place, halves): names of each context and of its anchor, its text's
    id and hash, its first window with their number and the bytes from there to the anchor (_place), short names of its halves."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for text, ahead, raw, begin in _chunks(rb.column(2).to_pylist(), length):
                doc, lo, hi, place, anchor, before, after = anchors(np.frombuffer(raw, np.uint8), begin, length)
                c = _digests(raw, lo, hi + length)
                at = pa.array(text[doc])
                where = ((lo - begin[doc] + ahead[doc]) << 32) | ((hi - lo + 1) << 16) | (place - lo)
                halves = (before & np.uint64(0xFFFFFFFF00000000)) | (after >> np.uint64(32))
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, (c[:, 0], c[:, 1], anchor.view(np.int64))), rb.column(0).take(at), rb.column(1).take(at), pa.array(where), pa.array(halves.view(np.int64))],
                    ["c1", "c2", "anchor", "id", "of", "place", "halves"],
                )

    return docs.mapInArrow(run, f"c1 long, c2 long, anchor long, id {kind}, of long, place long, halves long")


def _packed(lo, n):
    """A stretch of starts as one long."""
    return F.shiftleft(lo.cast("long"), 32).bitwiseOR(n.cast("long"))


def _unpack(lists: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of a row's stretches, in order."""
    got = lists[i].values
    x = np.sort(got.to_numpy(zero_copy_only=False).astype(np.int64)) if got is not None else np.zeros(0, np.int64)
    return x >> 32, x & 0xFFFFFFFF


def _united(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches, given by rising starts, as ones that neither meet nor touch."""
    if not len(lo):
        return lo, hi
    reached = np.maximum.accumulate(hi)
    new = np.concatenate(([True], lo[1:] > reached[:-1]))
    return lo[new], reached[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(lo) - 1]))]


def _told(docs: DataFrame, stretches: DataFrame, how: str) -> DataFrame:
    """docs with the stretches (id, of, stretches) of their rows."""
    told = stretches.select(F.col("id").alias("__id"), F.col("of").alias("__of"), "stretches").hint("merge")
    rows = docs.join(told, F.col("id").eqNullSafe(F.col("__id")) & (F.col("of") == F.col("__of")), how)
    return rows.select("id", "of", "text", "stretches")


def windows(docs: DataFrame, open_starts: DataFrame, length: int) -> DataFrame:
    """(w1, w2, id, of, lo) of every window in the stretches of open_starts (id, of, stretches)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i in range(rb.num_rows):
                raw = (rb.column(2)[i].as_py() or "").encode("utf-8", "surrogatepass")
                lo, n = _unpack(rb.column(3), i)
                lo, hi = _united(lo, np.minimum(lo + n, len(raw) - length + 1))
                for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                    for at in range(a, b, CHUNK):
                        starts = np.arange(at, min(b, at + CHUNK))
                        w = _digests(raw, starts, starts + length)
                        row = pa.array(np.full(len(starts), i))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(w[:, 0]), pa.array(w[:, 1]), rb.column(0).take(row), rb.column(1).take(row), pa.array(starts.astype(np.int32))], ["w1", "w2", "id", "of", "lo"]
                        )

    return _told(docs, open_starts, "inner").mapInArrow(run, f"w1 long, w2 long, id {kind}, of long, lo int")


def removed(n_bytes: int, lo: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the bytes that a window covers whose start is in no kept stretch (lo, n)."""
    n_windows = max(n_bytes - length + 1, 0)
    lo, hi = _united(np.minimum(lo, n_windows), np.minimum(lo + n, n_windows))
    fell, until = np.concatenate(([0], hi)), np.concatenate((lo, [n_windows]))
    some = fell < until
    return _united(fell[some], until[some] - 1 + length)


def _told_apart(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """docs with column of, which tells texts of one id apart: a hash of the text, or 0 where an id is of one row, as
    zeros cost next to nothing in all that is shuffled; and whether any id repeats. The ids that do are broadcast if
    they are few when counted; if not, every text has its hash."""
    again = scratch.write("again-ids", docs.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("id").alias("__again"), F.lit(True).alias("__more")))
    n, told = again.count(), F.xxhash64(text_or_empty("text"))
    if not n:
        return docs.select("id", F.lit(0).cast("long").alias("of"), "text"), False
    if n > SHORT:
        return docs.select("id", told.alias("of"), "text"), True
    rows = docs.join(again.hint("broadcast"), F.col("id").eqNullSafe(F.col("__again")), "left")
    return rows.select("id", F.when(F.col("__more"), told).otherwise(F.lit(0).cast("long")).alias("of"), "text"), True


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept): the bytes left of each text, and the (start, end) of what went.
    length: under 65,536."""
    if not 0 < length < 1 << 16:
        raise ValueError("length is from 1 to 65,535")
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    kind = docs.schema[id_col].dataType.simpleString()
    docs, repeats = _told_apart(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")), scratch)
    found = contexts(docs, length)
    firsts = found.groupBy("c1", "c2").agg(F.min(F.struct("id", "of", "place", "anchor", "halves")).alias("f")).select("f.*")
    firsts = scratch.write("firsts", firsts)
    shared = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("anchor").alias("a"))
    lo = F.shiftright("place", 32).cast("int").alias("lo")
    n, gap = (F.shiftright("place", x).bitwiseAND(F.lit(0xFFFF)).cast("int").alias(y) for x, y in ((16, "n"), (0, "gap")))
    before, after = F.shiftright("halves", 32).cast("int").alias("before"), F.shiftright(F.shiftleft("halves", 32), 32).cast("int").alias("after")
    judged = firsts.join(shared.hint("merge"), F.col("anchor") == F.col("a"), "left").select("id", "of", "anchor", "a", lo, n, gap, before, after)
    whole = F.array(F.struct(F.lit(0).alias("side"), F.lit(0).alias("name"), F.col("lo").alias("lo"), F.col("n").alias("n")))
    # the windows that reach half behind the anchor begin no later than cut, the others after it
    cut = F.greatest(F.lit(0), F.least("n", F.col("gap") - reach(length)))
    halves = F.array(
        F.struct(F.lit(1).alias("side"), F.col("before").alias("name"), F.col("lo").alias("lo"), cut.alias("n")),
        F.struct(F.lit(2).alias("side"), F.col("after").alias("name"), (F.col("lo") + cut).alias("lo"), (F.col("n") - cut).alias("n")),
    )
    parts = judged.select("id", "of", "anchor", F.explode(F.when(F.col("a").isNull(), whole).otherwise(halves)).alias("h")).select("id", "of", "anchor", "h.*").where("n > 0")
    parts = scratch.write("parts", parts)
    known = parts.where("side > 0")
    shared = known.groupBy("anchor", "side", "name").agg(F.count(F.lit(1)).alias("m")).where("m > 1").drop("m").withColumn("open", F.lit(True))
    known = known.join(shared.hint("merge"), ["anchor", "side", "name"], "left").select("id", "of", "lo", "n", F.coalesce("open", F.lit(False)).alias("open"))
    judged = parts.where("side = 0").select("id", "of", "lo", "n", F.lit(False).alias("open")).unionByName(known)
    judged = scratch.write("judged", judged.select("id", "of", _packed(F.col("lo"), F.col("n")).alias("s"), "open"))
    scratch.drop("parts", "firsts")
    open_starts = judged.where("open").groupBy("id", "of").agg(F.collect_list("s").alias("stretches"))
    seen = windows(docs, open_starts, length)
    stay = seen.groupBy("w1", "w2").agg(F.min(F.struct("id", "of", "lo")).alias("f")).select("f.id", "f.of", _packed(F.col("f.lo"), F.lit(1)).alias("s"))
    stay = scratch.write("stay", stay)
    kept = judged.where("NOT open").select("id", "of", "s").unionByName(stay).groupBy("id", "of").agg(F.collect_list("s").alias("stretches"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            sizes, gone, spans, left = [], [], [], []
            for i in range(rb.num_rows):
                raw = (rb.column(2)[i].as_py() or "").encode("utf-8", "surrogatepass")
                lo, hi = (x.tolist() for x in removed(len(raw), *_unpack(rb.column(3), i), length))
                sizes.append(len(raw))
                gone.append(sum(hi) - sum(lo))
                spans.append([{"start": a, "end": b} for a, b in zip(lo, hi, strict=True)])
                left.append(b"".join(raw[a:b] for a, b in zip([0, *hi], [*lo, len(raw)], strict=True)) if lo else raw)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, span), pa.array(left, pa.binary())], ["id", "n_bytes", "n_removed", "spans", "kept"]
            )

    schema = f"id {kind}, n_bytes long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept binary"
    twice = scratch.write("twice", docs.groupBy("id", "of").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")) if repeats else None
    if not repeats or twice.isEmpty():
        return _told(docs, kept, "left").mapInArrow(run, schema)
    # of rows equal in id and text the first one's stretches are the text's; the others lose all windows
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("of") == F.col("__of"))
    keys = twice.select(F.col("id").alias("__id"), F.col("of").alias("__of"), "rows").hint("merge")
    again = docs.join(keys, same).groupBy("id", "of", "rows").agg(F.first("text").alias("text"))
    again = scratch.write("again", again)
    firsts = docs.join(keys, same, "left_anti").unionByName(again.select("id", "of", "text"))
    others = again.select("id", "of", "text", F.explode(F.sequence(F.lit(2).cast("long"), "rows")).alias("nth")).drop("nth")
    others = others.withColumn("stretches", F.lit(None).cast("array<long>"))
    return _told(firsts, kept, "left").unionByName(others).mapInArrow(run, schema)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: bytes, bytes removed, maximal removed runs, digest of the rest."""
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return dedup_spans(docs).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
