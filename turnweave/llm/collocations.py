"""Phrase collocations from count streams in prefix and suffix order.

Layout of external-memory estimation of n-gram models: the counts of all phrases of 1 to ``longest`` words that occur
``least`` times are one stream. Dealt and sorted by its words it is in prefix order: the phrases that begin a phrase
stand before it, those that it begins right behind it. Sorted by its words from the last to the first it is in suffix order.
A walk down a sorted stream merges the lengths in lockstep: the last phrase of k words that was passed is the first k
words of the one at hand, so that its count is known, and so is that this one extends it. No table of phrases is
hashed or searched; the walk keeps one count for each length. What a part's head needs from the parts before it, and what
it tells them, is a row for each part.

A phrase's count is no more than that of any phrase in it, so all of those are in the stream. They are counted length by length;
a phrase is counted only where a bitmap of fixed size (FILTER_BITS) says that both phrases of one word less may be
frequent. The bitmap can err by saying so where they are not, and then costs work alone; it never errs otherwise.

A phrase is left out if a longer one that holds it occurs 4 times for 5 of its own. The longer phrases that it begins
are told by the walk in prefix order; those that end with it, or hold it further in, by the walk in suffix order, which takes the
first walk's finds with it.

Defined cases: a null text is empty; a null lang is ``und``, as is a lang of that name; rows that repeat an id or a text count
each; ties are ordered by phrase in the order of its bytes; a text of any length is counted in stretches of about CHUNK bytes; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, pick, text_or_empty
from .ngrams import mix

LONGEST = 4
LEAST = 30
#: A longer phrase that occurs so many times for 100 of a phrase in it replaces it.
HELD = 80
SCALE = 2_000_000
TOP = 2000
#: Bits of the map of frequent phrases that every task gets: 8 MB.
FILTER_BITS = 1 << 26
#: Rows of a sorted stream that a task walks down, about.
PART_ROWS = 500_000
#: Parts of a lang's candidates, ranked each before they are ranked together.
SALTS = 64
#: Bytes of text that are looked at together.
CHUNK = 1 << 20

_SPLIT, _SPACE = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.int8)
_KIND[list(_SPACE)] = 1
_KIND[list(_SPLIT)] = 2
_END = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
_A = np.uint64(0x9E3779B97F4A7C15)


def _stretches(texts: Iterable[str | None], n: int) -> Iterator[list[tuple[int, bytes, int]]]:
    """Lists of (text, bytes, how many of them are its own). A long text comes in pieces that end with a word; after them
    come the next n - 1 words, so that phrases which begin in a piece are whole there."""
    more = re.compile(rb"(?:[ \t]*[^ \t.,;:!?\n\x0b\x0c\r]+){0,%d}" % (n - 1))
    held, size = [], 0
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z alone
        at = 0
        while at < len(raw):
            end = len(raw)
            if end - at > CHUNK:
                found = _END.search(raw, at + CHUNK)
                end = found.start() if found else end
            tail = more.match(raw, end).group() if end < len(raw) else b""
            held.append((i, raw[at:end] + tail, end - at))
            size += end - at
            at = end
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _word_hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def _folded(lang: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    """Hash of a phrase from those of its lang and words."""
    h = lang
    for p in parts:
        h = mix(h * _A + p)
    return h


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h % np.uint64(bits)).astype(np.int64), ((h >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)).astype(np.int64)


def _maybe(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = _probes(h, len(bitmap) * 8)
    return ((bitmap[a >> 3] >> (a & 7).astype(np.uint8)) & (bitmap[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def count_phrases(held: list[tuple[int, bytes, int]], langs: list[str], n: int, bitmap: np.ndarray | None) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(lang, phrase, count) of the phrases of n words in stretches of texts; langs: of each text. bitmap: of frequent ones of n - 1 words."""
    begin = np.concatenate(([0], np.cumsum([len(b) + 1 for _, b, _ in held])))
    buf = np.frombuffer(b"\n".join(b for _, b, _ in held) + b"\n", np.uint8)
    kind = _KIND[buf]
    inside = kind == 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    piece = np.cumsum(kind == 2, dtype=np.int32)[start]
    offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(buf[inside])])
    coded = words.dictionary_encode()
    known, word = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = sorted(set(langs))
    place = {x: i for i, x in enumerate(names)}
    of = np.array([place[langs[i]] for i, _, _ in held], np.int64)
    doc = np.searchsorted(begin, start, side="right") - 1
    own = start < begin[doc] + np.array([x for _, _, x in held], np.int64)[doc]
    lang = of[doc]

    m = max(len(word) - n + 1, 0)
    whole = piece[:m] == piece[n - 1 :][:m]
    if n > 1:
        told = _word_hashes(known)[word]
        of_lang = _word_hashes(pa.array([x.encode() for x in names], pa.binary()))[lang]
        m1 = len(word) - n + 2
        one_less = np.flatnonzero(piece[:m1] == piece[n - 2 :][:m1])
        ok = np.zeros(max(m1, 0), bool)
        ok[one_less] = _maybe(bitmap, _folded(of_lang[one_less], [told[one_less + j] for j in range(n - 1)]))
        whole &= ok[:m] & ok[1 : m + 1]
    at = np.flatnonzero(whole & own[:m])
    ids = lang[at]
    for j in range(n):
        _, first, ids = np.unique(ids * len(known) + word[at + j], return_index=True, return_inverse=True)
    if not len(at):
        return pa.array([], pa.string()), pa.array([], pa.string()), np.zeros(0, np.int64)
    rep = at[first]
    joined = [known.take(pa.array(word[rep + j])) for j in range(n)]
    phrase = joined[0] if n == 1 else pc.binary_join_element_wise(*joined, b" ")
    return pa.array(names, pa.string()).take(pa.array(lang[rep])), phrase.cast(pa.string()), np.bincount(ids)


def _counted(docs: DataFrame, n: int, bitmap) -> DataFrame:
    """(lang, phrase, f) of the phrases of n words of docs (lang, text); bitmap: a broadcast one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.frombuffer(bitmap.value, np.uint8) if bitmap else None
        for rb in batches:
            langs = rb.column(0).to_pylist()
            for held in _stretches((t.as_py() for t in rb.column(1)), n):
                lang, phrase, f = count_phrases(held, langs, n, told)
                yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(f, pa.int64())], ["lang", "phrase", "f"])

    found = docs.mapInArrow(run, "lang string, phrase string, f long")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequent_bits(rows: DataFrame, n: int, bits: int) -> bytes:
    """A map of the phrases of rows (lang, phrase), of n words each. Spark unites its longs; the driver gets ``bits`` bits at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if not rb.num_rows:
                continue
            words = pc.list_flatten(pc.split_pattern(rb.column(1).cast(pa.binary()), b" ")).dictionary_encode()
            told = _word_hashes(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)].reshape(-1, n)
            lang = rb.column(0).cast(pa.binary()).dictionary_encode()
            h = _folded(_word_hashes(lang.dictionary)[lang.indices.to_numpy(zero_copy_only=False)], list(told.T))
            bit = np.unique(np.concatenate(_probes(h, bits)))
            at, first = np.unique(bit >> 6, return_index=True)
            longs = np.bitwise_or.reduceat(np.uint64(1) << (bit & 63).astype(np.uint64), first)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(longs.view(np.int64))], ["at", "bits"])

    found = rows.select("lang", "phrase").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.astype("<i8").tobytes()


def walked(rows: pa.Table, longest: int) -> pa.Table:
    """A part of a sorted stream (n, f, v, ..) with passed: the count of its first k words for k under n, null where that
    stands before the part; reach: the largest v that extends a row; open: whether the row is the last of its length; heads: on
    the first row, for each k the largest v that extends a phrase of k words which stands before the part."""
    n, f, v = (rows.column(c).to_numpy() for c in ("n", "f", "v"))
    at, passed, heads = np.arange(len(n)), [], []
    reach, still = np.zeros(len(n), np.int64), np.zeros(len(n), bool)
    for k in range(1, longest):
        last = np.maximum.accumulate(np.where(n == k, at, -1))
        passed.append(pa.array(f[last], mask=(last < 0) | (n <= k)))
        child = n == k + 1
        known = child & (last >= 0)
        np.maximum.at(reach, last[known], v[known])
        before = v[child & (last < 0)]
        heads.append(int(before.max()) if len(before) else None)
        still[last[-1:][last[-1:] >= 0]] = True
    rows = rows.append_column("passed", pa.StructArray.from_arrays(passed, [f"k{k}" for k in range(1, longest)]))
    first = {f"k{k}": x for k, x in enumerate(heads, 1)}
    kind = pa.struct([(f"k{k}", pa.int64()) for k in range(1, longest)])
    rows = rows.append_column("heads", pa.array([first] + [None] * (len(n) - 1), kind))
    return rows.append_column("reach", pa.array(reach)).append_column("open", pa.array(still))


def walk(rows: DataFrame, scratch: Scratch, name: str, key: Column, longest: int) -> DataFrame:
    """rows (lang, n, f, v, ..), a whole stream, with passed and reach of walked(), in the order of lang and key, an array of words."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    sorted_ = rows.withColumn("key", key).repartitionByRange(parts, "lang", "key").sortWithinPartitions("lang", "key")
    sorted_ = sorted_.drop("key").withColumn("part", F.spark_partition_id())
    names = sorted_.columns
    ks = range(1, longest)
    counts = "struct<" + ", ".join(f"k{k}: bigint" for k in ks) + ">"
    fields = ", ".join(f"`{c}` {sorted_.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [rb for rb in batches if rb.num_rows]
        if held:
            yield from walked(pa.Table.from_batches(held), longest).combine_chunks().to_batches()

    found = scratch.write(name, sorted_.mapInArrow(run, f"{fields}, passed {counts}, heads {counts}, reach long, open boolean"))
    # what a part has passed last of each length, and what its head tells of phrases before it: a row a part
    by = found.where("open OR heads IS NOT NULL").groupBy("part").agg(
        *[F.max(F.when((F.col("n") == k) & F.col("open"), F.col("f"))).alias(f"tail{k}") for k in ks], *[F.max(f"heads.k{k}").alias(f"head{k}") for k in ks]
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by = by.select(
        "part", *[F.col(f"head{k}") for k in ks], *[F.last(f"tail{k}", True).over(before).alias(f"carry{k}") for k in ks],
        *[F.last(F.when(F.col(f"tail{k}").isNotNull(), F.col("part")), True).over(before).alias(f"owner{k}") for k in ks],
    )
    by = scratch.write(f"{name}-parts", by)
    told = by.select(F.explode(F.array(*[F.struct(F.col(f"owner{k}").alias("part"), F.lit(k).alias("n"), F.col(f"head{k}").alias("late")) for k in ks])).alias("t")).select("t.*")
    told = told.where("late IS NOT NULL").groupBy("part", "n").agg(F.max("late").alias("late")).withColumn("open", F.lit(True))
    out = found.join(F.broadcast(by.select("part", *[f"carry{k}" for k in ks])), "part").join(F.broadcast(told), ["part", "n", "open"], "left")  # both of a few rows a part
    passed = [F.when(F.col("n") > k, F.coalesce(F.col(f"passed.k{k}"), F.col(f"carry{k}"))).alias(f"k{k}") for k in ks]
    kept = [F.col(f"`{c}`") for c in names if c != "part"]
    return out.select(*kept, F.struct(*passed).alias("passed"), F.greatest("reach", F.coalesce("late", F.lit(0).cast("long"))).alias("reach"))


def phrase_stream(docs: DataFrame, scratch: Scratch, longest: int, least: int, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """The stream (lang, phrase, n, f) of all phrases of docs (lang, text) that occur ``least`` times, and (lang, total) words."""
    spark, bitmap, stream = docs.sparkSession, None, None
    for n in range(1, longest + 1):
        counted = _counted(docs, n, bitmap)
        level = scratch.write(f"level{n}", counted if n == 1 else counted.where(F.col("f") >= least))
        if n == 1:
            totals = scratch.write("totals", level.groupBy("lang").agg(F.sum("f").alias("total")))
            level = level.where(F.col("f") >= least)
        else:
            bitmap.destroy()
        if n < longest:
            bitmap = spark.sparkContext.broadcast(frequent_bits(level, n, bits))
        level = level.select("lang", "phrase", F.lit(n).alias("n"), "f")
        stream = level if stream is None else stream.unionByName(level)
    return stream, totals


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, top: int = TOP, held: int = HELD, scale: int = SCALE
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each lang by score. a: how often it occurs; l, r: how often the two
    parts of its worst cut do; n: all words of the lang. longest: 2 or more."""
    scratch = Scratch(docs.sparkSession, "collocations")
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    stream, totals = phrase_stream(docs.select(lang.alias("lang"), text_or_empty(text_col).alias("text")), scratch, longest, least)
    words = F.split("phrase", " ", -1)
    left = walk(stream.withColumn("v", F.col("f")), scratch, "prefix-order", words, longest)
    left = left.select("lang", "phrase", "n", "f", F.col("passed").alias("left"), F.greatest("f", "reach").alias("v"), F.col("reach").alias("right_reach"))
    both = walk(left, scratch, "suffix-order", F.reverse(words), longest).where("n > 1")

    wide = lambda c: c.cast("decimal(20,0)")
    cuts = []
    for k in range(1, longest):
        right = F.coalesce(*[F.when(F.col("n") - k == j, F.col(f"passed.k{j}")) for j in range(1, longest)])
        both = both.withColumn(f"l{k}", F.col(f"left.k{k}")).withColumn(f"r{k}", right)
        score = F.expr(f"CAST({scale} AS DECIMAL(10,0)) * CAST(f AS DECIMAL(20,0)) DIV (CAST(l{k} AS DECIMAL(20,0)) + CAST(r{k} AS DECIMAL(20,0)))")
        cuts.append(F.when(F.col("n") > k, F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))))
    longer = F.greatest("right_reach", "reach")
    kept = both.where(F.lit(100) * wide(longer) < F.lit(held) * wide(F.col("f"))).withColumn("cut", F.array_min(F.array_compact(F.array(*cuts))))
    kept = kept.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    few = kept.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    best = scratch.write("best", best.select("lang", "rank", "phrase", "a", "l", "r", "score"))
    scratch.drop_but("best", "totals")
    return best.join(totals.withColumnRenamed("total", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    """Each lang's first 2000 phrases of 2 to 4 words."""
    return collocations(pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "lang", "text"))


OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), p AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)
), g AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) AS v(k) WHERE len(w) >= k)
), f AS MATERIALIZED (
  SELECT lang, phrase, any_value(k) AS k, count(*) AS f FROM g GROUP BY lang, phrase HAVING count(*) >= 30
), n AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang
), c AS (
  SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1
), cut AS (
  SELECT lang, phrase, a, j, array_to_string(w[1 : j], ' ') AS head, array_to_string(w[j + 1 : k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS j FROM c)
), s AS (
  SELECT cut.lang, cut.phrase, a, j, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = rest
), worst AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), inner_phrases AS (
  SELECT lang, a AS longer, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM c, (VALUES (2), (3)) AS v(m) WHERE k > m)
), gone AS (
  SELECT DISTINCT lang, phrase FROM inner_phrases JOIN worst USING (lang, phrase) WHERE 100 * longer >= 80 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM worst ANTI JOIN gone USING (lang, phrase) JOIN n USING (lang) QUALIFY rank <= 2000
"""
