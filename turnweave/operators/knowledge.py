"""Terms and search tables over documents (doc_id, text), one row each."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import coded_words, pieces, strings, terms, words
from .lineage import cut, sized

#: Texts whose terms are counted together.
ROWS = 256
#: Bytes of text whose pairs are counted together.
BYTES = 16 << 20
#: Bits of the map of frequent terms that every task gets: 8 MB.
BITS = 1 << 26
#: Groups of pairs: all of a stretch of text that are in one are sent as one row.
GROUPS = 1 << 12
#: Seeds that are tried until no two terms share a number.
SEEDS = 16


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, n_terms, term, tf) of each row of docs and distinct term of it; n_terms: of the row, repeats included. Terms are counted where
    the text is, so that nothing is shuffled for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for at in range(0, rb.num_rows, ROWS):
                part = rb.slice(at, ROWS)
                found, tf, n, size = [], [], [], []
                for t in words(part.column(1)):
                    c = Counter(t)
                    found += c
                    tf += c.values()
                    n.append(len(c))
                    size.append(len(t))
                whose = pa.array(np.repeat(np.arange(len(n)), n))
                sizes = pa.array(np.repeat(np.array(size, np.int64), n))
                yield pa.RecordBatch.from_arrays([part.column(0).take(whose), sizes, strings(found), pa.array(tf, pa.int64())], ["doc_id", "n_terms", "term", "tf"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_terms long, term string, tf long")


def term_counts(docs: DataFrame) -> DataFrame:
    return counted(docs).select("doc_id", "term", "tf")


def document_counts(docs: DataFrame) -> DataFrame:
    """(term, df, cf). Each task counts what it has at hand before it sends it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for at in range(0, rb.num_rows, 4 * ROWS):
                found, tf = [], []
                for t in words(rb.column(0).slice(at, 4 * ROWS)):
                    c = Counter(t)
                    found += c
                    tf += c.values()
                known = strings(found).dictionary_encode()
                code = known.indices.to_numpy()
                cf = np.bincount(code, weights=tf, minlength=len(known.dictionary)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([known.dictionary, pa.array(np.bincount(code, minlength=len(cf))), pa.array(cf)], ["term", "df", "cf"])

    counts = docs.select("text").mapInArrow(run, "term string, df long, cf long")
    return counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def term_stats(docs: DataFrame) -> DataFrame:
    """Documents and occurrences of each term, and its inverse document frequency."""
    return _stats(document_counts(docs), docs)


def _stats(counts: DataFrame, docs: DataFrame) -> DataFrame:
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(n)).select("term", "df", "cf", F.round(F.ln(F.col("n") / F.col("df")), 6).alias("idf"))  # n is one row


def stats_of(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """term_stats() of docs, from their counts (.., term, tf), a row for each document and term."""
    return _stats(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")), docs)


def weighed(rows: DataFrame, stats: DataFrame, most: int = 200_000) -> DataFrame:
    """rows (.., term, ..), a written table, with the other columns of stats (term, df, ..), which has each term once and all terms of rows. A vocabulary that is small when counted
    goes to every task. Of a larger one the terms of highest df do, as most rows have one of those, and only the rows of the others are dealt by term."""
    stats = cut(stats)
    size = stats.count()
    if size <= most:
        return rows.join(F.broadcast(stats), "term")
    often = stats.groupBy("df").agg(F.count(F.lit(1)).alias("n")).where(F.col("df") > 1)
    often = often.select("df", F.sum("n").over(Window.orderBy(F.desc("df"))).alias("n")).where(F.col("n") <= most)  # a row for each df
    bound = often.agg(F.min("df")).first()[0]
    if bound is None:
        return rows.join(stats.hint("merge"), "term")
    frequent = F.broadcast(stats.where(F.col("df") >= bound))
    rest = rows.join(frequent.select("term"), "term", "left_anti").join(stats.where(F.col("df") < bound).hint("merge"), "term")
    return rows.join(frequent, "term").unionByName(rest)


def keyphrases(docs: DataFrame, k: int = 5) -> DataFrame:
    """The k terms of highest tf-idf of each document; only each task's best rows are shuffled for that."""
    counts = cut(term_counts(docs))
    scored = weighed(counts, stats_of(counts, docs).select("term", "df", "idf")).withColumn("score", F.round(F.col("tf") * F.col("idf"), 6))
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("doc_id", "rank", "term", "tf", "score")


def _numbers(known: pa.Array, seed: int, bits: int) -> np.ndarray:
    hashes = (xxhash.xxh3_64_intdigest(w, seed) for w in known.cast(pa.binary()).to_pylist())
    return (np.fromiter(hashes, np.uint64, len(known)) >> np.uint64(64 - bits)).view(np.int64)


def numbered_terms(counts: DataFrame, bits: int = 64) -> tuple[DataFrame, int]:
    """(term, c, id), written, of counts (term, c), which has each term once, and the seed of the hash that is the id: the first by which no two of the
    terms share one."""

    def numbered(rows: DataFrame, seed: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(_numbers(rb.column(0), seed, bits))], ["term", "c", "id"])

        return cut(rows.select("term", "c").mapInArrow(run, "term string, c long, id long"))

    known = counts
    for seed in range(SEEDS):
        known = numbered(known, seed)
        if known.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).isEmpty():
            return known, seed
    raise RuntimeError(f"terms share a number of {bits} bits under each of {SEEDS} seeds")


def bitmap(ids: DataFrame) -> bytes:
    """A bit for each remainder of an id (id) divided by BITS: of fixed size, whatever the number of rows."""
    place = F.pmod("id", F.lit(BITS)) + 1  # Spark's buckets of bits begin at 1
    rows = ids.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("part"))
    out = bytearray(BITS // 8)
    for at, part in rows.toLocalIterator():
        out[(at - 1) * len(part) : at * len(part)] = part
    return bytes(out)


def occurrences(docs: DataFrame) -> DataFrame:
    """(term, c): how often each term is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for part in pieces(rb.column(0), BYTES):
                known, code, _ = coded_words(part)
                yield pa.RecordBatch.from_arrays([known, pa.array(np.bincount(code, minlength=len(known)))], ["term", "c"])

    return docs.select("text").mapInArrow(run, "term string, c long").groupBy("term").agg(F.sum("c").alias("c"))


def neighbours(docs: DataFrame, often: DataFrame, seed: int, bits: int = 64) -> DataFrame:
    """(a, b, n): how often terms of ``often`` are next to each other, by their ids in numbered_terms(); a few pairs with other terms may be there, too. What is
    sent of a pair is two numbers and a count, once for each stretch of text that has it; those of a stretch are sent as lists, one for each group of pairs."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(often))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = np.frombuffer(shared.value, np.uint8)
        for rb in batches:
            for part in pieces(rb.column(0), BYTES):
                known, code, size = coded_words(part)
                ids = _numbers(known, seed, bits)
                place = ids % BITS
                kept = (some[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)[code]
                ends = np.cumsum(size)
                first = kept.copy()
                first[ends[ends > 0] - 1] = False  # a text's last term begins no pair
                first = np.flatnonzero(first[:-1] & kept[1:])
                pair, n = np.unique(code[first] * len(known) + code[first + 1], return_counts=True)
                a, b = (ids[x] for x in np.divmod(pair, max(len(known), 1)))
                group = ((a * 31 + b) % GROUPS).astype(np.int16)
                order = np.argsort(group, kind="stable")
                groups, at = np.unique(group[order], return_index=True)
                at = pa.array(np.append(at, len(order)).astype(np.int32))
                lists = (pa.ListArray.from_arrays(at, pa.array(x[order])) for x in (a, b, n))
                yield pa.RecordBatch.from_arrays([pa.array(groups.astype(np.int64)), *lists], ["group", "a", "b", "n"])

    found = docs.select("text").mapInArrow(run, "group long, a array<long>, b array<long>, n array<long>").repartition("group")
    pairs = found.select("group", F.inline(F.arrays_zip("a", "b", "n")))
    return pairs.groupBy("group", "a", "b").agg(F.sum("n").alias("n")).select("a", "b", "n")  # not sent again, as a pair is of one group


def collocations(docs: DataFrame, min_count: int = 20, bits: int = 64) -> DataFrame:
    """Neighbouring terms found min_count times, with their pointwise mutual information. Terms are counted and numbered
    first; pairs of terms found min_count times are counted as numbers of ``bits`` bits, and only those that are left get their terms."""
    known, seed = numbered_terms(occurrences(docs), bits)
    whole = known.agg(F.sum("c").alias("total"))
    often = known.where(F.col("c") >= min_count)  # a term is found as often as any pair that has it
    a, b = (often.select(F.col("id").alias(x), F.col("term").alias(f"term_{x}"), F.col("c").alias(f"c{x}")) for x in "ab")
    x = neighbours(docs, often.select("id"), seed, bits).where(F.col("n") >= min_count).join(a, "a").join(b, "b")
    pmi = F.ln(F.col("n").cast("double") * F.col("total") / (F.col("ca").cast("double") * F.col("cb")))
    return x.join(F.broadcast(whole)).select(F.col("term_a").alias("a"), F.col("term_b").alias("b"), "n", F.round(pmi, 5).alias("pmi"))  # whole is one row


def inverted_index(docs: DataFrame, block: int = 1000) -> DataFrame:
    """Each term's documents in order, with its occurrences there, as ``doc:tf``. A row holds those of ``block``
    ids in succession, so that the list of a term that most documents hold is many rows."""
    tf = term_counts(docs).withColumn("block", F.floor(F.col("doc_id") / block).cast("long"))
    by = tf.repartition("term", "block").groupBy("term", "block").agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("p"))  # no part of a list is made before it is sent
    shown = F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["doc_id"], x["tf"])), ",")
    lists = cut(by.select("term", "block", shown.alias("postings"), F.size("p").cast("long").alias("n")))
    return weighed(lists, lists.groupBy("term").agg(F.sum("n").alias("df"))).select("term", "block", "df", "postings")


def matches(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(item_id, doc_id, n_terms, shared, score): for each query (item_id, text) and document with a term of it, the
    distinct terms of the query, those shared, and the BM25 score. Rows of no query's term go before any shuffle."""
    q = queries.select("item_id", F.array_distinct(terms(F.col("text"))).alias("t"))
    q = q.select("item_id", F.size("t").cast("long").alias("n_terms"), F.explode("t").alias("term"))
    asked = sized(q.select("term").distinct())
    every = cut(counted(docs).withColumnRenamed("n_terms", "dl"))
    rows = every.join(asked, "term", "left_semi")
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    whole = every.agg(F.sum("tf").alias("all_tokens")).join(F.broadcast(n))
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    hits = every.join(sized(q.join(df, "term")), "term").join(F.broadcast(whole))  # one row
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = k1 * (1 - b + b * F.col("dl") / (F.col("all_tokens") / F.col("n")))
    score = F.round(F.sum(idf * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)), 6)
    return hits.groupBy("item_id", "doc_id", "n_terms").agg(F.count(F.lit(1)).alias("shared"), score.alias("score"))


def best(rows: DataFrame, by: str, k: int) -> DataFrame:
    """The k rows of each item_id with the highest ``by``, ranked; ties to the smaller doc_id."""
    order = Window.partitionBy("item_id").orderBy(F.desc(by), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 5, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k documents of highest BM25 score for each query (item_id, text)."""
    return best(matches(docs, queries, k1, b), "score", k).select("item_id", "rank", "doc_id", "score")


def label_summary(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents and rates of good and toxic ones by language and source."""
    x = docs.select("doc_id", "lang", "source").join(labels, "doc_id", "left")
    return x.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), F.count("quality").alias("n_labelled"), F.round(F.avg("quality"), 6).alias("good"), F.round(F.avg("toxic"), 6).alias("toxic")
    )


def catalog(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents and characters by language, source and quality, with all subtotals. Of a document's labels the best
    counts; quality is null without any."""
    known = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = docs.select("doc_id", "lang", "source", "n_chars").join(known, "doc_id", "left")
    counted = rows.cube("lang", "source", "quality").agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))
    return counted.select("lang", "source", "quality", "level", "n", "n_chars")


def coverage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, labelled ones and characters by language, by source, and by language and quality: three groupings in one pass."""
    known = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = docs.select("doc_id", "lang", "source", "n_chars").join(known, "doc_id", "left")
    sets = rows.groupingSets([["lang"], ["source"], ["lang", "quality"]], "lang", "source", "quality")
    return sets.agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars")).select("lang", "source", "quality", "level", "n", "n_chars")


def term_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(term, df, side): the rows of term_stats() that two tables of documents share, and those that one has alone."""
    a, b = (term_stats(x).select("term", "df") for x in (before, after))
    sides = ((a.intersect(b), "both"), (a.exceptAll(b), "before"), (b.exceptAll(a), "after"))
    out = [x.withColumn("side", F.lit(name)) for x, name in sides]
    return out[0].unionByName(out[1]).unionByName(out[2])
