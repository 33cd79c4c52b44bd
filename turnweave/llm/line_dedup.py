"""Line dedup: hashes dealt by range, ordered by document and position within a hash,
first occurrences streamed off by a window, decisions returned as run-length keep bitmaps.

Only DataFrame functions. A line's hash is the MD5 of its key, so that text is read
but not shuffled to decide; hashes are summed per document and per bucket of documents
before they are dealt by range, so a line that a third of all documents share arrives
as at most ``BUCKETS`` rows, and meets its lines bucket by bucket. A document's bitmap is the list
of the places where kept lines turn to dropped ones or back, kept first; texts are cut by it.

Defined cases: a null or empty text is one empty line. Rows that share a doc_id count
as one document in the counting, but lose lines by their own text; a null doc_id is an
id of its own and sorts first.
Columns of the input other than id and text are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, SPACES, UPPER, Scratch, pick, text_digest, text_or_empty

BUCKETS = 64


def line_key(line: Column) -> Column:
    """The line without outer white space, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, digest, pos, hash, bucket) of every line whose key has min_chars code points."""
    # outer, as the filter that Spark infers for the other would split every text a second time; there always is a line
    rows = docs.select("id", "digest", F.posexplode_outer(F.split("text", "\n", -1)).alias("pos", "line"))
    rows = rows.select("id", "digest", "pos", line_key(F.col("line")).alias("key"))
    rows = rows.where(F.length("key") >= min_chars)
    bucket = F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")
    return rows.select("id", "digest", "pos", F.unhex(F.md5("key")).alias("hash"), bucket.alias("bucket"))


def repeated_lines(lines: DataFrame, min_docs: int, partitions: int | None = None) -> DataFrame:
    """(hash, bucket, n_docs, first_id, first_pos) of each hash found in min_docs documents, for each bucket it is in."""
    per_doc = lines.groupBy("hash", "bucket", "id").agg(F.min("pos").alias("pos"))
    part = per_doc.groupBy("hash", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "pos")).alias("first"))
    dealt = part.repartitionByRange(*([partitions] if partitions else []), "hash")
    in_order = Window.partitionBy("hash").orderBy("first")
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        dealt.withColumn("n_docs", F.sum("n").over(whole))
        .withColumn("least", F.first("first").over(whole))
        .where(F.col("n_docs") >= min_docs)
        .select("hash", "bucket", "n_docs", F.col("least.id").alias("first_id"), F.col("least.pos").alias("first_pos"))
    )


def _edges(dropped: Column) -> Column:
    """Where runs of dropped lines start and end, in turn: the bitmap as places.

    A run starts at every dropped line whose predecessor is kept and ends where the next is kept."""
    starts = F.filter(dropped, lambda p, i: ~F.get(dropped, i - 1).eqNullSafe(p - 1))
    stops = F.filter(dropped, lambda p, i: ~F.get(dropped, i + 1).eqNullSafe(p + 1))
    return F.flatten(F.zip_with(starts, stops, lambda p, q: F.array(p, q + 1)))


def _runs(dropped: Column, n_lines: Column) -> Column:
    """Lengths of alternating runs of kept and dropped lines, kept first: the bitmap, run-length coded."""
    return _lengths(_edges(dropped), n_lines)


def _lengths(edges: Column, n_lines: Column) -> Column:
    runs = F.zip_with(F.concat(F.array(F.lit(0)), edges), F.concat(edges, F.array(n_lines)), lambda p, q: q - p)
    return F.filter(runs, lambda n, i: (i == 0) | (n > 0))


def keep_bitmaps(
    docs: DataFrame,
    scratch: Scratch,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 1,
    min_docs: int = 10,
    keep_first: bool = False,
) -> DataFrame:
    """(id, digest, edges): for each id and text that loses lines, its bitmap.

    keep_first leaves the first occurrence of each repeated line where it is."""
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), text_digest(text_col).alias("digest"), text_or_empty(text_col).alias("text"))
    lines = scratch.write("lines", _lines(docs, min_chars))
    bad = scratch.write("repeated", repeated_lines(lines, min_docs))
    hits = lines.join(bad.hint("merge"), ["hash", "bucket"])
    if keep_first:
        first = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("pos") == F.col("first_pos"))
        least = hits.where(first).groupBy("hash", "bucket").agg(F.min("digest").alias("first_digest"))  # of texts with the same id
        hits = hits.join(least.hint("merge"), ["hash", "bucket"], "left")
        hits = hits.where(~(first & (F.col("digest") == F.col("first_digest"))))
    by = hits.groupBy("id", "digest").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    return by.select("id", "digest", _edges(F.col("dropped")).alias("edges"))


def cut_by(lines: Column, edges: Column) -> Column:
    """The kept lines of an array of lines, joined by newlines."""
    starts = F.concat(F.array(F.lit(0)), F.filter(edges, lambda p, i: i % 2 == 1))
    stops = F.concat(F.filter(edges, lambda p, i: i % 2 == 0), F.array(F.size(lines)))
    return F.array_join(F.flatten(F.zip_with(starts, stops, lambda p, q: F.slice(lines, p + 1, q - p))), "\n")


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 1,
    min_docs: int = 10,
    keep_first: bool = False,
    report: bool = True,
) -> DataFrame:
    """All columns of docs, with text replaced by the kept lines joined by newlines. With report also
    n_lines, n_dropped and keep_runs, the run-length coded bitmap of kept lines, in place of columns of
    those names."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    decided = scratch.write("decided", keep_bitmaps(docs, scratch, id_col, text_col, min_chars, min_docs, keep_first))
    scratch.drop("lines", "repeated")
    decided = decided.select(F.col("id").alias("__id"), F.col("digest").alias("__of"), F.col("edges").alias("__edges"))
    docs = docs.withColumn("__digest", text_digest(text_col))
    same = docs[f"`{id_col}`"].eqNullSafe(decided["__id"]) & (docs["__digest"] == decided["__of"])
    kept = docs.join(decided.hint("merge"), same, "left").drop("__id", "__of", "__digest")
    kept = kept.withColumn("__lines", F.split(text_or_empty(text_col), "\n", -1))
    text = F.when(F.col("__edges").isNull(), text_or_empty(text_col)).otherwise(cut_by(F.col("__lines"), F.col("__edges")))
    if report:
        edges = F.coalesce("__edges", F.array().cast("array<int>"))
        odd = F.aggregate(F.transform(edges, lambda p, i: F.when(i % 2 == 1, p).otherwise(-p)), F.lit(0), lambda a, p: a + p)
        kept = kept.withColumn("n_lines", F.size("__lines").cast("long")).withColumn("n_dropped", odd.cast("long"))
        kept = kept.withColumn("keep_runs", _lengths(edges, F.size("__lines")))
    return kept.withColumn(text_col, text).drop("__edges", "__lines")


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: lines, lines dropped, digest of what is left."""
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return dedup_lines(docs, min_chars=1, min_docs=10).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"), F.to_json("keep_runs").alias("keep_runs")
    )


OP7_SQL = r"""
WITH lines AS (
  SELECT d.doc_id, p.pos, string_split(coalesce(d.text, ''), chr(10))[p.pos] AS line
  FROM documents d, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(d.text, ''), chr(10))) + 1)) AS pos) p
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), bad AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), judged AS (
  SELECT k.doc_id, k.pos, k.line, b.key IS NOT NULL AS bad FROM keyed k LEFT JOIN bad b ON k.key = b.key
), changes AS (
  SELECT *, CASE WHEN bad IS DISTINCT FROM lag(bad, 1, false) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS edge
  FROM judged
), numbered AS (
  SELECT *, sum(edge) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM changes
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM numbered GROUP BY doc_id, run
), bitmaps AS (
  SELECT doc_id, '[' || CASE WHEN min(run) = 1 THEN '0,' ELSE '' END || string_agg(n::VARCHAR, ',' ORDER BY run) || ']' AS keep_runs
  FROM runs GROUP BY doc_id
)
SELECT j.doc_id, count(*) AS n_lines, count(*) FILTER (bad) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN NOT bad THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256,
  any_value(keep_runs) AS keep_runs
FROM judged j JOIN bitmaps m ON m.doc_id = j.doc_id GROUP BY j.doc_id
"""
