"""Approximate nearest vectors by random hyperplanes: multi-probe buckets, then an exact order of what they hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .related import rounded

TABLES, BITS = 24, 8
#: Components are whole numbers of this part of one, so that sides of planes and products are exact.
SCALE = 1 << 20
#: Vectors of a block.
BLOCK = 1024
_PARTS, _KINDS = ("ids", "at", "v", "norm", "sig"), ("<i8", "<i8", "<f8", "<f8", "<i8")


def signs(tables: int, bits: int, width: int) -> np.ndarray:
    """Planes of 1 and -1, a row for each bit of each table; each component is a hash of its number."""
    x = np.arange(tables * bits * width, dtype=np.int64)
    for shift, factor in ((15, 739982445), (13, 695872825), (16, 739982445)):
        x = (x + 12345) * factor % (1 << 32)
        x ^= x >> shift
    return np.where(x & 1, 1, -1).reshape(tables * bits, width)


def whole(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, norm) of vectors that are not null or zero and have only finite components, as whole numbers."""
    x = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where("id IS NOT NULL AND x IS NOT NULL")
    x = x.where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    v = x.select("id", F.transform("x", lambda c: F.floor(c * SCALE).cast("long")).alias("v"))
    return v.withColumn("norm", F.sqrt(_dot("v", "v"))).where("norm > 0")


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def signatures(rows: DataFrame, tables: int = TABLES, bits: int = BITS) -> DataFrame:
    """rows with sig: for each table the sides of its planes on which v is, a bit each."""
    names = rows.columns
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            sig = np.zeros((rb.num_rows, tables), np.int64)
            lists = rb.column(names.index("v"))
            widths = lists.value_lengths().to_numpy()
            for w in np.unique(widths):  # one, as a rule
                mine = np.flatnonzero(widths == w)
                m = lists.take(pa.array(mine)).flatten().to_numpy().reshape(len(mine), w)
                side = (m @ signs(tables, bits, int(w)).T >= 0).reshape(len(mine), tables, bits)
                sig[mine] = (side.astype(np.int64) << np.arange(bits)).sum(axis=2)
            held = pa.ListArray.from_arrays(pa.array(np.arange(rb.num_rows + 1, dtype=np.int32) * tables), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([*rb.columns, held], [*names, "sig"])

    return rows.mapInArrow(run, f"{fields}, sig array<bigint>")


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(ids, at, v, norm, sig) of rows (ids, v, norm, sig): blocks of at most ``size`` vectors of one length; the ids of vector i are those from at[i] to at[i + 1]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            widths = rb.column(1).value_lengths().to_numpy()
            for w in np.unique(widths):
                mine = np.flatnonzero(widths == w)
                for at in range(0, len(mine), size):
                    ids, v, norm, sig = rb.take(pa.array(mine[at : at + size])).columns
                    ends = np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy())))
                    parts = zip((ids.flatten(), pa.array(ends), v.flatten(), norm, sig.flatten()), _KINDS, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([x.to_numpy(zero_copy_only=False).astype(kind).tobytes()], pa.binary()) for x, kind in parts], list(_PARTS))

    return rows.select("ids", "v", "norm", "sig").mapInArrow(run, ", ".join(f"{p} binary" for p in _PARTS))


def _read(parts: list[bytes], tables: int) -> tuple[np.ndarray, ...]:
    ids, at, v, norm, sig = (np.frombuffer(p, kind) for p, kind in zip(parts, _KINDS, strict=True))
    return ids, at, v.reshape(len(norm), -1), norm, sig.reshape(-1, tables)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers; where sums may be rounded, one component after the other."""
    if q.shape[1] * np.abs(q).max(initial=0) * np.abs(v).max(initial=0) < 2.0**53:
        return q @ v.T
    out = np.zeros((len(q), len(v)))
    for d in range(q.shape[1]):
        out += q[:, d, None] * v[None, :, d]
    return out


def best_of_block(queries: tuple[np.ndarray, ...], block: tuple[np.ndarray, ...], best: list[tuple[np.ndarray, np.ndarray]], k: int) -> None:
    """Improves best, for each query its k highest scores and their ids in order, by the vectors of a block that share a bucket with it or are one bit away. The
    scores of all are one product of matrices; buckets are compared for those that could be among the best."""
    q_ids, _, q, q_norm, q_sig = queries
    ids, at, v, norm, sig = block
    if q.shape[1] != v.shape[1]:
        return
    scored = products(q, v) / (norm[None, :] * q_norm[:, None])
    for i, s in enumerate(scored):
        scores, found = best[i]
        rows = np.flatnonzero(s >= scores[-1] - 2e-6) if len(scores) == k else np.arange(len(s))
        other = sig[rows] ^ q_sig[i]
        rows = rows[((other & (other - 1)) == 0).any(axis=1)]
        if len(rows) > k + 1:  # a row gives at least one id that is not the query's, but for one row
            rows = rows[s[rows] >= np.partition(s[rows], len(rows) - k - 1)[len(rows) - k - 1] - 2e-6]
        if not len(rows):
            continue
        n = at[rows + 1] - at[rows]
        more = ids[np.repeat(at[rows] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        s, stay = np.repeat(rounded(s[rows]), n), more != q_ids[i]
        s, more = np.concatenate((scores, s[stay])), np.concatenate((found, more[stay]))
        top = np.lexsort((more, -s))[:k]
        best[i] = (s[top], more[top])


def knn_lsh(vectors: DataFrame, asked: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, tables: int = TABLES, bits: int = BITS) -> DataFrame:
    """(query_id, rank, id, score): for the rows where ``asked`` (a condition on id) holds the k others of highest cosine, of those that in one
    table are in the query's bucket or one a bit away; ties to the smaller id.

    A vector that repeats is looked at once, with its k + 1 smallest ids, so that a group of copies is no large bucket. As many tables put most of all vectors into
    some probed bucket, blocks of queries and of vectors meet as a grid instead of row by row: each pair once, and a vector is sent a number of
    times that the shuffle partitions fix. Vectors of unequal length never meet."""
    spark = vectors.sparkSession
    rows = whole(vectors, id_col, vector_col)
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    same = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.first("norm").alias("norm"))
    known = cut(_blocks(signatures(same, tables, bits), BLOCK))
    queries = cut(_blocks(signatures(rows.where(asked).select(F.array("id").alias("ids"), "v", "norm"), tables, bits), BLOCK))
    cells = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_q, n_c = queries.count(), known.count()
    down = max(1, min(cells, n_q, round((cells * n_q / max(n_c, 1)) ** 0.5)))
    across = max(1, min(-(-cells // down), n_c))
    part = lambda n: F.pmod(F.xxhash64("ids", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sent = queries.select(*[F.col(p).alias(f"q_{p}") for p in _PARTS], part(down).alias("r"), every(across).alias("c"))
    met = known.select(*_PARTS, part(across).alias("c"), every(down).alias("r")).join(sent.hint("merge"), ["r", "c"]).select(*[f"q_{p}" for p in _PARTS], *_PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, tuple[np.ndarray, list]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for own, found in best.values():
                n = [len(s) for s, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, n)), pa.array(np.concatenate([x for _, x in found])), pa.array(np.concatenate([s for s, _ in found]))], ["query_id", "id", "score"])

        for rb in batches:
            for i in range(rb.num_rows):
                parts = [c[i].as_py() for c in rb.columns]
                asking = _read(parts[:5], tables)
                key = parts[0] + parts[2]
                if key not in best:
                    if len(best) > 64:  # bests of finished queries go on
                        yield from out()
                        best.clear()
                    best[key] = (asking[0], [(np.zeros(0), np.zeros(0, np.int64))] * len(asking[0]))
                best_of_block(asking, _read(parts[5:], tables), best[key][1], k)
        yield from out()

    found = met.mapInArrow(run, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
