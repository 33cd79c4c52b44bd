"""Exact top-k inner products by columnar branch and bound.

Vectors become integers and are packed into blocks; a block is kept dimension by
dimension (vertical layout), dimensions by falling mass of the block. A block of queries meets each block of
candidates: scores grow by one group of dimensions at a time, and after each a candidate
whose score plus the bound of the rest (the product of remaining norms) cannot reach the
query's k-th best is dropped, the rest compacted. Bests found in earlier blocks of a cell carry
over.

Query groups and candidate groups form a grid of cells of about WORK scores. A query block is
sent to the cells of its row, a candidate block to those of its column; the number of rows and columns is
that which sends least for the cells there must be. Nothing is broadcast or collected.

Defined cases: a vector that is null or has null or non-finite components takes no part, nor
does a null id. Vectors of unequal length are padded with zeros. A component or a score that
does not fit a long ends the job with an error. Rows with the query's own id are never
its candidates. If ids repeat, each row is a candidate, and the rows of a query id are ranked together: a
candidate comes once for each. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SCALE = 1024
GROUP = 16
#: Scores of a cell of the grid.
WORK = 1 << 30
#: Integers below this times the norms' product are exact as doubles, or as longs.
EXACT_DOUBLE, EXACT_LONG = 2**52, 2**62


def quantise(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v): integer components of the vectors that take part."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & ~odd)
    large = F.raise_error(F.lit("a component does not fit a long")).cast("long")
    whole = F.transform(v, lambda x: F.when(F.abs(x * scale) < 2.0**63, F.floor(x * scale).cast("long")).otherwise(large))
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), whole.alias("v"))


def _vertical(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions by falling mass, and the vectors' components there, dimension by dimension."""
    width = max((len(v) for v in vectors), default=0)
    rows = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        rows[i, : len(v)] = v
    order = np.argsort(-(rows.astype(np.float64) ** 2).sum(axis=0), kind="stable")
    return order, np.ascontiguousarray(rows[:, order].T)


def _blocks(rows: DataFrame, size: int, by: str) -> DataFrame:
    """(block, ids, dims, m): blocks of ``size`` vectors at most, of one value of column ``by`` each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(b: int, ids: list, vs: list) -> pa.RecordBatch:
            dims, m = _vertical(vs)
            return pa.RecordBatch.from_arrays([pa.array([b]), *(pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (np.array(ids), dims, m))], ["block", "ids", "dims", "m"])

        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for b, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, vs = held.setdefault(b, ([], []))
                ids.append(i)
                vs.append(v)
                if len(ids) == size:
                    yield out(b, ids, vs)
                    del held[b]
        for b, (ids, vs) in held.items():
            yield out(b, ids, vs)

    return rows.select(by, "id", "v").mapInArrow(pack, "block long, ids binary, dims binary, m binary")


def best_in_block(q: np.ndarray, q_dims: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_dims: np.ndarray, c_ids: np.ndarray, best: list, k: int) -> None:
    """Improves best, for each query a list of arrays (scores, ids) in order, by a block of candidates.
    q, c: components, dimension by dimension in the order of the dims, as whole numbers."""
    width = len(c_dims)
    mine = np.zeros((max(width, len(q_dims)), len(q_ids)), q.dtype)
    mine[q_dims] = q
    q = mine[c_dims].T  # a dimension that the candidates lack adds nothing
    large = width * float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0))
    exact = np.float64 if large < EXACT_DOUBLE else np.int64 if large < EXACT_LONG else object
    q_real, c_real = q.astype(np.float64), c.astype(np.float64)
    cuts = [*range(0, width, GROUP), width] if width else [0]
    sums = np.cumsum((c_real * c_real)[::-1], axis=0)[::-1] if width else np.zeros((0, len(c_ids)))
    rest_c = [np.sqrt(sums[at]) if at < width else np.zeros(len(c_ids)) for at in cuts]
    rest_q = [np.sqrt((q_real[:, at:] ** 2).sum(axis=1)) for at in cuts]
    q, c = q.astype(exact), c.astype(exact)
    first = q[:, :GROUP] @ c[:GROUP] if width else np.zeros((len(q_ids), len(c_ids)), exact)
    for i in range(len(q_ids)):
        scores, ids = best[i]
        floor = scores[-1] if len(scores) == k else -np.inf
        at = np.flatnonzero(c_ids != q_ids[i])
        part = first[i, at]
        for g in range(1, len(cuts)):
            bound = rest_q[g][i] * rest_c[g][at]
            # some slack, as the bound is rounded
            stay = (part.astype(np.float64) + bound) + (1 + 1e-12 * (bound + np.abs(part.astype(np.float64)))) >= floor
            at, part = at[stay], part[stay]
            if g + 1 < len(cuts) and len(at):
                part = part + q[i, cuts[g] : cuts[g + 1]] @ c[cuts[g] : cuts[g + 1], at]
        if len(at):
            s, n = np.concatenate((scores, part.astype(np.int64))), np.concatenate((ids, c_ids[at]))
            if len(s) > k:  # all that tie with the k-th score stay for the order by id
                stay = s >= np.partition(s, len(s) - k)[len(s) - k]
                s, n = s[stay], n[stay]
            top = np.lexsort((n, -s))[:k]
            best[i] = (s[top], n[top])


def grid(queries: int, candidates: int, parallel: int, work: int = WORK) -> tuple[int, int]:
    """Groups of queries and of candidates: cells of about ``work`` scores, at least ``parallel`` cells where there is work
    for them, with the fewest vectors sent."""
    scores = queries * candidates
    cells = max(1, -(-scores // work), min(parallel, -(-scores // (work >> 10))))
    rows = max(1, min(cells, round((cells * queries / max(candidates, 1)) ** 0.5)))
    return rows, -(-cells // rows)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, query_block: int = 1024, block: int = 4096) -> DataFrame:
    """(query_id, rank, id, score). queries, candidates: (id, v) of quantise(). All rows of candidates
    but those with the query's id are compared with each query."""
    spark = queries.sparkSession
    scratch = Scratch(spark, "topk")
    n_q, n_c = queries.count(), candidates.count()
    rows, columns = grid(n_q, n_c, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n_blocks = max(1, -(-n_q // query_block))
    hashed = F.xxhash64("id", "v")  # rows that share an id are dealt apart
    dealt = queries.withColumn("qb", F.pmod(hashed, F.lit(n_blocks)).cast("long")).repartition("qb")
    q = scratch.write("queries", _blocks(dealt, query_block, "qb"))
    c = scratch.write("candidates", _blocks(candidates.withColumn("b", F.lit(0).cast("long")), block, "b"))
    group = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select(group(rows).alias("r"), F.col("ids").alias("q_ids"), F.col("dims").alias("q_dims"), F.col("m").alias("q"), every(columns).alias("g"))
    c = c.select(group(columns).alias("g"), "ids", "dims", "m", every(rows).alias("r"))
    met = c.join(q.hint("merge"), ["g", "r"]).select("q_ids", "q_dims", "q", "ids", "dims", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(own: np.ndarray, found: list) -> pa.RecordBatch:
            counts = [len(s) for s, _ in found]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(own, counts)), pa.array(np.concatenate([i for _, i in found])), pa.array(np.concatenate([s for s, _ in found]))], ["query_id", "id", "score"]
            )

        best: dict[bytes, tuple[np.ndarray, list]] = {}
        held = 0
        for batch in batches:
            for i in range(batch.num_rows):
                q_raw, q_dims, qm, ids, dims, m = (x[i].as_py() for x in batch.columns)
                own, c_ids, q_dims, c_dims = (np.frombuffer(x, "<i8") for x in (q_raw, ids, q_dims, dims))
                if q_raw not in best:
                    if held > 1 << 20:  # bests of finished queries go on
                        yield from (out(*x) for x in best.values())
                        best, held = {}, 0
                    best[q_raw] = (own, [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(own))
                    held += len(own) * k
                qs, cs = np.frombuffer(qm, "<i8").reshape(-1, len(own)), np.frombuffer(m, "<i8").reshape(-1, len(c_ids))
                best_in_block(qs, q_dims, own, cs, c_dims, c_ids, best[q_raw][1], k)
        yield from (out(*x) for x in best.values())

    found = met.mapInArrow(run, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op6_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The 10 highest scores of every vector whose id is divisible by 100."""
    rows = quantise(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    found = top_k(rows.where(F.col("id") % 100 == 0), rows)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
