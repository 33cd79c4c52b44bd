"""Rankings (item_id, rank, doc_id) of documents for queries: fused ones and their measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .knowledge import best, matches
from .lineage import cut, sized


def fuse(rankings: list[DataFrame], k: int = 5, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: the k documents of highest sum of 1 / (constant + rank)."""
    rows = rankings[0].select("item_id", "rank", "doc_id")
    for more in rankings[1:]:
        rows = rows.unionByName(more.select("item_id", "rank", "doc_id"))
    by = rows.groupBy("item_id", "doc_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"))
    return best(by, "score", k).select("item_id", "rank", "doc_id", "score")


def evaluate(ranking: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """For each query with relevant documents (item_id, doc_id): recall, reciprocal rank and nDCG of its first k."""
    relevant = relevant.select("item_id", "doc_id").distinct()
    n = relevant.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    hits = ranking.where(F.col("rank") <= k).join(relevant, ["item_id", "doc_id"]).groupBy("item_id")
    hits = hits.agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    places = F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_relevant")).cast("int"))
    ideal = F.aggregate(places, F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return n.join(hits, "item_id", "left").select(
        "item_id", "n_relevant", zero(F.col("hits")).alias("hits"), F.round(zero(F.col("hits")) / F.col("n_relevant"), 6).alias("recall"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("rr"), F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal, 6).alias("ndcg"),
    )


def fuse_scores(found: DataFrame, by: list[str], k: int = 5, constant: int = 60) -> DataFrame:
    """fuse() of the rankings of found (item_id, doc_id, ..) by each column of ``by``, falling, ties to the smaller doc_id, without ranking all rows.

    The k-th best document has at least 1 / (constant + k), as the first k of any one ranking do. So the best are among the first
    ``reach`` rows of the rankings: what is in none of those has less. A document of them whose other ranks could still bring it among the best
    has the rows before it counted there; nothing else is ranked beyond ``reach``. found: written, as it is read several times."""
    reach = len(by) * (constant + k) - constant
    rows = found.select("item_id", "doc_id", *by)
    tops = [best(rows, c, reach).select("item_id", "doc_id", *by, *[(F.col("rank") if x == c else F.lit(None).cast("long")).alias(f"rank_{x}") for x in by]) for c in by]
    told = tops[0]
    for more in tops[1:]:
        told = told.unionByName(more)
    ranks = [f"rank_{c}" for c in by]
    told = told.groupBy("item_id", "doc_id", *by).agg(*[F.max(r).alias(r) for r in ranks])
    zero = F.lit(0.0)
    least = sum((F.coalesce(1.0 / (constant + F.col(r)), zero) for r in ranks), zero)
    missing = sum((F.col(r).isNull().cast("int") for r in ranks), F.lit(0))
    order = Window.partitionBy("item_id").orderBy(F.desc("least"))
    told = told.withColumn("least", least).withColumn("missing", missing).withColumn("nth", F.row_number().over(order))
    kth = F.max(F.when(F.col("nth") == k, F.col("least"))).over(Window.partitionBy("item_id"))  # rows: reach a ranking at most
    could = F.col("least") + F.col("missing") / F.lit(float(constant + reach + 1)) >= F.coalesce(kth, zero) - 1e-8  # scores are rounded to 9 places
    told = cut(told.withColumn("could", could).where("missing = 0 OR could").drop("nth", "least", "could"))
    for c, r in zip(by, ranks, strict=True):
        want = sized(told.where(F.col(r).isNull()).select("item_id", F.col("doc_id").alias("of"), F.col(c).alias("value")))
        before = (F.col(c) > F.col("value")) | ((F.col(c) == F.col("value")) & (F.col("doc_id") < F.col("of")))
        counted = rows.join(want, "item_id").where(before).groupBy("item_id", "of").agg((F.count(F.lit(1)) + 1).alias("counted"))
        told = told.join(counted.withColumnRenamed("of", "doc_id"), ["item_id", "doc_id"], "left").withColumn(r, F.coalesce(r, "counted")).drop("counted")
    score = F.round(sum((1.0 / (constant + F.col(r)) for r in ranks), zero), 9)
    return best(told.select("item_id", "doc_id", score.alias("score")), "score", k).select("item_id", "rank", "doc_id", "score")


def fused_search(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """BM25 and term overlap, each over all documents with a term of the query, fused."""
    return fuse_scores(cut(matches(docs, queries)), ["score", "shared"])


def holding(docs: DataFrame, queries: DataFrame, found: DataFrame) -> DataFrame:
    """(item_id, doc_id) of the documents that hold the whole text of a query. found: matches() of both. A text that is held is
    held with all its terms but its first and last, which may be parts of longer ones there; so only documents that share the others are looked into.
    Texts of fewer than three terms say too little and are not sought."""
    maybe = found.where((F.col("n_terms") >= 3) & (F.col("shared") >= F.col("n_terms") - 2)).select("item_id", "doc_id")
    asked = sized(queries.select("item_id", F.col("text").alias("passage")))
    rows = docs.select("doc_id", "text").join(maybe.join(asked, "item_id"), "doc_id")
    return rows.where(F.contains("text", "passage")).select("item_id", "doc_id")


def measured_search(docs: DataFrame, queries: DataFrame, relevant: DataFrame | None = None) -> DataFrame:
    """BM25 measured against relevant (item_id, doc_id), or else against the documents that hold the query's whole text."""
    found = cut(matches(docs, queries))
    return evaluate(best(found, "score", 10), holding(docs, queries, found) if relevant is None else relevant)
