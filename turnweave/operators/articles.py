"""Articles from documents (doc_id, text)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentences, strings, terms, words_of_sentences
from .knowledge import ROWS, keyphrases, stats_of, weighed
from .lineage import cut
from .transcripts import assemble, exchanges


def sentence_terms(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf, at): the distinct terms of each row with how often they occur and the number of the sentence of each
    time. They are counted where the text is, in one pass over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for start in range(0, rb.num_rows, ROWS):
                part = rb.slice(start, ROWS)
                found, at, n = [], [], []
                for text in words_of_sentences(part.column(1)):
                    places = defaultdict(list)
                    for i, sentence in enumerate(text):
                        for t in sentence:
                            places[t].append(i)
                    found += places
                    at += places.values()
                    n.append(len(places))
                tf = np.fromiter(map(len, at), np.int64, len(at))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(tf))).astype(np.int32)), pa.array(np.fromiter(chain.from_iterable(at), np.int32, tf.sum())))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), strings(found), pa.array(tf), lists], ["doc_id", "term", "tf", "at"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, term string, tf long, at array<int>")


def summarize(docs: DataFrame, n: int = 2) -> DataFrame:
    """The n sentences of highest mean tf-idf of each document, in their order; ties to the earlier one.
    Documents without letters have none. Weights are whole millionths, so that sums do not depend on order."""
    millionths = F.round(F.col("idf") * 1_000_000).cast("long")
    said = cut(sentence_terms(docs))
    weights = weighed(said, stats_of(said, docs).select("term", "df", millionths.alias("idf")))
    by = weights.select("doc_id", F.explode_outer("at").alias("pos"), (F.col("tf") * F.col("idf")).alias("weight")).groupBy("doc_id", "pos")
    scored = by.agg((F.sum("weight") / F.count(F.lit(1))).alias("score"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos")
    top = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    top = top.groupBy("doc_id").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    rows = docs.select("doc_id", "text").join(top, "doc_id")
    chosen = F.transform("at", lambda i: F.btrim(F.get(sentences(F.col("text")), i), F.lit(" \n")))
    return rows.select("doc_id", F.size("at").cast("long").alias("n_sentences"), F.array_join(chosen, " ").alias("summary"))


SECTION = "array<struct<turn:bigint,question:string,answer:string>>"


def assemble_articles(turns: DataFrame) -> DataFrame:
    """An article for each conversation: (conv_id, title, tags, summary, sections). Title and tags are its keyphrases, sections a row for each
    question and its answer, in order. Without letters there is no title, tag or summary, without questions no section."""
    docs = assemble(turns).select(F.col("conv_id").alias("doc_id"), "text")
    tags = keyphrases(docs, 5).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t"))
    tags = tags.select("doc_id", F.transform("t", lambda x: x["term"]).alias("tags"))
    asked = exchanges(turns).groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "question", "answer"))).alias("sections"))
    x = docs.select("doc_id").join(tags, "doc_id", "left").join(summarize(docs), "doc_id", "left").join(asked, "doc_id", "left")
    none = F.array().cast("array<string>")
    return x.select(
        F.col("doc_id").alias("conv_id"), F.array_join(F.slice("tags", 1, 3), " ").alias("title"), F.coalesce("tags", none).alias("tags"), "summary",
        F.coalesce(F.col("sections").cast(SECTION), F.array().cast(SECTION)).alias("sections"),
    )


def articles_json(articles: DataFrame) -> DataFrame:
    """(conv_id, n_sections, n_words, article): each article as a JSON text with all its fields, and the words of its sections."""
    words = F.aggregate("sections", F.lit(0), lambda n, s: n + F.size(terms(s["question"])) + F.size(terms(s["answer"])))
    text = F.to_json(F.struct("title", "tags", "summary", "sections"), {"ignoreNullFields": "false"})
    return articles.select("conv_id", F.size("sections").cast("long").alias("n_sections"), words.cast("long").alias("n_words"), text.alias("article"))


def read_articles(stored: DataFrame) -> DataFrame:
    """assemble_articles() back from articles_json()."""
    shape = f"title string, tags array<string>, summary string, sections {SECTION}"
    return stored.select("conv_id", F.from_json("article", shape).alias("a")).select("conv_id", "a.*")
