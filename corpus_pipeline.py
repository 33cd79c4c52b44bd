"""A training corpus from raw documents: good ones, without shared lines, one of each group
of near copies, mixed to target weights, packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but
the last return the columns of documents, with n_chars of the text as it then is.

Defined cases, for all stages: an empty table gives an empty one; extra columns stay through all but the last,
whatever their names; a text of any length is judged whole; rows that share an id are judged each by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.llm import line_dedup, mixing, packing, quality_pu, simhash
from turnweave.llm.common import Scratch, read


def _same_columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    """out with the columns of docs, in their order, and the length of its texts."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose positive-unlabelled score reaches the limit. Null and empty texts are scored as texts without
    words; a row without an id is scored but not learned from; ties at the limit stay."""
    return _same_columns(quality_pu.keep_good(docs, read(spark, sf_dir, "labels")), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them hold. A null text is an empty one from here on; rows of one id,
    or without one, count as one document; a document of which nothing is left stays."""
    return _same_columns(line_dedup.dedup_lines(docs, report=False), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies: linked as in op5, or by 0.8 or more of their
    five-word shingles. Empty texts are copies of each other; rows without an id stay, as do all rows that share the
    smallest id and are of the group."""
    return _same_columns(simhash.keep_one(docs, similar=True), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass that the mix takes over a document and shard that takes it, with the text it takes. A null source
    is one of its own; empty texts go, as nothing of them is taken; repeated rows are documents of their own."""
    return _same_columns(mixing.mixed_documents(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place there. A null or empty text is the end id alone; repeated rows are
    packed each."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", quality),
    ("line dedup", lines),
    ("near dedup", near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: Trained scores, near-copy components and draws are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. A stage's corpus is freed with all that it was made from once the next one's is written."""
    docs = read(spark, sf_dir, "documents")
    scratch, before = Scratch(spark, "pipeline"), ""
    for name, stage in STAGES[:-1]:
        made = len(Scratch.made)
        docs = scratch.write(name.replace(" ", "-"), stage(spark, docs, sf_dir))
        Scratch.release(made)
        if before:
            scratch.drop(before)
        before = name.replace(" ", "-")
    return STAGES[-1][1](spark, docs, sf_dir)
