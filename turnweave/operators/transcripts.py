"""Shaping transcripts: turns in (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentences


def by_turn():
    """Turns of a conversation in order; a turn given twice by role, then text."""
    return Window.partitionBy("conv_id").orderBy("turn", "role", "text")


def validate_turns(turns: DataFrame) -> DataFrame:
    """A row for each issue: a turn given twice, a gap before a turn, a blank text, a role repeated."""
    twice = turns.groupBy("conv_id", "turn").count().where("count > 1").select("conv_id", "turn", F.lit("duplicate").alias("issue"))
    lagged = turns.withColumn("before", F.lag("turn").over(by_turn())).withColumn("role_before", F.lag("role").over(by_turn()))
    checks = F.array(
        F.when(F.col("turn") - F.coalesce("before", F.lit(-1)) > 1, "gap"),
        F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "blank"),
        F.when(F.col("role") == F.col("role_before"), "role_repeated"),
    )
    found = lagged.select("conv_id", "turn", F.explode(F.array_compact(checks)).alias("issue"))
    return twice.unionByName(found)


def assemble(turns: DataFrame, sep: str = "\n") -> DataFrame:
    """One text for each conversation, turns in order."""
    whole = F.array_sort(F.collect_list(F.struct("turn", "text")))
    by = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), whole.alias("t"))
    by = by.withColumn("text", F.array_join(F.transform("t", lambda x: x["text"]), sep))
    return by.select("conv_id", "n_turns", F.length("text").cast("long").alias("n_chars"), "text")


def merge_turns(turns: DataFrame, min_chars: int = 40) -> DataFrame:
    """Without turns shorter than min_chars, or without text, neighbours of one role become one turn."""
    long = turns.where(F.length("text") >= min_chars)
    edge = F.when(F.lag("role").over(by_turn()).eqNullSafe(F.col("role")), 0).otherwise(1)
    runs = long.withColumn("edge", edge).withColumn("run", F.sum("edge").over(by_turn()))
    by = runs.groupBy("conv_id", "run", "role").agg(F.min("turn").alias("turn"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return by.select("conv_id", "turn", "role", F.size("t").cast("long").alias("n_merged"), F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))


def split_sentences(turns: DataFrame) -> DataFrame:
    """A row for each sentence, with its place in its turn."""
    rows = turns.select("conv_id", "turn", F.posexplode(sentences(F.col("text"))).alias("pos", "raw"))
    rows = rows.withColumn("sentence", F.btrim("raw", F.lit(" \n"))).where("sentence <> ''")
    return rows.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "sentence")


def chunk(turns: DataFrame, size: int = 50, overlap: int = 10) -> DataFrame:
    """Windows of size words that start every size - overlap words of a turn."""
    if not 0 <= overlap < size:
        raise ValueError("overlap is from 0 to under size")
    step = size - overlap
    words = turns.select("conv_id", "turn", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    n = F.greatest(F.lit(1), F.ceil((F.size("w") - overlap) / step).cast("int"))
    rows = words.select("conv_id", "turn", "w", F.explode(F.sequence(F.lit(0), n - 1)).alias("no"))
    part = F.slice("w", F.col("no") * step + 1, F.lit(size))
    return rows.select("conv_id", "turn", F.col("no").cast("long").alias("chunk_no"), F.size(part).cast("long").alias("n_tokens"), F.array_join(part, " ").alias("text"))


def role_share(turns: DataFrame) -> DataFrame:
    """Words of each role in a conversation and their share."""
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    by = turns.groupBy("conv_id", "role").agg(F.sum(n).alias("n_tokens"))
    whole = F.sum("n_tokens").over(Window.partitionBy("conv_id"))
    return by.withColumn("share", F.round(F.try_divide("n_tokens", whole), 6))


def exchanges(turns: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn that follows it."""
    nxt = turns.withColumn("next_role", F.lead("role").over(by_turn())).withColumn("answer", F.lead("text").over(by_turn()))
    return nxt.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def role_transitions(turns: DataFrame) -> DataFrame:
    """How often a role follows another, and its share of what follows that one."""
    pairs = turns.withColumn("next_role", F.lead("role").over(by_turn())).where("next_role IS NOT NULL")
    by = pairs.groupBy("role", "next_role").agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("role")), 6))
