"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each document is cut into blocks of words, and a source's blocks are permuted: each for itself, or those of a
document together where the mix is to keep documents whole. A source's exact quota of draws is the number that brings its words nearest to
its target: whole passes over the permutation, then its first blocks. The vector of
quotas is split among the output shards by a binary tree: at each node the left half's counts
are a multivariate hypergeometric draw, so row and column sums stay exact. That draw is a tree
too: from all sources down to single ones, the draws that fall to the first half of a stretch of sources
are hypergeometric. Each (source, shard) cell takes its own stretch of the source's draws; the tree decides which shard has a draw, the
quotas how many draws there are. A shard's pieces are in the order of a hash.

Only DataFrame functions. Ranks within a source come from sums over hash ranges
(``RANGES`` a source) and a window inside one range, so that a source with a third of
all rows is never in one task; what is known of a source reaches its blocks by source and range. Sources are
ranked by sums over ranges of them. A level of the splitting tree is one written table; the sums of its long stretches of sources, of
which there are few whatever the number of sources, are broadcast, so that the stretch of all sources is no key of a shuffle.

Defined cases: a null text has size 0, as has an empty one; a null source is a source
of its own, last in order. Rows that repeat a doc_id are documents of their own and
return a row each. A source without words has target 0. An empty table gives an empty
result. Every draw is a hash of ids, texts and the seed, so that reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, in_order, pick, text_or_empty

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
BLOCK_WORDS = 256
RANGES = 1024
SHARDS = 16
SEED = 42
#: Copies of a source's row that meet its documents.
SALTS = 32
#: Candidates of a hypergeometric draw; each is accepted with a probability over one half.
TRIALS = 64
#: Halvings of the sources whose sums are broadcast: at most shards x 2 ** TOPS rows.
TOPS = 10
#: Parts that a shard's pieces are dealt to by their hash.
PARTS = 4096


def _uniform(*cols) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 12).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, scratch: Scratch, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target): the level at which every source below its cap gets
    level times its weight, and the others their cap, sums to all words."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = in_order(by, scratch, "sources", [F.asc_nulls_last("source")])
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.select("source", "source_size", F.col("nth").alias("place"), w.alias("w"), (most * F.col("source_size")).cast("double").alias("cap"))
    by = in_order(by.withColumn("full", F.col("cap") / F.col("w")), scratch, "filling", [F.asc("full"), F.asc("place")], ["cap", "w"])
    total, all_w = by.agg(F.sum("source_size").cast("double"), F.sum("w")).first()
    if total is None:
        return by.select("source", "source_size", F.col("cap").alias("target"))
    # with the sources before one at their caps, the level of the rest
    level = (F.lit(total) - F.col("before_cap")) / (F.lit(all_w) - F.col("before_w"))
    (free,) = by.where(level * F.col("w") <= F.col("cap")).agg(F.min(F.struct("nth", level.alias("level")))).first()
    target = F.least(F.col("cap"), F.lit(free["level"]) * F.col("w")) if free else F.col("cap")
    return by.select("source", "source_size", target.alias("target"))


def _ln_factorial(n: Column, few: Column) -> Column:
    """few: the values below 16."""
    many = (n + 0.5) * F.ln(n) - n + 0.5 * math.log(2 * math.pi) + _correction(n)
    return F.when(n < 16, F.get(few, n.cast("int"))).otherwise(many)


def _correction(n: Column) -> Column:
    """What Stirling's formula lacks."""
    return 1 / (12 * n) - 1 / (360 * n * n * n) + 1 / (1260 * n * n * n * n * n)


def _ln_ratio(a: Column, b: Column, few: Column) -> Column:
    """ln(a! / b!), without taking large numbers from each other."""
    off = a - b
    many = off * F.ln(b) + (a + 0.5) * F.log1p(off / b) - off + _correction(a) - _correction(b)
    return F.when(F.least(a, b) < 16, _ln_factorial(a, few) - _ln_factorial(b, few)).otherwise(many)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(pool: Column, marked: Column, drawn: Column, *key) -> Column:
    """The number of marked ones among ``drawn`` of ``pool``: the first candidate of a ratio of
    uniforms (Stadlober 1990) that is accepted; each is a hash of key. Its work does not depend on the numbers."""
    pool, marked, drawn = (x.cast("double") for x in (pool, marked, drawn))
    lo = F.greatest(F.lit(0.0), drawn + marked - pool)
    few = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])

    def shaped(g):
        share = g["m"] / F.greatest(g["n"], F.lit(1.0))
        var = g["d"] * share * (1 - share) * (g["n"] - g["d"]) / F.greatest(g["n"] - 1, F.lit(1.0))
        mode = F.greatest(g["lo"], F.least(g["hi"], F.floor((g["d"] + 1) * (g["m"] + 1) / (g["n"] + 2)).cast("double")))
        width = 2 * math.sqrt(2 / math.e) * F.sqrt(F.greatest(var, F.lit(0.0)) + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
        return F.struct(g["n"].alias("n"), g["m"].alias("m"), g["d"].alias("d"), g["lo"].alias("lo"), g["hi"].alias("hi"), (g["d"] * share + 0.5).alias("mid"), width.alias("width"), mode.alias("mode"))

    def seek(g):
        def step(found, i):
            u = _uniform(*key, i, F.lit(0))
            k = F.floor(g["mid"] + g["width"] * (_uniform(*key, i, F.lit(1)) - 0.5) / u).cast("double")

            def judge(c):
                k, mode, rest = c["k"], g["mode"], g["n"] - g["m"] - g["d"]
                places = ((k, mode), (g["m"] - k, g["m"] - mode), (g["d"] - k, g["d"] - mode), (rest + k, rest + mode))
                off = sum((_ln_ratio(a, b, few) for a, b in places), F.lit(0.0))
                return F.when((k >= g["lo"]) & (k <= g["hi"]), F.when(2 * F.ln(c["u"]) <= -off, k))

            return F.when(found.isNotNull(), found).otherwise(_let(F.struct(u.alias("u"), k.alias("k")), judge))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(TRIALS)), F.lit(None).cast("double"), step)
        return F.when(g["lo"] >= g["hi"], g["lo"]).otherwise(F.coalesce(found, g["mode"]))

    given = F.struct(pool.alias("n"), marked.alias("m"), drawn.alias("d"), lo.alias("lo"), F.least(marked, drawn).alias("hi"))
    return _let(_let(given, shaped), seek).cast("long")


def _descend(seed: int):
    """What of the draws of a stretch of sources falls to its half p["side"], at the row's level and node."""

    def step(want: Column, p: Column) -> Column:
        got = hypergeometric(p["pool"], p["first"], want, F.lit(seed), F.col("level"), F.col("node"), p["j"], p["stretch"])
        return _let(got, lambda g: F.when(p["side"] == 0, g).otherwise(want - g))

    return step


def split_quotas(quotas: DataFrame, scratch: Scratch, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(source, shard, n): how many of each source's draws go to each of ``shards`` (a power of 2) shards.

    quotas: (source, nth, quota), nth from 1. Every source follows the halving of the sources from all down to
    itself, and draws what falls to its half at each; draws are hashes, so that sources of a stretch agree on them."""
    n_sources = quotas.agg(F.max("nth")).first()[0] or 1
    bits = max(1, (n_sources - 1).bit_length())
    cells = quotas.select("source", (F.col("nth") - 1).alias("idx"), F.lit(0).alias("node"), F.col("quota").alias("n"))
    left = F.aggregate("path", F.floor(F.element_at("path", 1)["pool"] / 2).cast("long"), _descend(seed))
    for level in range(shards.bit_length() - 1):
        each = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("j"))
        each = each.withColumn("stretch", F.expr(f"shiftright(idx, {bits} - j)")).withColumn("side", F.expr(f"shiftright(idx, {bits} - j - 1) & 1"))
        sums = each.groupBy("node", "j", "stretch").agg(F.sum("n").alias("pool"), F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("first"))
        sums = scratch.write(f"sums{level}", sums)
        path = F.array_sort(F.collect_list(F.struct("j", "stretch", "side", "pool", "first")))
        on = ["node", "j", "stretch"]
        met = each.where(F.col("j") < TOPS).join(sums.where(F.col("j") < TOPS).hint("broadcast"), on)
        if bits > TOPS:
            met = met.unionByName(each.where(F.col("j") >= TOPS).join(sums.where(F.col("j") >= TOPS).hint("merge"), on))
        paths = met.groupBy("node", "idx", "source", "n").agg(path.alias("path"))

        paths = paths.withColumn("level", F.lit(level)).withColumn("left", left)
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("n")),
            F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("n") - F.col("left")).alias("n")),
        )
        cells = scratch.write(f"level{level}", paths.select("source", "idx", F.explode(halves).alias("h")).select("source", "idx", "h.node", "h.n"))
    return cells.select("source", F.col("node").alias("shard"), "n")


def document_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, row: Column | None = None) -> DataFrame:
    """(id, source, size, tie, row) of each document; row: a key that docs already has, else a new one."""
    return docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(text_or_empty(text_col)).alias("tie"),
        (F.monotonically_increasing_id() if row is None else row).alias("row"),  # a new one is fixed once this is written
    )


def _same(a: str, b: str, *more: str) -> Column:
    out = F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    for name in more:
        out &= F.col(f"{a}.{name}") == F.col(f"{b}.{name}")
    return out


def mix(sizes: DataFrame, scratch: Scratch, shards: int = SHARDS, seed: int = SEED, block_words: int = BLOCK_WORDS, whole: bool = False):
    """sizes: of document_sizes(). Returns (blocks, targets): the blocks that the mix
    takes, (row, id, source, pass, block, words, shard, place), and source_targets(). whole: a document's blocks stand together in the permutation."""
    targets = scratch.write("targets", source_targets(sizes, scratch))
    n_blocks = F.ceil(F.col("size") / block_words).cast("int")
    blocks = sizes.where("size > 0").select("row", "id", "source", "size", "tie", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"))
    blocks = blocks.select(
        "row",
        "id",
        "source",
        "block",
        F.least(F.lit(block_words), F.col("size") - F.col("block") * block_words).cast("long").alias("words"),
        F.xxhash64("id", "size", "tie", *([] if whole else ["block"]), F.lit(seed)).alias("key"),
    ).withColumn("rng", F.shiftrightunsigned("key", 64 - RANGES.bit_length() + 1))

    # what comes before each range of a source's permutation
    ranges = blocks.groupBy("source", "rng").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("w"))
    of = Window.partitionBy("source")
    upto = of.orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    ranges = ranges.select(
        "source", "rng", F.coalesce(F.sum("n").over(upto), zero).alias("n0"), F.coalesce(F.sum("w").over(upto), zero).alias("w0"), F.sum("n").over(of).alias("n_blocks")
    )
    passes = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST_REPEATS)).cast("int")
    ranges = ranges.alias("r").join(targets.alias("t"), _same("r", "t")).select(
        "r.*", passes.alias("passes"), F.when(passes < MOST_REPEATS, F.col("target") - passes * F.col("source_size")).otherwise(-1.0).alias("rest")
    )
    ranges = scratch.write("ranges", ranges)

    # rank of each block in the permutation, and whether it is in the part of a pass
    inside = Window.partitionBy("source", "rng").orderBy("key", "row", "block")
    ranked = blocks.withColumn("n1", F.row_number().over(inside) - 1).withColumn(
        "w1", F.coalesce(F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, -1)), zero)
    )
    ranked = ranked.alias("b").join(ranges.hint("merge").alias("r"), _same("b", "r", "rng")).select(
        "row", "id", "b.source", "b.rng", "block", "words", "key", (F.col("n0") + F.col("n1")).alias("rank"),
        (F.col("w0") + F.col("w1") + F.col("words") / 2 <= F.col("rest")).alias("partly"),
    )
    ranked = scratch.write("ranked", ranked)

    # exact quotas of draws, split among the shards
    part = ranked.where("partly").groupBy("source", "rng").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.sum("n").alias("part"))
    full = ranges.groupBy("source").agg(F.max(F.col("passes") * F.col("n_blocks")).alias("full"))
    quotas = full.alias("f").join(part.alias("p"), _same("f", "p"), "left").select("f.source", (F.col("full") + F.coalesce("part", zero)).alias("quota"))
    quotas = in_order(quotas, scratch, "quotas", [F.asc_nulls_last("source")])
    cells = split_quotas(quotas, scratch, shards, seed)
    upto = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("start", F.coalesce(F.sum("n").over(upto), zero))
    cells = cells.where("n > 0").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("start", "shard", "n"))).alias("cells"))  # one for each shard
    known = ranges.select("source", "rng", "n_blocks").alias("r").join(cells.alias("c"), _same("r", "c")).select("r.*", "cells")
    known = scratch.write("cells", known)

    # a draw is taken by the cell whose stretch it is in
    out = ranked.alias("b").join(known.hint("merge").alias("k"), _same("b", "k", "rng"))
    out = out.select("row", "id", "b.source", "block", "words", "key", "rank", "n_blocks", "cells", F.explode(F.sequence(F.lit(0), F.lit(MOST_REPEATS))).alias("pass"))
    draw = F.col("pass") * F.col("n_blocks") + F.col("rank")
    cell = F.get(F.filter("cells", lambda c: (c["start"] <= draw) & (draw < c["start"] + c["n"])), F.lit(0))
    out = out.withColumn("shard", cell["shard"]).where("shard IS NOT NULL")
    return out.select("row", "id", "source", "pass", "block", "words", "shard", F.xxhash64("key", "pass", F.lit(seed + 1)).alias("place")), targets


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """Per document: its size, its source's size and target, the words the mix takes of it, and
    how many blocks of it each shard takes."""
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "source")
    scratch = Scratch(spark, "mixing")
    sizes = scratch.write("sizes", document_sizes(docs, "doc_id", "text", "source"))
    blocks, targets = mix(sizes, scratch)
    by_shard = blocks.groupBy("row", "shard").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("n"))
    shown = F.concat_ws(":", F.col("shard"), F.col("n"))
    by_doc = by_shard.groupBy("row").agg(F.sum("words").alias("taken"), F.array_join(F.array_sort(F.collect_list(shown)), ",").alias("shards"))
    by_doc = scratch.write("by-doc", by_doc)
    scratch.drop_but("sizes", "by-doc", "targets")
    told = targets.select("source", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = sizes.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).alias("d").join(told.alias("t"), _same("d", "t", "salt"))
    return rows.join(by_doc.hint("merge"), "row", "left").select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("shards", F.lit("")).alias("shards")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them: a row for each pass over a document and each shard that takes blocks of
    it then (nearly always one, as documents are kept whole: text that is read on is not cut every 256 words), with those blocks joined in order; documents of which nothing is taken go. Rows are
    dealt by shard and parts of it and are there in the shard's shuffled order. Other columns stay. Each row has its
    own passes, also where rows share an id."""
    scratch = Scratch(docs.sparkSession, "mixing")
    docs = scratch.write("keyed", docs.withColumn("__row", F.monotonically_increasing_id()))
    sizes = scratch.write("sizes", document_sizes(docs, id_col, text_col, source_col, F.col("__row")))
    blocks, _ = mix(sizes, scratch, whole=True)
    passes = blocks.groupBy("row", "pass", "shard").agg(F.array_sort(F.collect_set("block")).alias("__blocks"), F.min("place").alias("__place"))
    passes = scratch.write("passes", passes).select(F.col("row").alias("__row"), F.col("shard").alias("__shard"), "__place", "__blocks")
    scratch.drop_but("keyed", "passes")
    rows = docs.join(passes.hint("merge"), "__row").drop("__row")
    rows = rows.repartition("__shard", F.pmod(F.col("__place"), F.lit(PARTS))).sortWithinPartitions("__shard", "__place")
    space = r"[\x20\x09-\x0D]"
    cut = F.regexp_extract_all(text_or_empty(text_col), F.lit(rf"(?:{space}*+{WORD}+){{1,{BLOCK_WORDS}}}+"), F.lit(0))
    n_blocks = F.ceil(F.regexp_count(text_or_empty(text_col), F.lit(WORD)) / BLOCK_WORDS)
    chosen = F.array_join(F.transform("__blocks", lambda b: F.get(F.col("__cut"), b)), "")
    rows = rows.withColumn("__cut", F.when(F.size("__blocks") < n_blocks, cut))
    text = F.when(F.col("__cut").isNull(), F.col(f"`{text_col}`")).otherwise(chosen)
    return rows.withColumn(text_col, text).drop("__cut", "__blocks", "__shard", "__place")
