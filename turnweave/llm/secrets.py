"""Secret scans: fixed patterns, and tokens whose characters a Markov model of random strings
explains better than one of ordinary identifiers.

Two first-order character models are trained from labelled samples; a token is a secret if
the log-likelihood ratio, summed over its transitions, and the mean of it reach limits.

Only DataFrame functions. The models are tables of at most 65 x 65 counts, whatever the
corpus, and are put into the plan as one literal array. Texts are scanned whole; positions
come from the lengths of the pieces between matches.

Fitting: the samples come from at most ``sample_docs`` documents, those with the smallest hash of
their id. Labelled random are base64 digests of their words, random by construction whatever the
texts hold, and the keys and hexadecimal strings that the patterns find; labelled ordinary are their other words, and
names joined of these. What stands after ``password:`` is in neither, as it may be a word. A transition's count is
smoothed by the frequency of the character it leads to.

Defined cases: a null text is empty and has no spans; rows that repeat an id have a row
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, text_or_empty

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, least length, group whose length counts
KINDS = (
    ("assign", ASSIGN, 8, 2),
    ("access", r"AKIA[A-Z0-9]+", 16, 0),
    ("hex", r"[0-9a-f]{32,}+", 32, 0),
)
#: What a candidate token is made of; the models' alphabet is these and one more for the ends.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1
SPAN = "array<struct<start:int,end:int,kind:int>>"


#: Elements of an array that are summed one after the other.
STRETCH = 256


def _before(values: Column) -> Column:
    """The sum of the values before each, in stretches, so that the work grows little faster than their number."""
    zero = F.lit(0).cast("long")

    def over(part: Column) -> Column:
        start = F.struct(zero.alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
        return F.aggregate(part, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    first = F.filter(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(STRETCH)), lambda i: i <= F.size(values))
    parts = F.transform(first, lambda i: over(F.slice(values, i, STRETCH)))

    def joined(parts: Column) -> Column:
        ahead = over(F.transform(parts, lambda p: p["at"]))["out"]
        return F.flatten(F.zip_with(parts, ahead, lambda p, at: F.transform(p["out"], lambda x: x + at)))

    return F.element_at(F.transform(F.array(parts), joined), 1)


def spans_of(text: Column, pattern: str, kind: int, least: int, group: int) -> Column:
    """Leftmost non-overlapping matches whose group has ``least`` characters, as spans in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    size = lambda xs: F.transform(xs, lambda x: F.length(x).cast("long"))
    valued = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    given = F.struct(size(F.split(text, pattern, -1)).alias("gap"), size(found).alias("n"), size(valued).alias("v"))

    def placed(g: Column) -> Column:
        whole = F.struct(g["n"].alias("n"), g["v"].alias("v"), g["gap"].alias("gap"), _before(F.zip_with(g["gap"], g["n"], lambda x, y: x + F.coalesce(y, F.lit(0)))).alias("at"))

        def spans(w: Column) -> Column:
            starts = F.zip_with(w["at"], w["gap"], lambda x, y: x + y)
            cut = F.arrays_zip(starts.alias("start"), w["n"].alias("n"), w["v"].alias("v"))
            some = F.filter(cut, lambda p: p["v"] >= least)
            return F.transform(some, lambda p: F.struct(p["start"].cast("int").alias("start"), (p["start"] + p["n"]).cast("int").alias("end"), F.lit(kind).alias("kind")))

        return F.element_at(F.transform(F.array(whole), spans), 1)

    spans = F.element_at(F.transform(F.array(given), placed), 1)
    return F.when(text.rlike(pattern), spans).otherwise(F.expr(f"cast(array() as {SPAN})"))


def base_spans(text: Column) -> Column:
    kinds = [spans_of(text, p, i, least, group) for i, (_, p, least, group) in enumerate(KINDS)]
    return F.array_sort(F.concat(*kinds))


def _codes(token: Column) -> Column:
    """States that a token passes: its characters' places in the alphabet, and the end before and after."""
    chars = F.split(token, "")
    places = F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c))
    return F.concat(F.array(F.lit(0)), places, F.array(F.lit(0)))


def _long(values: Column, least: int) -> Column:
    return F.filter(values, lambda x: F.length(x) >= least)


def labelled_samples(docs: DataFrame, sample_docs: int) -> DataFrame:
    """(token, label) of the documents with the smallest hashes: 1 random, 0 ordinary."""
    ids = docs.select("id").where("id IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    few = docs.join(ids.hint("broadcast"), "id").select("text")  # sample_docs rows
    values, *keys = [_long(F.regexp_extract_all("text", F.lit(p), F.lit(g)), least) for _, p, least, g in KINDS]
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/_=-]{4,}+"), F.lit(0)))
    found = few.select(F.array_distinct(F.concat(*keys)).alias("keys"), values.alias("values"), words.alias("words"))
    digest = lambda w: F.regexp_replace(F.base64(F.unhex(F.sha2(w, 256))), "=", "")
    random = found.select(F.explode(F.concat("keys", F.transform(F.slice("words", 1, 10), digest))).alias("token"), F.lit(1).alias("label"))
    # a long one with digits may be a secret itself
    plain = F.filter(F.array_except("words", F.concat("keys", "values")), lambda w: (F.length(w) < 20) | ~w.rlike("[0-9]"))
    some = F.filter(F.slice("words", 1, 40), lambda w: w.rlike("^[A-Za-z]+$"))
    named = F.transform(some, lambda w, i: F.concat(w, F.get(F.array(*[F.lit(x) for x in "_-/"], F.lit("")), i % 4), F.when(i % 8 < 4, w).when(i % 16 < 12, F.upper(w)).otherwise(F.initcap(w))))
    plain = found.select(F.explode(F.concat(plain, named)).alias("token"), F.lit(0).alias("label"))
    return random.unionByName(plain)


def fit_markov(samples: DataFrame, smoothing: float = 5.0) -> list[float]:
    """Log-likelihood ratio, random over ordinary, of each transition, row by row: STATES x STATES numbers.

    samples: (token, label). Counts are summed by Spark; what is collected is bounded by the alphabet."""
    codes = samples.select("label", _codes(F.col("token")).alias("c"))
    pairs = codes.select(
        "label",
        F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.get("c", i) * STATES + F.get("c", i + 1))).alias("pair"),
    )
    counts = {(r["label"], r["pair"]): r["n"] for r in pairs.groupBy("label", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}

    import math

    def logs(label: int) -> list[float]:
        to = [sum(counts.get((label, a * STATES + b), 0) for a in range(STATES)) + 0.5 for b in range(STATES)]
        out: list[float] = []
        for a in range(STATES):
            row = [counts.get((label, a * STATES + b), 0) + smoothing * to[b] / sum(to) for b in range(STATES)]
            whole = math.log(sum(row))
            out += [math.log(x) - whole for x in row]
        return out

    return [round(a - b, 5) for a, b in zip(logs(1), logs(0))]


def markov_score(token: Column, model: list[float]) -> Column:
    """Sum of the log-likelihood ratios of the token's transitions."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    codes = _codes(token)
    zero = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))
    return F.aggregate(
        F.slice(codes, 2, 100_000_000),
        zero,
        lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.get(table, acc["last"] * STATES + c)).alias("sum")),
    )["sum"]


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: list[float] | None = None,
    sample_docs: int = 2000,
    least_score: float = 15.0,
    least_mean: float = 1.0,
) -> DataFrame:
    """(id, base, spans): spans the patterns find, and all spans with those of the models, by
    start, then kind. Added spans touch no base span. model: of fit_markov, else trained here."""
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text"))
    if model is None:
        model = fit_markov(labelled_samples(docs, sample_docs))
    tokens = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    kind = len(KINDS)
    has = F.col("text").rlike(TOKEN)
    none = F.expr(f"cast(array() as {SPAN})")
    rows = docs.select("id", base_spans(F.col("text")).alias("base"), F.when(has, tokens).alias("tokens"), F.when(has, spans_of(F.col("text"), TOKEN, kind, 20, 0)).alias("at"))
    pairs = F.arrays_zip(F.col("tokens").alias("token"), F.col("at").alias("at"))
    score = lambda p: markov_score(p["token"], model)
    enough = lambda s, p: (s >= least_score) & (s >= least_mean * F.length(p["token"]))
    random = F.filter(pairs, lambda p: F.exists(F.array(score(p)), lambda s: enough(s, p)))
    free = F.filter(random, lambda p: ~F.exists("base", lambda b: (b["start"] < p["at"]["end"]) & (p["at"]["start"] < b["end"])))
    added = F.coalesce(F.transform(free, lambda p: p["at"]), none)
    return rows.select("id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k, *_ in KINDS], F.lit("markov"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    """Per document: counts of base matches by kind, digest of base spans, all spans."""
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    found = scan(docs)
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        *[count(i).alias(f"n_{k}") for i, (k, *_) in enumerate(KINDS)],
        F.sha2(shown(F.col("base")), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )
