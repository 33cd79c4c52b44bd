"""Toxicity, hard negatives and collocations: brute force, held-out labels, odd rows."""

import collections
import os
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnweave.llm import collocations, hard_negatives, toxicity
from turnweave.llm.common import Scratch
from turnweave.llm.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def rows(pdf):
    show = lambda v: "nan" if v is None or v != v else f"{float(v):.6f}" if isinstance(v, (int, float)) else str(v)
    return sorted(pdf[sorted(pdf.columns)].map(show).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_collocations"])
def test_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert rows(queries()[name](spark, SF).toPandas()) == rows(con.execute(oracle_sql()[name]).df())


# collocations


def brute_collocations(docs, least, longest=4, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(c, "\n")
        for piece in low.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, min(longest, len(w) - i) + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), a in cand.items():
        for i in range(len(w)):
            for k in range(2, len(w)):
                part = (lang, w[i : i + k])
                if len(part[1]) == k and 100 * a >= 80 * f[part]:
                    gone.add(part)
    out = collections.defaultdict(list)
    for (lang, w), a in cand.items():
        if (lang, w) not in gone:
            score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1))


def drawn(seed, n):
    draw = random.Random(seed)
    words = ["a", "B", "b\x01", "b", "\u00e9", "the", "of the", "\x00", "ab", "new york city hall", "#"]
    return [(draw.choice(["en", "de", None, "und"]), "".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(draw.randrange(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize(("least", "part_rows", "chunk", "bits"), [(5, 7, 40, 64), (3, 500, 1 << 21, 1 << 20), (30, 3, 200, 128)])
def test_collocations_are_those_of_brute_force(spark, monkeypatch, least, part_rows, chunk, bits):
    """Over many small parts and stretches, with a bitmap that says yes to nearly all."""
    monkeypatch.setattr(collocations, "PART_ROWS", part_rows)
    docs = [*drawn(least, 150), (None, None), ("en", ""), ("fr", "one two")]
    df = spark.createDataFrame([(lang, t, i, 1) for i, (lang, t) in enumerate(docs)], "lang string, text string, doc_id long, f int")
    scratch = Scratch(spark, "test")
    given = df.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    stream, totals = collocations.phrase_stream(given, scratch, 4, least, bits)
    assert totals.agg(F.sum("total")).first()[0] == sum(x[6] for x in {(y[0],) + (0,) * 5 + (y[6],) for y in brute_collocations(docs, 1)})
    got = sorted(tuple(r) for r in collocations.collocations(df, least=least).collect())
    assert got == brute_collocations(docs, least)
    held = [x for t in docs for x in collocations._stretches([t[1]], 4)]
    assert sum(own for x in held for _, _, own in x) == sum(len((t or "").encode()) for _, t in docs)


def test_long_texts_are_counted_in_stretches(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 50)
    texts = [" ".join(f"w{i % 7}" for i in range(500)) + ". end", None, "x" * 300]
    for n in (1, 2, 4):
        ones = np.full(1 << 10, 255, np.uint8)
        got = collections.Counter()
        for held in collocations._stretches(texts, n):
            for lang, phrase, f in zip(*(x.to_pylist() if hasattr(x, "to_pylist") else x.tolist() for x in collocations.count_phrases(held, ["en"] * 3, n, ones if n > 1 else None)), strict=True):
                got[phrase] += f
        want = collections.Counter()
        for w in ([f"w{i % 7}" for i in range(500)], ["end"], ["x" * 300]):
            want.update(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
        assert got == want


def test_collocations_of_nothing(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(none).count() == 0
    few = spark.createDataFrame([("en", "a b c")], "lang string, text string")
    assert collocations.collocations(few).count() == 0


# hard negatives


def brute_negatives(rows_, least=0):
    ok = [(i, lab, v) for i, lab, v in rows_ if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ok = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v in ok]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, la, va in ok:
        if a % 100:
            continue
        scored = [(-dot(va, v), i, lab) for i, lab, v in ok if i != a]
        for s, p, _ in sorted(x for x in scored if x[2] == la)[:5]:
            inside = sorted(x for x in scored if x[2] != la and 80 * -s <= 100 * -x[0] <= 100 * -s)[:5]
            out += [(a, p, k, i, -s, -t) for k, (t, i, _) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_are_those_of_brute_force(spark, monkeypatch, tmp_path, seed):
    monkeypatch.setattr(hard_negatives, "BLOCK", 32)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 2)
    monkeypatch.setattr(hard_negatives, "STEP", 20)
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, 9)) * 2
    rows_ = [(int(i), int(r.integers(10)), [float(x) for x in (centres[i % 6] + r.normal(size=9) * (0.1 if seed == 1 else 1.5))]) for i in range(0, 1200, 3)]
    rows_ += [(5000 + i, int(i % 10), rows_[0][2]) for i in range(60)]  # copies of an anchor's vector, all at one score
    rows_ += [(6001, None, [1.0] * 9), (6002, 1, None), (6003, 1, [float("nan")] + [1.0] * 8), (6100, 3, [None] + [1.0] * 8), (None, 1, [1.0] * 9), (6200, 4, [0.5] * 4), (6300, 2, [0.0] * 9), (6301, 2, [])]
    spark.createDataFrame([(*x, "y") for x in rows_], "vec_id long, label int, embedding array<float>, v string").write.parquet(f"{tmp_path}/embeddings.parquet")
    kept = [(r_.vec_id, r_.label, r_.embedding) for r_ in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    got = sorted(map(tuple, hard_negatives.op12_hard_negatives(spark, str(tmp_path)).collect()))
    assert got == brute_negatives(kept) and len(got) > 50


def test_cells_come_by_falling_bound_and_hold_all_rows():
    r = np.random.default_rng(3)
    m = r.integers(-300, 300, (500, 10))
    books = (hard_negatives.codebook(m[:, :5].astype(float), 8), hard_negatives.codebook(m[:, 5:].astype(float), 8))
    index = hard_negatives.Index(books, np.arange(500), np.zeros(500, np.int64), m)
    for a in m[:20]:
        seen, bounds = [], []
        for bound, lo, hi in index.cells(a):
            s = index.scores(a, np.arange(lo, hi))
            assert s.max() <= bound and (s == index.m[lo:hi] @ a).all()
            seen += index.ids[lo:hi].tolist()
            bounds.append(bound)
        assert sorted(seen) == list(range(500)) and bounds == sorted(bounds, reverse=True)


def test_few_cells_are_visited_where_vectors_cluster(monkeypatch):
    monkeypatch.setattr(hard_negatives, "STEP", 50)
    r = np.random.default_rng(4)
    m = np.concatenate([r.normal(c, 3, (100, 8)) for c in r.normal(0, 300, (16, 8))]).astype(np.int64)
    books = tuple(hard_negatives.codebook(x.astype(float), 16) for x in (m[:, :4], m[:, 4:]))
    index = hard_negatives.Index(books, np.arange(1600), np.repeat(np.arange(16), 100), m)
    looked = []
    whole = index.scores
    index.scores = lambda a, rows: looked.append(len(rows)) or whole(a, rows)
    for i in range(0, 1600, 100):
        s, _ = hard_negatives.positives(index, m[i], i, i // 100, 5)
        assert s.tolist() == sorted((m[i // 100 * 100 : i // 100 * 100 + 100] @ m[i])[np.arange(100) != 0].tolist(), reverse=True)[:5]
    assert sum(looked) < 16 * 200  # of 16 * 1600


def test_hard_negatives_of_nothing(spark, tmp_path):
    shape = "vec_id long, embedding array<float>, label int"
    for name, given in (("none", []), ("lone", [(100, [1.0, 2.0], 1)])):
        spark.createDataFrame(given, shape).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        assert hard_negatives.op12_hard_negatives(spark, f"{tmp_path}/{name}").count() == 0


# toxicity


def test_words_are_compared_without_disguise():
    assert toxicity.plain("Idiot!!!") == ("idiot", False) and toxicity.plain("1d10t") == ("idiot", True) and toxicity.plain("m0r@n,") == ("moran", True)
    assert toxicity.plain("don't") == ("don't", False) and toxicity.plain("123") == ("123", False) and toxicity.plain("***") == ("", False)
    assert toxicity.stems("scum") == ["scu", "scum", "scum "] and toxicity.stems("a") == []


def test_features_of_texts():
    words = toxicity.Words({"scum ": 2.0, "idio": 3.0})
    texts = ["You are SCUM! really", "nothing here", None, "", "x idiots x x x x x x x x x x x x you", "i d i o t", "soooo b@d?? WOW"]
    x = dict(zip(toxicity.FEATURES, toxicity.features(texts, words).T, strict=True))
    assert x["lexicon_density"].tolist()[:5] == [0.25, 0, 0, 0, 1 / 15] and x["largest_weight"].tolist()[:2] == [2.0, 0.0]
    assert x["near_second_person"].tolist()[0] == 1 and x["near_second_person"].tolist()[4] == 0 and x["closeness"][0] == pytest.approx(1 / 3)
    assert x["capital_words"][0] == 0.25 and x["exclamations"][0] == pytest.approx(1 / 20) and x["stretched_words"][6] == pytest.approx(1 / 3)
    assert x["obfuscated_words"][6] == pytest.approx(1 / 3) and x["repeated_punctuation"][6] == pytest.approx(1 / 3)
    whole = toxicity.features(texts, words)
    assert np.isfinite(whole).all() and np.array_equal(whole[2], whole[3]) and np.array_equal(np.concatenate([toxicity.features([t], words) for t in texts]), whole)


def made(n, seed):
    """Texts of which a tenth insult in one of two ways; ids of both folds."""
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 8))) for _ in range(300)]
    out = []
    for i in range(n):
        w = draw.choices(words, k=draw.randrange(20, 120))
        bad = draw.random() < 0.25
        if bad:
            for _ in range(max(1, len(w) // 30)):
                w[draw.randrange(len(w))] = draw.choice(["moron", "you scum", "sc\u00fcm", "m0r0n"])
        out.append((i, " ".join(w), int(bad)))
    return out


def test_toxic_texts_are_found_in_the_held_out_fold(spark):
    given = made(1200, 7)
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in given], "doc_id long, text string, __margin string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in given], "doc_id long, toxic int")
    model = toxicity.fit(docs.drop("__margin"), labels)
    got = {r.doc_id: r for r in toxicity.score(docs.drop("__margin"), model).withColumn("h", toxicity.held_out()).collect()}
    held = [(got[i].score, y) for i, _, y in given if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 300 and sum(got[i].h for i, _, _ in given) == len(held)
    assert np.mean([(s >= 0.7) == bool(y) for s, y in held]) > 0.95
    wrong = labels.where(~toxicity.held_out()).unionByName(labels.where(toxicity.held_out()).select("doc_id", (1 - F.col("toxic")).alias("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs.select("doc_id", "text"), wrong)).collect()}
    assert all(again[i] == got[i].score for i in again)  # labels of the held-out fold do not matter


def test_toxicity_without_labels_of_both_kinds(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (1, None), (None, ""), (2, "x")], "doc_id long, text string")
    for name, given, want in (("none", [], 0.5), ("clean", [(1, 0), (2, 0)], 0.0)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(given, "doc_id long, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = toxicity.op11_toxicity(spark, f"{tmp_path}/{name}").collect()
        assert len(got) == 4 and {r.score for r in got} == {want} and {r.predicted for r in got} == {0}


def test_toxicity_of_odd_rows(spark, tmp_path):
    given = [*[(i, t, y) for i, t, y in made(300, 9)], (900, None, 1), (901, "", 0), (901, "twice", 1), (None, "moron moron", 1)]
    spark.createDataFrame([(i, t) for i, t, _ in given], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in given] + [(2, None), (5, 7)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op11_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(given) and all(0 <= r.score <= 1 for r in got)
    empty = f"{tmp_path}/empty"
    os.makedirs(empty)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert toxicity.op11_toxicity(spark, empty).count() == 0


def test_words_are_cut_in_linear_time_and_told_once():
    """A long row of signs between letters once took time with the square of its length; a table of more words than are held says the same."""
    began = time.time()
    assert toxicity.plain("a" + "=" * 40_000 + "b") == ("ab", True) and time.time() - began < 5
    for word, want in (("_'Idiot!!", ("idiot", False)), ("m0r\u00f6n", ("mor\u00f6n", True)), ("===", ("", False)), ("\u0130x", ("ix", True)), ("a=_", ("a", False))):
        assert toxicity.plain(word) == want
    words, given = toxicity.Words({"idi": 2.0}), [w.encode() for w in ("idiot", "you", "UP", "a!!", "m0ron", "sooo", "\u00df")]
    for _ in range(2):
        assert [tuple(r) for r in words.table(given)] == [tuple(map(float, words.told(w.decode()))) for w in given]
        assert len(words.table([f"w{i}".encode() for i in range(toxicity.KNOWN + 1)])) > toxicity.KNOWN  # the next call begins anew
