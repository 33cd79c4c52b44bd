"""Edited near copies go, whatever their fingerprints, and only they."""

from functools import lru_cache

import numpy as np

import corpus_pipeline
from turnweave.llm import near_sets
from turnweave.llm.common import Scratch
from turnweave.llm.simhash import fingerprint, fingerprints, keep_one

VOCABULARY = ["w%d" % i for i in range(5000)]


@lru_cache(None)
def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / max(len(a | b), 1)


def texts():
    r = np.random.default_rng(5)
    passage = " ".join(r.choice(VOCABULARY, 40))
    out = []
    for k in range(60):
        w = list(r.choice(VOCABULARY, int(r.integers(60, 200))))
        out.append(passage + " " + " ".join(w))  # all meet at the passage
        for edits in (1, 2, 3, 6):
            c = w.copy()
            for p in r.integers(0, len(w), edits):
                c[p] = "new%d" % r.integers(1000)
            out.append(passage + " " + " ".join(c))
    return [*out, "", None, "few words only"]


def test_similar_pairs_are_brute_force(spark, monkeypatch):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_sets, "CHUNK", 500)
    scratch = Scratch(spark, "test")
    prints = scratch.write("prints", fingerprints(docs, digest=True))
    got = {frozenset((r.a, r.b)) for r in near_sets.similar_pairs(docs, prints, scratch).collect()}
    fp = [int(np.uint64(fingerprint(t)).view(np.int64)) for _, t in rows]
    whole = [t or "" for _, t in rows]
    want = {frozenset((fp[i], fp[j])) for i in range(len(rows)) for j in range(i) if fp[i] != fp[j] and jaccard(whole[i], whole[j]) >= 0.8}
    assert got == want and len(want) > 50


def test_edited_near_copy_leaves_the_pipeline(spark, tmp_path):
    held = texts()
    a, b = next((x, y) for x in held[:300] for y in held[:300] if x != y and jaccard(x, y) >= 0.8 and (fingerprint(x) ^ fingerprint(y)).bit_count() > 4)
    docs = spark.createDataFrame([(1, a), (2, b), (3, "other " * 3 + held[150])], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, str(tmp_path)).collect()} == {1, 3}


def test_groups_of_given_documents_are_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    ids = np.array([i for i, _ in rows])
    fp = np.array([fingerprint(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= 4
    near |= np.array([[jaccard(a, b) >= 0.8 for _, b in rows] for _, a in rows])
    least = ids
    while not np.array_equal(nxt := np.array([least[m].min() for m in near]), least):
        least = nxt
    assert sorted(r.doc_id for r in keep_one(docs, similar=True).collect()) == sorted(ids[ids == least].tolist())


def test_a_shingle_of_many_texts_makes_no_pairs(spark):
    r = np.random.default_rng(8)
    passage = " ".join(r.choice(VOCABULARY, 5))
    rows = [(i, " ".join(r.choice(VOCABULARY, 30)) + " " + passage + " " + " ".join(r.choice(VOCABULARY, 30))) for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scratch = Scratch(spark, "test-order")
    prints = fingerprints(docs, digest=True)
    sets = near_sets.SimilarSets(docs, prints, scratch)
    assert sets.posted.where("n > 0").count() < 4000  # the passage is in no prefix; with a word before or after it, it is rare
    assert sets._met(None, near_sets._cross_pairs).count() < 5000
    assert near_sets.similar_pairs(docs, prints, scratch).count() == 0


def test_a_text_that_many_meet_is_confirmed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(near_sets, "HOT", 3)
    r = np.random.default_rng(9)
    base = list(r.choice(VOCABULARY, 120))
    rows = [(0, " ".join(base))]
    for i in range(1, 30):
        w = base.copy()
        w[int(r.integers(len(w)))] = f"new{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = fingerprints(docs, digest=True)
    of = {p.fp: p.id for p in prints.collect()}
    got = {tuple(sorted((of[p.a], of[p.b]))) for p in near_sets.similar_pairs(docs, prints, Scratch(spark, "test-hot")).collect()}
    want = {(a, b) for a in range(30) for b in range(a + 1, 30) if jaccard(rows[a][1], rows[b][1]) >= 0.8}
    assert len(of) == 30 and got == want and len(want) > 100
    assert [x.doc_id for x in keep_one(docs, similar=True).collect()] == [0]
