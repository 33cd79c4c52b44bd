"""Rows that share an id, or have none, are judged each by their own text."""

from collections import Counter

import numpy as np

from turnweave.llm import line_dedup, mixing, simhash

SHARED = "a line that many hold"


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdefgh"), 6)) for _ in range(n))


def test_lines_of_rows_with_one_id(spark):
    rows = [(i, f"own {i}\n{SHARED}") for i in range(12)]
    rows += [(None, f"one\ntwo\nthree\nfour\n{SHARED}"), (None, "one clean\ntwo clean\nthree clean\nfour clean\nfive clean"), (None, "short")]
    rows += [(50, f"{SHARED}\nrest"), (50, "clean\nlines"), (50, "clean\nlines")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter((i, "\n".join(x for x in t.split("\n") if x != SHARED)) for i, t in rows)
    assert Counter((r.doc_id, r.text) for r in line_dedup.dedup_lines(d).collect()) == want


def test_first_line_is_kept_once(spark):
    d = spark.createDataFrame([(0, f"{SHARED}\na"), (0, f"{SHARED}\nb"), *[(i, f"{SHARED}\n{i}") for i in range(1, 12)]], "doc_id long, text string")
    out = [r.text for r in line_dedup.dedup_lines(d, keep_first=True).collect()]
    assert sum(SHARED in t for t in out) == 1 and len(out) == 13


def test_each_group_keeps_a_document(spark):
    a, b = prose(80, 1), prose(80, 2)
    d = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (None, a), (None, b)], "doc_id long, text string")
    assert Counter((r.doc_id, r.text) for r in simhash.keep_one(d).collect()) == Counter([(1, a), (2, b), (None, a), (None, b)])


def test_mix_takes_its_target_of_rows_with_one_id(spark):
    rows = [(None if i % 2 else 7, prose(700 + i, i), s) for i in range(40) for s in ("a", "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed_documents(d).collect()
    sizes, taken = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    for r in out:
        taken[r.source] += len(r.text.split())
    level = sum(sizes.values()) / 3  # weights 1 and 2
    assert abs(taken["a"] - level) <= 256 and abs(taken["b"] - 2 * level) <= 256


def test_repeated_ids_beyond_a_list_are_told_apart_all_the_same(spark, monkeypatch):
    from turnweave.llm import suffix_dedup

    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long), (1, long + " more"), (2, "x " + long), (None, long), (2, "short"), (1, long), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shown = lambda: sorted((str(r.id), r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffix_dedup.dedup_spans(docs).collect())
    short = shown()
    monkeypatch.setattr(suffix_dedup, "SHORT", 0)
    assert shown() == short and sum(r[2] for r in short) > 3 * len(long)
