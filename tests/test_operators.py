import os

import duckdb
import pytest
from pyspark.sql import functions as F

from turnweave.operators import articles, knowledge, mentions, pages, ranges, related, search
from turnweave.operators import transcripts as t
from turnweave.plans.catalog import QUERIES, SQL
from turnweave.streaming import audience, incremental

SF = "/root/testdata/sf0.001"


def rows(pdf):
    show = lambda v: "nan" if v is None or v != v else f"{float(v):.6f}" if isinstance(v, (int, float)) else str(v)
    return sorted(pdf[sorted(pdf.columns)].map(show).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "labels", "benchmark", "events", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.execute(SQL[name]).df())


def test_turn_issues(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "a"), (1, 2, "user", " "), (1, 2, "assistant", "b"), (2, 1, "user", None)], "conv_id long, turn long, role string, text string"
    )
    found = {(r.conv_id, r.turn, r.issue) for r in t.validate_turns(turns).collect()}
    assert {(1, 2, "duplicate"), (1, 2, "gap"), (1, 2, "blank"), (2, 1, "gap"), (2, 1, "blank")} <= found


def test_merge_joins_neighbours_of_one_role(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x" * 50), (1, 1, "assistant", "ok"), (1, 2, "user", "y" * 50)], "conv_id long, turn long, role string, text string")
    (row,) = t.merge_turns(turns).collect()
    assert (row.n_merged, row.text) == (2, "x" * 50 + " " + "y" * 50)


def test_canonical_pages_share_a_url(spark):
    rows_ = [(3, "https://www.a.org/x?ref=1", ""), (2, "http://m.a.org/x/#top", ""), (5, "https://a.org/y", ""), (6, "https://a.org/z/?a=1?b=2#c", None)]
    found = pages.canonical_pages(spark.createDataFrame(rows_, "page_id long, url string, html string")).collect()
    assert {tuple(r) for r in found} == {("a.org/x", 2, 2), ("a.org/y", 5, 1), ("a.org/z", 6, 1)}


def test_page_text_drops_scripts_and_decodes_once(spark):
    html = '<html lang="en"><h1>A &amp; B</h1><article><p>one</p><script>"</p>"</script>&amp;lt; two</article><footer>no</footer></html>'
    (row,) = pages.pages_to_text(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).collect()
    assert tuple(row) == (1, "en", "A & B", "one &lt; two")


def test_summary_keeps_order_and_skips_texts_without_letters(spark):
    docs = spark.createDataFrame([(1, "rare words here. the. odd thing!"), (2, "the the the."), (3, "12 34."), (4, None)], "doc_id long, text string")
    found = {r.doc_id: r.summary for r in articles.summarize(docs).collect()}
    assert found == {1: "rare words here. odd thing!", 2: "the the the."}


def test_leftmost_longest_mentions(spark):
    turns = spark.createDataFrame([(1, 0, "A b c d, b c! a b"), (1, 1, None)], "conv_id long, turn long, text string")
    names = spark.createDataFrame([("a b",), ("b c d",), ("a b c",), ("b c",), ("b c",)], "phrase string")
    found = sorted((r.turn, r.pos, r.phrase) for r in mentions.link_mentions(turns, names).collect())
    assert found == [(0, 0, "a b c"), (0, 4, "b c"), (0, 6, "a b")]


def test_cooccurrence_stays_in_reach_and_turn(spark):
    rows_ = [(1, 0, 0, "a"), (1, 0, 3, "b"), (1, 0, 9, "a"), (1, 1, 4, "c"), (1, 0, 12, "a")]
    edges = mentions.cooccurrence(spark.createDataFrame(rows_, "conv_id long, turn long, pos long, phrase string"), 6)
    assert [tuple(r)[:3] for r in edges.collect()] == [("a", "b", 2)]


def test_ranks_sum_to_one_and_prefer_the_hub(spark):
    edges = spark.createDataFrame([("hub", x, 1) for x in "abc"] + [("a", "b", 1)], "src string, dst string, n long")
    ranks = {r.phrase: r.rank for r in mentions.rank_entities(edges, 20).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-6 and max(ranks, key=ranks.get) == "hub" and ranks["a"] == ranks["b"] > ranks["c"]
    assert mentions.rank_entities(edges.limit(0)).count() == 0


def test_measures(spark):
    ranking = spark.createDataFrame([(1, 1, 7), (1, 2, 8), (1, 3, 9), (2, 1, 7)], "item_id long, rank long, doc_id long")
    relevant = spark.createDataFrame([(1, 8), (1, 5), (3, 1)], "item_id long, doc_id long")
    found = {r.item_id: (r.recall, r.rr, r.ndcg) for r in search.evaluate(ranking, relevant).collect()}
    assert found == {1: (0.5, 0.5, 0.386853), 3: (0.0, 0.0, 0.0)}
    fused = search.fuse([ranking, ranking.where("rank > 1")]).where("item_id = 1").orderBy("rank").collect()
    assert [r.doc_id for r in fused] == [8, 9, 7]


def test_labels_beyond_the_bound_are_refused(spark):
    rows_ = spark.createDataFrame([([1.0], 0), ([2.0], 1), (None, 1), ([3.0], None)], "embedding array<double>, label int")
    assert sorted(map(tuple, mentions.centroid_classify(rows_).collect())) == [(0, 0, 1), (1, 1, 1)]
    with pytest.raises(ValueError):
        mentions.centroid_classify(rows_, 1)


def events_in_files(spark, folder):
    for lo in (0, 10, 20):
        spark.range(lo, lo + 10, 1, 1).selectExpr(
            "id AS event_id", "timestamp_seconds(1700000000 + id) AS ts", "id % 3 AS user_id", "if(id % 4 = 0, 'purchase', 'view') AS event_type", "id / 4.0D AS value"
        ).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_user_state_of_a_stream_ends_as_the_batch_does(spark, tmp_path):
    stream = events_in_files(spark, str(tmp_path / "in"))
    run = audience.user_state(stream).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True)
    run.option("checkpointLocation", str(tmp_path / "log")).start().awaitTermination()
    assert sorted(spark.table("totals").collect()) == sorted(audience.user_state(spark.read.parquet(str(tmp_path / "in"))).collect())


def test_a_batch_that_comes_again_counts_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "parts")
    for i in range(3):
        spark.createDataFrame([(i, "one two two")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
    read = lambda: spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(source)
    for log in ("a", "b"):  # a lost log: every batch comes again
        incremental.incremental(read(), target, str(tmp_path / log)).awaitTermination()
    assert sorted(map(tuple, incremental.stored(spark, target).collect())) == [("one", 3, 3), ("two", 3, 6)]


def test_articles_without_questions_or_letters(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Why so?"), (1, 1, "assistant", "Because."), (2, 0, "system", "12")], "conv_id long, turn long, role string, text string")
    made = articles.assemble_articles(turns)
    found = {r.conv_id: (r.tags, r.summary, [tuple(s) for s in r.sections]) for r in made.collect()}
    assert found[1][2] == [(0, "Why so?", "Because.")] and found[2] == ([], None, [])
    assert sorted(map(str, articles.read_articles(articles.articles_json(made)).collect())) == sorted(map(str, made.collect()))


def streamed(spark, df, name, log, mode):
    run = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    run.option("checkpointLocation", str(log)).start().awaitTermination()
    return sorted(map(tuple, spark.table(name).collect()))


def test_windows_and_sessions_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    stream = events_in_files(spark, str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    for i, f in enumerate((lambda e: audience.engagement(e, "10 seconds"), lambda e: audience.engagement(e, "10 seconds", "5 seconds"), lambda e: audience.sessions(e, "4 seconds"))):
        assert streamed(spark, f(stream), f"windows{i}", tmp_path / f"log{i}", "complete") == sorted(map(tuple, f(batch).collect()))


def test_repeated_events_of_a_stream_come_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    events_in_files(spark, folder)
    spark.read.parquet(folder).where("event_id % 2 = 0").write.mode("append").parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = streamed(spark, audience.dedup_stream(stream).select("event_id"), "once", tmp_path / "log", "append")
    assert got == [(i,) for i in range(30)] == sorted(map(tuple, audience.dedup_stream(spark.read.parquet(folder)).select("event_id").collect()))


def test_means_of_one_half_classify_the_other(spark):
    rows_ = spark.createDataFrame([(0, [1.0], 0), (2, [9.0], 1), (4, [2.0], 0), (1, [8.0], 1), (3, [4.0], 1), (None, [9.0], 1)], "vec_id long, embedding array<double>, label int")
    got = mentions.centroid_classify(rows_, learn=F.col("vec_id") % 2 == 0).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1), (1, 1, 2)]


def test_mentions_of_any_length(spark):
    turns = spark.createDataFrame([(1, 0, "a b c d e f, x")], "conv_id long, turn long, text string")
    names = spark.createDataFrame([("x",), ("b c d e f",), ("b c",)], "phrase string")
    assert [(r.pos, r.phrase) for r in mentions.link_mentions(turns, names).orderBy("pos").collect()] == [(1, "b c d e f"), (6, "x")]
    assert mentions.link_mentions(turns, names.limit(0)).count() == 0


def test_paths_keep_their_case(spark):
    rows_ = [(1, "HTTPS://WWW.A.org/X", ""), (2, "https://a.org/x", ""), (3, "https://a.ORG/x/?y", ""), (4, None, "")]
    found = pages.canonical_pages(spark.createDataFrame(rows_, "page_id long, url string, html string")).collect()
    assert {tuple(r) for r in found} == {("a.org/X", 1, 1), ("a.org/x", 2, 2), (None, 4, 1)}


def test_repeated_roles_and_turns_in_any_order(spark):
    rows_ = [(1, 0, "user", "b"), (1, 0, "assistant", "a"), (1, 1, "user", "c"), (1, 2, "user", "d")]
    shape = "conv_id long, turn long, role string, text string"
    found = [sorted(map(tuple, t.validate_turns(spark.createDataFrame(r, shape).repartition(3)).collect())) for r in (rows_, rows_[::-1])]
    assert found[0] == found[1] and (1, 2, "role_repeated") in found[0] and (1, 1, "role_repeated") in found[0]


def test_terms_of_a_row_are_counted(spark):
    docs = spark.createDataFrame([(1, "B a b, A b."), (2, None), (3, "12 !"), (4, "")], "doc_id long, text string")
    assert sorted(map(tuple, knowledge.term_counts(docs).collect())) == [(1, "a", 2), (1, "b", 3)]
    assert sorted(map(tuple, knowledge.collocations(docs, 1).select("a", "b", "n").collect())) == [("a", "b", 2), ("b", "a", 2)]


def _shuffled(spark) -> int:
    """Bytes that this session's tasks have sent so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    return context.statusStore().executorSummary("driver").totalShuffleWrite()


def test_pairs_are_sent_as_numbers(spark):
    import random

    draw = random.Random(3)
    names = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyzé", k=200)) for _ in range(1000)]
    docs = spark.createDataFrame([(i, " ".join(draw.choices(names, k=400))) for i in range(100)], "doc_id long, text string")
    before = _shuffled(spark)
    assert knowledge.collocations(docs, 2).count() > 100
    assert _shuffled(spark) - before < 4_000_000  # two terms of 200 letters for each of some 39,000 pairs would be 15 MB


def test_collocations_of_terms_whose_numbers_clash(spark):
    import math
    import random
    from collections import Counter

    from turnweave.functions.text import word_list

    draw = random.Random(4)
    texts = [None, "", "12 !", "a", *(" ".join(draw.choices(["A", "b", "c,", "d.", "\u03a3\u03a3", "\U00010400x"], [30, 9, 5, 3, 2, 1], k=draw.randrange(40))) for _ in range(200))]
    found = [word_list(t or "") for t in texts]
    one, two = Counter(w for t in found for w in t), Counter(p for t in found for p in zip(t, t[1:]))
    want = {(a, b): (n, math.log(n * sum(one.values()) / (one[a] * one[b]))) for (a, b), n in two.items() if n >= 20}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert knowledge.numbered_terms(knowledge.occurrences(docs), 4)[1] > 0  # the first seed gives two terms one number
    for bits in (4, 64):
        got = {(r.a, r.b): (r.n, r.pmi) for r in knowledge.collocations(docs, 20, bits).collect()}
        assert got.keys() == want.keys() and len(two) > len(want) > 3
        assert all(got[k][0] == n and abs(got[k][1] - pmi) < 1.1e-5 for k, (n, pmi) in want.items())
    with pytest.raises(RuntimeError, match="share a number"):
        knowledge.collocations(docs, 20, 1)


def test_coded_words_are_the_words():
    import pyarrow as pa

    from turnweave.functions.text import coded_words, pieces, words

    some = ["B a b, A b.", None, "", "12 !", "\u039f\u0394\u039f\u03a3 \u03a3\u0391\u03a3", "\u0130stanbul \u1e9e", "\U00010400\U00010401 x\U00020000y", "\na\nb\n", "a" * 300, "e\u0301a"]
    for texts, most in ((some, 1 << 20), (some, 5), ([None, ""], 5), ([], 5)):
        col = pa.array(texts, pa.string())
        known, code, size = coded_words(col, most)
        assert len(set(known.to_pylist())) == len(known)
        assert known.take(pa.array(code)).to_pylist() == [w for t in words(col) for w in t]
        assert size.tolist() == [len(t) for t in words(col)]
        assert [t for part in pieces(col, most) for t in part.to_pylist()] == texts
    assert coded_words(pa.array([b"ab\xffc"], pa.binary()))[0].to_pylist() == ["ab", "c"]


def test_postings_come_in_blocks(spark):
    docs = spark.createDataFrame([(i, "a b" if i % 2 else "a") for i in (0, 1, 9, 10, 25)], "doc_id long, text string")
    got = sorted(map(tuple, knowledge.inverted_index(docs, 10).collect()))
    assert got == [("a", 0, 5, "0:1,1:1,9:1"), ("a", 1, 5, "10:1"), ("a", 2, 5, "25:1"), ("b", 0, 3, "1:1,9:1"), ("b", 2, 3, "25:1")]


def test_fused_scores_are_those_of_whole_rankings(spark):
    import random

    draw = random.Random(5)
    for few in (3, 1000):  # with many ties, and with rankings that hardly agree
        rows_ = [(item, doc, float(draw.randrange(few)), draw.randrange(few)) for item in (1, 2) for doc in range(300 if item == 1 else 4)]
        found = spark.createDataFrame(rows_, "item_id long, doc_id long, score double, shared long")
        whole = search.fuse([knowledge.best(found, c, 1000) for c in ("score", "shared")])
        assert sorted(map(tuple, search.fuse_scores(found, ["score", "shared"]).collect())) == sorted(map(tuple, whole.collect()))


def test_passages_are_found_inside_words(spark):
    docs = spark.createDataFrame([(1, "an xone two threey b"), (2, "one two, three"), (3, None), (4, "two")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "one two three"), (8, "two"), (9, None)], "item_id long, text string")
    got = search.holding(docs, queries, knowledge.matches(docs, queries)).collect()
    assert sorted(map(tuple, got)) == [(7, 1)]


def test_copies_are_related_whatever_their_number(spark):
    docs = spark.createDataFrame([(i, "one two three") for i in range(30)] + [(40, "one two four"), (41, "four five"), (42, ""), (43, None)], "doc_id long, text string")
    got = {(r.doc_id, r["rank"]): (r.other, r.score) for r in related.related(docs).collect()}
    assert [got[29, k][0] for k in (1, 2, 3)] == [0, 1, 2] and [got[1, k][0] for k in (1, 2, 3)] == [0, 2, 3]
    assert got[0, 1][1] == 1.0 and got[40, 1][1] < 1 and (42, 1) not in got
    assert {r for r in got if r[0] == 41} == {(41, 1)} and got[41, 1][0] == 40


def test_chunks_that_would_not_move_on_are_refused(spark):
    turns = spark.createDataFrame([(1, 0, "a b c")], "conv_id long, turn long, text string")
    assert [r.text for r in t.chunk(turns, 2, 1).orderBy("chunk_no").collect()] == ["a b", "b c"]
    with pytest.raises(ValueError):
        t.chunk(turns, 2, 2)


def test_related_texts_are_those_of_all_products(spark):
    """Against every pair, with blocks and cells smaller than the table."""
    import collections
    import math
    import random

    draw = random.Random(9)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)]
    texts = [" ".join(draw.choices(words, weights=[1 / (i + 1) for i in range(150)], k=draw.randrange(1, 40))) for _ in range(120)]
    docs = spark.createDataFrame([(i * 3, x) for i, x in enumerate(texts)], "doc_id long, text string")
    vectors = related.text_vectors(docs).cache()
    got = collections.defaultdict(list)
    for r in related.most_alike(vectors, 3, block=16, work=400).orderBy("doc_id", F.desc("score"), "other").collect():
        got[r.doc_id].append((r.other, r.score))
    v = {r.doc_id: ({x["term"]: x["w"] for x in r.v}, r.norm) for r in vectors.collect()}
    assert got
    for a, (x, nx) in v.items():
        scored = [(round(sum(w * y.get(t, 0) for t, w in x.items()) / (nx * ny), 6), b) for b, (y, ny) in v.items() if b != a and x.keys() & y.keys()]
        want = sorted(((b, s) for s, b in scored), key=lambda p: (-p[1], p[0]))[:3]
        assert [p[1] for p in got[a]] == pytest.approx([p[1] for p in want], abs=1e-6)
        assert [p[0] for p in got[a]] == [p[0] for p in want] or len({p[1] for p in want}) < 3
    assert math.isclose(v[0][1], math.sqrt(sum(w * w for w in v[0][0].values())))


def test_vectors_are_sent_a_fixed_number_of_times(spark, monkeypatch):
    """However many pairs there are, a block goes to at most a row and a column of MOST_CELLS cells, and is packed."""
    import numpy as np

    docs = spark.createDataFrame([(i, f"{chr(97 + i % 26)} {chr(97 + i // 26)}x") for i in range(200)], "doc_id long, text string")
    vectors = related.text_vectors(docs).cache()
    lit, made = F.lit, []
    monkeypatch.setattr(related.F, "lit", lambda x: (made.append(x), lit(x))[1])
    few = related.most_alike(vectors, 3, block=1, work=1)
    assert max(x for x in made if isinstance(x, int)) <= related.MOST_CELLS**0.5
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(few) == key(related.most_alike(vectors, 3))
    x = np.arange(1000) + (7 << 33)
    assert (related.unpacked(related.packed(x, "<i8"), "<i8") == x).all() and len(related.packed(x, "<i8")) < 4000 and not len(related.unpacked(related.packed(x[:0], "<f8"), "<f8"))


def test_blocks_meet_once_for_the_lists_of_both(monkeypatch):
    """Against all products, by matrices alone, by the inverted index alone, and by both."""
    import numpy as np

    draw = np.random.default_rng(3)
    weights = draw.integers(1, 9, (23, 40)) * (draw.random((23, 40)) < np.linspace(0.02, 0.9, 40)).astype(float)
    weights[5] = weights[11]  # ties
    weights[7] = 0  # has nothing in common with any

    def made(rows):
        at, term = np.nonzero(weights[rows])
        norms = np.maximum(np.sqrt((weights[rows] ** 2).sum(axis=1)), 1)
        return related.Block(np.array(rows) * 10, norms, np.searchsorted(at, np.arange(len(rows) + 1)), term, weights[rows][at, term])

    norms = np.maximum(np.sqrt((weights**2).sum(axis=1)), 1)
    scores = related.rounded(weights @ weights.T / np.multiply.outer(norms, norms))
    monkeypatch.setattr(related, "STRIP", 4)
    for dense, cheaper, products in ((512, 1 << 30, 1), (512, 0, 7), (8, 3, 1 << 18)):
        for name, value in (("DENSE", dense), ("CHEAPER", cheaper), ("PRODUCTS", products)):
            monkeypatch.setattr(related, name, value)
        a, b = made(list(range(9))), made(list(range(9, 23)))
        best, index = [related.Best(x.ids, 3) for x in (a, b)], related.Index(a)
        related.meet(a, best[0], index, None)
        related.meet(b, best[1], index, best[0])
        related.meet(b, best[1], related.Index(b), None)
        for i, row in enumerate(scores):
            want = sorted((-s, j * 10) for j, s in enumerate(row) if j != i and weights[i] @ weights[j] > 0)[:3]
            x, at = (best[0], i) if i < 9 else (best[1], i - 9)
            assert [(-s, o) for s, o in zip(x.scores[at], x.others[at]) if s >= 0] == want


def test_points_meet_the_ranges_that_hold_them(spark):
    import random

    draw = random.Random(2)
    points = [(i, draw.randrange(-50, 50), i % 2) for i in range(60)] + [(99, None, 0)]
    held = [(i, low, low + draw.randrange(-2, 40), i % 2) for i, low in enumerate(draw.choices(range(-60, 60), k=40))] + [(99, None, 5, 0)]
    p, r = spark.createDataFrame(points, "p long, at long, key long"), spark.createDataFrame(held, "r long, low long, high long, key long")
    for width in (1, 7, 1000):
        for keys in ([], ["key"]):
            right = r if keys else r.drop("key")
            found = ranges.range_join(p, right, F.col("at"), F.col("low"), F.col("high"), width, keys)
            want = {(a, b) for a, at, k in points for b, low, high, k2 in held if None not in (at, low) and low <= at < high and (k == k2 or not keys)}
            got = [(x.p, x.r) for x in found.collect()]
            assert set(got) == want and len(got) == len(want)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()


def test_properties_of_odd_texts(spark):
    rows_ = [("a", '{"k": 1, "j": 2.5}'), ("a", '{"k": 3}'), ("a", None), ("b", "no object"), ("b", '{"k": "x"}'), ("b", "{}"), (None, '{"k": 4}')]
    events = spark.createDataFrame(rows_, "event_type string, props string")
    assert sorted(map(str, audience.properties(events).collect())) == sorted(
        map(str, spark.createDataFrame([("a", "k", 2, 4.0, 1.0, 3.0), ("a", "j", 1, 2.5, 2.5, 2.5), (None, "k", 1, 4.0, 4.0, 4.0)], "event_type string, name string, n long, total double, least double, most double").collect())
    )


def test_written_tables_go(spark, tmp_path, monkeypatch):
    from turnweave.operators import lineage

    spark.range(3).write.parquet(str(tmp_path / "x"))
    table = lineage.cut(spark.read.parquet(str(tmp_path / "x")))
    folder = lineage.shared_folder(spark).removeprefix("file://")
    assert table.count() == 3 and os.listdir(folder)
    assert "broadcast" in lineage.sized(table)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in lineage.sized(table, most=2)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in lineage.sized(table, most_bytes=5)._jdf.queryExecution().logical().toString().lower()
    lineage.clear(spark)
    assert not os.path.exists(folder)


def test_near_vectors_are_found_and_copies_come_in_order(spark):
    import numpy as np

    from turnweave.operators import neighbours

    r = np.random.default_rng(1)
    centres = r.normal(size=(20, 16))
    m = (centres[np.arange(400) % 20] + 0.2 * r.normal(size=(400, 16))).astype(np.float32)
    rows_ = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(1000 + i, [float(x) for x in m[0]]) for i in range(30)]
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [None] * 16), (2003, [float("nan")] * 16), (None, rows_[1][1]), (2020, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows_ + odd, "vec_id long, embedding array<float>")
    got = neighbours.knn_lsh(vectors, F.col("id") % 20 == 0, k=5).orderBy("query_id", "rank").collect()
    by = {}
    for x in got:
        by.setdefault(x.query_id, []).append(x.id)
    ids, all_ = np.array([i for i, _ in rows_]), np.array([v for _, v in rows_])
    unit = all_ / np.linalg.norm(all_, axis=1)[:, None]
    hits = 0
    for q in [i for i in ids if i % 20 == 0]:
        s = np.round(unit @ unit[ids == q][0], 6)
        s[ids == q] = -9
        hits += len(set(ids[np.lexsort((ids, -s))[:5]].tolist()) & set(by[q]))
    assert hits >= 0.95 * 5 * sum(ids % 20 == 0)
    assert by[0] == [1000, 1001, 1002, 1003, 1004] and by[1000][:3] == [0, 1001, 1002] and 2020 not in by


def test_vectors_meet_in_blocks_and_not_row_by_row(spark, monkeypatch):
    """Against all pairs, with blocks of a few vectors; no row is made for each table and bucket in which a pair meets."""
    import numpy as np

    from turnweave.operators import neighbours

    monkeypatch.setattr(neighbours, "BLOCK", 7)
    r = np.random.default_rng(3)
    m = r.normal(size=(90, 8))
    m[50:60] = m[3]
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    frame = neighbours.knn_lsh(vectors, F.col("id") % 5 == 0, k=4, tables=3, bits=6)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" not in plan and plan.count("MapInArrow") == 1
    v = np.floor(m * neighbours.SCALE)
    side = (v @ neighbours.signs(3, 6, 8).T >= 0).reshape(90, 3, 6)
    for q in range(0, 90, 5):
        near = ((side != side[q]).sum(axis=2) <= 1).any(axis=1)
        s = np.round(v @ v[q] / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((v[q] * v[q]).sum())), 6)
        want = [(i, s[i]) for i in np.lexsort((np.arange(90), -s)) if near[i] and i != q][:4]
        got = [(x.id, x.score) for x in frame.where(f"query_id = {q}").orderBy("rank").collect()]
        assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([x for _, x in got], [x for _, x in want])
    large = r.integers(-(1 << 40), 1 << 40, size=(5, 8)).astype(float)
    assert np.allclose(neighbours.products(large, large), large @ large.T)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_mentions_and_their_graph_are_made_once(spark):
    """Texts are cut once for all lengths; pairs are written before they are read four times; ranks move no edges."""
    turns = spark.createDataFrame([(i, 0, f"a b c x{chr(97 + i % 3)} y, b c d a b") for i in range(9)] + [(99, 0, None)], "conv_id long, turn long, text string")
    assert plan_of(mentions.phrases(turns)).count("LogicalRDD") + plan_of(mentions.phrases(turns)).count("LocalRelation") == 1
    known = mentions.numbered(mentions.phrases(turns))
    plain, numbers = mentions.link_mentions(turns, known, mentions.LENGTHS), mentions.link_mentions(turns, known, mentions.LENGTHS, "id")
    assert sorted(map(tuple, numbers.withColumnRenamed("phrase", "id").join(known, "id").select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    edges = mentions.cooccurrence(plain)
    assert "Window" not in plan_of(edges) and "MapInArrow" not in plan_of(edges)
    assert edges.count() and sorted(map(tuple, edges.collect())) == sorted(map(tuple, mentions.cooccurrence(numbers, gazetteer=known).collect()))
    ranks = mentions.rank_entities(edges)
    assert "Join" not in plan_of(ranks)
    assert sorted(map(tuple, ranks.collect())) == sorted(map(tuple, mentions.named_ranks(mentions.rank_entities(mentions.near_pairs(numbers)), known).collect()))


def test_words_in_tasks_are_the_terms_of_texts(spark):
    import pyarrow as pa

    from turnweave.functions import text

    texts = ["Été ÀB c2d x_y", None, "", "12 ² Ⅷ½a", "ΣΑΣ Σ ͅ İI ß ẞ", "áb 日本語 𝐀𐐀", "é’s-t", "ǅ ªº ʰ اَب"]
    want = [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i long, x string").select("i", text.terms(F.col("x")).alias("t")).orderBy("i").collect()]
    assert text.words(pa.array(texts)) == [x or [] for x in want]
    assert text.words(pa.array([b"ab\xffc"], pa.binary())) == [["ab", "c"]]


def test_terms_are_counted_once_and_written(spark):
    docs = spark.createDataFrame([(i, f"a b{chr(97 + i % 4)} x{chr(97 + i)}. a c{chr(97 + i % 2)}!") for i in range(20)] + [(50, None), (51, "12")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a ba"), (2, "xb")], "item_id long, text string")
    for made in (knowledge.keyphrases(docs), knowledge.inverted_index(docs), knowledge.matches(docs, queries)):
        assert not {"regexp_extract_all", "MapInArrow"} & set(plan_of(made).replace("(", " ").split())
    counts = knowledge.cut(knowledge.term_counts(docs))
    stats = knowledge.stats_of(counts, docs)
    assert sorted(map(tuple, stats.collect())) == sorted(map(tuple, knowledge.term_stats(docs).collect()))
    want = sorted(map(tuple, counts.join(stats, "term").collect()))
    for most in (0, 1, 3, 8, 1000):  # no, some and all terms go to every task
        assert sorted(map(tuple, knowledge.weighed(counts, stats, most).collect())) == want
