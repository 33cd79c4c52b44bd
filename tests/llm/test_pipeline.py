"""Every stage of the pipeline against brute force on its own input."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from turnweave.llm.quality_pu import fit, score
from turnweave.llm.simhash import fingerprint

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORD.findall(text or ""))


def shingles(text):
    """Five words each, as bytes in lower case."""
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What goes into each stage, and what comes out of the last, as written."""
    sf = str(tmp_path_factory.mktemp("sf"))
    given = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r.text for r in given.orderBy("doc_id").limit(3).collect()]
    shared = "\nA line that many hold \nown line "
    odd = [(9001, None), (9002, ""), (None, texts[0]), (9003, texts[1]), (9003, texts[1]), (9004, " ".join([texts[2]] * 40)), *[(9100 + i, texts[i % 3] + shared + str(i)) for i in range(12)]]
    rows = spark.createDataFrame([(i, t, None, None if i == 9003 else "src", None) for i, t in odd], given.schema)
    docs = given.unionByName(rows).selectExpr("*", "doc_id % 7 AS id", "'x' AS hash", "2.0D AS score", "array(1) AS block", "1 AS n_lines", "'y' AS fp", "'z' AS dropped", "0 AS pass", "named_struct('x', 1) AS b")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf).write.parquet(f"{sf}/step{i}")
        out.append(spark.read.parquet(f"{sf}/step{i}"))
    return sf, out


def test_columns_stay(steps):
    _, out = steps
    assert all(x.dtypes == out[0].dtypes for x in out[1:5])


def test_quality_keeps_what_scores_enough(spark, steps):
    sf, out = steps
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = fit(out[0], labels)
    want = score(out[0].select("doc_id", "text"), model).where("score >= 0.3").select("doc_id", "text")
    assert Counter(map(tuple, out[1].select("doc_id", "text").collect())) == Counter(map(tuple, want.collect()))
    good = labels.where("quality = 1")
    assert good.join(out[1], "doc_id").count() > 0.97 * good.count()


def test_lines_go(steps):
    _, out = steps
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r"))
    rows = [(r.doc_id, r.text or "") for r in out[1].select("doc_id", "text").collect()]
    held = defaultdict(set)
    for i, text in rows:
        for line in text.split("\n"):
            held[key(line)].add(i)
    gone = {k for k, ids in held.items() if k and len(ids) >= 10}
    want = Counter((i, "\n".join(x for x in text.split("\n") if key(x) not in gone)) for i, text in rows)
    got = out[2].select("doc_id", "text", "n_chars").collect()
    assert Counter((r.doc_id, r.text) for r in got) == want and key("A line that many hold") in gone
    assert all(r.n_chars == len(r.text) for r in got)


def test_one_near_copy_stays(steps):
    _, out = steps
    given = out[2].select("doc_id", "text").collect()
    rows = [(r.doc_id, fingerprint(r.text)) for r in given]
    fp = np.array([f for _, f in rows], np.uint64)
    ids = np.array([np.iinfo(np.int64).max if i is None else i for i, _ in rows])
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= 4
    sets = [shingles(r.text) for r in given]
    near |= np.array([[bool(a) and 5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets])
    while not np.array_equal(nxt := np.array([ids[m].min() for m in near]), ids):
        ids = nxt
    want = Counter(i for (i, _), least in zip(rows, ids.tolist(), strict=True) if i is None or i == least)
    assert Counter(r.doc_id for r in out[3].select("doc_id").collect()) == want
    assert len(rows) > sum(want.values())


def test_mix_comes_near_its_targets(steps):
    _, out = steps
    before = [(r.doc_id, r.source, size(r.text), r.text) for r in out[3].select("doc_id", "source", "text").collect()]
    after = [(r.doc_id, r.source, size(r.text), r.text) for r in out[4].select("doc_id", "source", "text").collect()]
    sizes, taken, per_doc, own = Counter(), Counter(), Counter(), Counter()
    for i, s, n, _ in before:
        sizes[s] += n
        own[i] += n
    for i, s, n, _ in after:
        taken[s] += n
        per_doc[i] += n
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, free, left = {}, set(sizes), sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        for s in over or free:
            target[s] = 3 * sizes[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    assert all(abs(taken[s] - target[s]) <= 256 for s in sizes)
    assert all(per_doc[i] <= 3 * own[i] for i in per_doc)
    words = defaultdict(list)
    for i, s, _, text in before:
        words[i, s].append(Counter(WORD.findall(text or "")))
    assert all(any(not Counter(WORD.findall(text)) - w for w in words[i, s]) for i, s, _, text in after)


def test_sequences_hold_every_id(steps):
    from tokenizers import Tokenizer

    _, out = steps
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for r in out[4].select("doc_id", "text").collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want[r.doc_id, len(ids)] += 1
    mine = out[5].toPandas()
    ends = mine.assign(end=mine.start + mine.length)
    assert ends.groupby("doc_id", dropna=False).length.sum().sum() == sum(n * c for (_, n), c in want.items())
    once = [i for i, c in Counter(i for i, _ in want.elements()).items() if c == 1]
    texts = {r.doc_id: r.text for r in out[4].select("doc_id", "text").collect()}
    for i in once:
        ids = np.array([*tok.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        rows = mine[mine.doc_id.isna() if i is None else mine.doc_id == i].sort_values("piece")
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(rows.start, rows.length, strict=True)] == rows.ids_crc32.tolist()
        assert rows.length.sum() == len(ids) and (rows.start.tolist() == (rows.length.cumsum() - rows.length).tolist())
    for _, g in mine.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g.length.sum() <= 1024 and (g.offset == g.length.cumsum() - g.length).all()
    # no two pieces over half a sequence share one
    assert mine.sequence_id.nunique() <= 1.05 * max(mine.length.sum() / 1024, (mine.length > 512).sum()) + 1


def test_run_is_its_stages(spark, steps):
    sf, out = steps
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).select(names).collect())) == Counter(map(tuple, out[5].select(names).collect()))


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_the_run_leaves_only_what_its_result_reads(spark, tmp_path, monkeypatch):
    from turnweave.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    out = corpus_pipeline.run(spark, SF)
    left = sorted(re.sub(r"-[0-9a-f]{8,}", "", str(p.parent.relative_to(tmp_path / "shared"))) for p in (tmp_path / "shared").rglob("_SUCCESS"))
    assert [x for x in left if x.startswith("pipeline")] == ["pipeline/mixing"]
    assert {x.split("/")[0] for x in left} == {"pipeline", "packing"} and out.count() > 100
