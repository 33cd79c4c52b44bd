"""The queries of the library's own operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import articles as b
from ..operators import knowledge as k
from ..operators import mentions as m
from ..operators import neighbours as nb
from ..operators import pages as p
from ..operators import ranges as rg
from ..operators import related as rel
from ..operators import search as r
from ..operators import transcripts as t
from ..sources.tables import table
from ..streaming import audience as a
from ..streaming.incremental import streamed_term_stats
from ..streaming.totals import streamed_user_state


def _on(name, f, *more):
    return lambda spark, sf: f(table(spark, sf, name), *[table(spark, sf, m) for m in more])


def _mentions(turns):
    return m.link_mentions(turns, m.phrases(turns), m.LENGTHS)


def _numbers(turns):
    """Mentions by the numbers of their phrases, and the phrases."""
    known = m.numbered(m.phrases(turns))
    return m.link_mentions(turns, known, m.LENGTHS, "id"), known


def _cooccurrence(turns):
    found, known = _numbers(turns)
    return m.cooccurrence(found, gazetteer=known)


def _ranks(turns):
    found, known = _numbers(turns)
    return m.named_ranks(m.rank_entities(m.near_pairs(found)), known)


QUERIES = {
    "t1_validate_turns": _on("conversations", t.validate_turns),
    "t2_assemble": _on("conversations", t.assemble),
    "t3_merge_turns": _on("conversations", t.merge_turns),
    "t4_split_sentences": _on("conversations", t.split_sentences),
    "t5_chunk": _on("conversations", t.chunk),
    "t6_role_share": _on("conversations", t.role_share),
    "t7_exchanges": _on("conversations", t.exchanges),
    "t8_role_transitions": _on("conversations", t.role_transitions),
    "c1_pages_to_text": _on("pages", p.pages_to_text),
    "c2_canonical_pages": _on("pages", p.canonical_pages),
    "c12_label_summary": _on("documents", k.label_summary, "labels"),
    "k1_term_stats": _on("documents", k.term_stats),
    "k2_keyphrases": _on("documents", k.keyphrases),
    "k3_collocations": _on("documents", k.collocations),
    "k4_link_mentions": _on("conversations", _mentions),
    "k5_cooccurrence": _on("conversations", _cooccurrence),
    "k6_rank_entities": _on("conversations", _ranks),
    "k9_passage_mentions": _on("conversations", lambda t: rg.passage_mentions(t, _numbers(t)[0])),
    "k10_term_drift": _on("documents", lambda d: k.term_drift(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 <> 0"))),
    "k8_centroid_classify": _on("embeddings", lambda v: m.centroid_classify(v, learn=F.col("vec_id") % 2 == 0)),
    "r1_inverted_index": _on("documents", k.inverted_index),
    "r2_bm25": _on("documents", k.bm25, "benchmark"),
    "r4_knn_lsh": _on("embeddings", lambda v: nb.knn_lsh(v, F.col("id") % 20 == 0)),
    "r5_fuse": _on("documents", r.fused_search, "benchmark"),
    "r6_evaluate": _on("documents", r.measured_search, "benchmark"),
    "b1_summarize": _on("documents", b.summarize),
    "b2_related": _on("documents", rel.related),
    "b3_assemble_articles": _on("conversations", lambda t: b.articles_json(b.assemble_articles(t))),
    "b4_catalog": _on("documents", k.catalog, "labels"),
    "b5_coverage": _on("documents", k.coverage, "labels"),
    "s1_engagement": _on("events", a.engagement),
    "s2_rolling": _on("events", lambda e: a.engagement(e, "2 hours", "1 hour")),
    "s3_sessions": _on("events", a.sessions),
    "s4_dedup_stream": _on("events", a.dedup_stream),
    "s5_trending": _on("events", a.trending),
    "s6_user_state": lambda spark, sf: streamed_user_state(spark, f"{sf}/events.parquet"),
    "s7_last_touch": _on("events", a.last_touch),
    "s9_properties": _on("events", a.properties),
    "s10_profiles": _on("events", a.profiles),
    "s11_after_errors": _on("events", rg.after_errors),
    "s12_daily": _on("events", a.daily),
    "s8_incremental": lambda spark, sf: streamed_term_stats(spark, f"{sf}/documents.parquet"),
}

_TF = r"""tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)"""
_STATS = "stats AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, round(ln((SELECT count(*) FROM documents) / count(*)), 6) AS idf FROM tf GROUP BY term)"

_MENTIONS = r"""tok AS MATERIALIZED (SELECT conv_id, turn, regexp_extract_all(lower(text), '\p{L}+') AS t FROM conversations),
g AS (SELECT conv_id, turn, pos, n AS len, array_to_string(t[pos + 1 : pos + n], ' ') AS phrase
  FROM (SELECT conv_id, turn, t, n, unnest(range(0, len(t) - n + 1)) AS pos FROM tok, (VALUES (2), (3)) AS v(n) WHERE len(t) >= n)),
gaz AS (SELECT phrase FROM g GROUP BY phrase HAVING count(*) >= 5),
best AS MATERIALIZED (SELECT conv_id, turn, pos, max(len) AS len FROM g JOIN gaz USING (phrase) GROUP BY ALL),
nx AS MATERIALIZED (SELECT a.conv_id, a.turn, a.pos, a.len, min(c.pos) AS nxt FROM best a
  LEFT JOIN best c ON a.conv_id = c.conv_id AND a.turn = c.turn AND c.pos >= a.pos + a.len GROUP BY ALL),
kept AS (SELECT nx.* FROM nx JOIN (SELECT conv_id, turn, min(pos) AS pos FROM nx GROUP BY ALL) USING (conv_id, turn, pos)
  UNION ALL SELECT nx.* FROM kept JOIN nx ON nx.conv_id = kept.conv_id AND nx.turn = kept.turn AND nx.pos = kept.nxt),
m AS MATERIALIZED (SELECT conv_id, turn, pos, len, array_to_string(t[pos + 1 : pos + len], ' ') AS phrase FROM kept JOIN tok USING (conv_id, turn))"""
_EDGES = """e AS MATERIALIZED (SELECT least(a.phrase, b.phrase) AS src, greatest(a.phrase, b.phrase) AS dst, count(*) AS n FROM m a
  JOIN m b ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.pos BETWEEN a.pos + 1 AND a.pos + 20 AND a.phrase <> b.phrase GROUP BY ALL)"""
_RANKS = """both_ways AS (SELECT src, dst, n FROM e UNION ALL SELECT dst, src, n FROM e),
w AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM both_ways),
c AS MATERIALIZED (SELECT count(DISTINCT src) AS size FROM w), r0 AS (SELECT DISTINCT src, 1.0::DOUBLE / size AS rank FROM w, c)"""
for _i in range(10):
    _RANKS += f""",
r{_i + 1} AS (SELECT dst AS src, 0.15::DOUBLE / any_value(size) + 0.85::DOUBLE * sum(rank * share) AS rank FROM r{_i} JOIN w USING (src), c GROUP BY dst)"""
_SENTENCES = r"""w AS (SELECT doc_id, term, tf * round(idf * 1000000)::BIGINT AS weight FROM tf JOIN stats USING (term)),
a AS (SELECT doc_id, regexp_extract_all(text, '([^.!?]+[.!?]*)') AS a FROM documents),
s AS (SELECT doc_id, pos, trim(a[pos + 1], ' ' || chr(10)) AS sentence FROM (SELECT doc_id, unnest(range(0, len(a))) AS pos, a FROM a)),
x AS (SELECT doc_id, pos, unnest(regexp_extract_all(lower(sentence), '\p{L}+')) AS term FROM s),
c AS (SELECT doc_id, pos, sum(weight)::DOUBLE / count(*) AS score FROM x JOIN w USING (doc_id, term) GROUP BY doc_id, pos),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM c)"""
_SHARED = r"""q AS (SELECT item_id, len(t) AS n_terms, unnest(t) AS term FROM (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '\p{L}+')) AS t FROM benchmark)),
shared AS (SELECT item_id, doc_id, n_terms, count(*) AS shared FROM q JOIN tf USING (term) GROUP BY ALL)"""


def _bm25(k: int | None) -> str:
    """Ranked documents, as b, after _TF and _SHARED."""
    return f"""df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id),
c AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dl) AS total),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (total / n)))), 6) AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), c GROUP BY item_id, doc_id),
b AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s{f" QUALIFY rank <= {k}" if k else ""})"""


def _on_docs(part: str) -> str:
    """The same over the table docs."""
    return part.replace("FROM documents", "FROM docs")


def _plain(html: str) -> str:
    out = f"regexp_replace(regexp_replace({html}, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<nav\\b.*?</nav>|<footer\\b.*?</footer>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    for entity, char in (("&quot;", '"'), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return f"trim(regexp_replace({out}, '[ \\t\\r\\n]+', ' ', 'g'))"


SQL = {
    "t1_validate_turns": """WITH l AS (SELECT *, lag(turn) OVER w AS b, lag(role) OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, turn, 'duplicate' AS issue FROM conversations GROUP BY conv_id, turn HAVING count(*) > 1
UNION ALL SELECT conv_id, turn, 'gap' FROM l WHERE turn - coalesce(b, -1) > 1
UNION ALL SELECT conv_id, turn, 'blank' FROM l WHERE trim(coalesce(text, '')) = ''
UNION ALL SELECT conv_id, turn, 'role_repeated' FROM l WHERE role = r""",
    "t2_assemble": "SELECT conv_id, count(*) AS n_turns, length(string_agg(text, chr(10) ORDER BY turn)) AS n_chars, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "t3_merge_turns": """WITH l AS (SELECT *, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS e FROM conversations WHERE length(text) >= 40 WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(e) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM l)
SELECT conv_id, min(turn) AS turn, role, count(*) AS n_merged, string_agg(text, ' ' ORDER BY turn) AS text FROM r GROUP BY conv_id, run, role""",
    "t4_split_sentences": """WITH s AS (SELECT conv_id, turn, regexp_extract_all(text, '([^.!?]+[.!?]*)') AS a FROM conversations),
p AS (SELECT conv_id, turn, unnest(range(0, len(a))) AS pos, a FROM s)
SELECT conv_id, turn, pos, trim(a[pos + 1], ' ' || chr(10)) AS sentence FROM p WHERE trim(a[pos + 1], ' ' || chr(10)) <> ''""",
    "t5_chunk": r"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM conversations),
p AS (SELECT *, unnest(range(0, greatest(1, ceil((len(w) - 10) / 40.0)::BIGINT))) AS no FROM w WHERE len(w) > 0)
SELECT conv_id, turn, no AS chunk_no, len(w[no * 40 + 1 : no * 40 + 50])::BIGINT AS n_tokens, array_to_string(w[no * 40 + 1 : no * 40 + 50], ' ') AS text FROM p""",
    "t6_role_share": r"""WITH n AS (SELECT conv_id, role, sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')))::BIGINT AS n_tokens FROM conversations GROUP BY conv_id, role)
SELECT *, round(n_tokens / nullif(sum(n_tokens) OVER (PARTITION BY conv_id), 0), 6) AS share FROM n""",
    "t7_exchanges": """WITH l AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, text AS question, answer FROM l WHERE role = 'user' AND nr = 'assistant'""",
    "t8_role_transitions": """WITH l AS (SELECT role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations),
n AS (SELECT role, next_role, count(*) AS n FROM l WHERE next_role IS NOT NULL GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (PARTITION BY role), 6) AS p FROM n""",
    "c1_pages_to_text": rf"""SELECT page_id, regexp_extract(html, '(?is)<html[^>]*\blang="([^"]*)"', 1) AS lang,
{_plain("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS title, {_plain("regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)")} AS text FROM pages""",
    "c2_canonical_pages": r"""WITH b AS (SELECT page_id, split_part(split_part(regexp_replace(url, '^[A-Za-z]+://', ''), '#', 1), '?', 1) AS u FROM pages),
c AS (SELECT page_id, regexp_replace(lower(split_part(u, '/', 1)), '^(www\.|m\.)', '') || substr(u, length(split_part(u, '/', 1)) + 1) AS u FROM b)
SELECT regexp_replace(u, '/$', '') AS canonical_url, min(page_id) AS page_id, count(*) AS n_pages FROM c GROUP BY canonical_url""",
    "c12_label_summary": """SELECT lang, source, count(*) AS n, count(quality) AS n_labelled, round(avg(quality), 6) AS good, round(avg(toxic), 6) AS toxic
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang, source""",
    "k1_term_stats": f"WITH {_TF}, {_STATS} SELECT * FROM stats",
    "k2_keyphrases": f"""WITH {_TF}, {_STATS}, s AS (SELECT doc_id, tf.term, tf, round(tf * idf, 6) AS score FROM tf JOIN stats USING (term)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term COLLATE C) AS rank FROM s)
SELECT doc_id, rank, term, tf, score FROM r WHERE rank <= 5""".replace(" COLLATE C", ""),
    "k3_collocations": r"""WITH t AS (SELECT regexp_extract_all(lower(text), '\p{L}+') AS t FROM documents),
p AS (SELECT unnest(list_zip(t[:-2], t[2:])) AS p FROM t WHERE len(t) > 1),
n AS (SELECT p[1] AS a, p[2] AS b, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 20),
o AS (SELECT term, count(*) AS c FROM (SELECT unnest(t) AS term FROM t) GROUP BY term)
SELECT a, b, n, round(ln(n::DOUBLE * (SELECT sum(c) FROM o) / (x.c::DOUBLE * y.c)), 5) AS pmi FROM n JOIN o x ON x.term = a JOIN o y ON y.term = b""",
    "k4_link_mentions": f"WITH RECURSIVE {_MENTIONS} SELECT conv_id, turn, pos, len::BIGINT AS len, phrase FROM m",
    "k5_cooccurrence": f"""WITH RECURSIVE {_MENTIONS}, {_EDGES},
d AS (SELECT phrase, sum(n) AS d FROM (SELECT src AS phrase, n FROM e UNION ALL SELECT dst, n FROM e) GROUP BY phrase)
SELECT src, dst, n, round(ln(4.0::DOUBLE * n * (SELECT sum(n) FROM e) / (x.d::DOUBLE * y.d)), 5) AS pmi FROM e JOIN d x ON x.phrase = src JOIN d y ON y.phrase = dst""",
    "k6_rank_entities": f"WITH RECURSIVE {_MENTIONS}, {_EDGES}, {_RANKS} SELECT src AS phrase, round(rank, 9) AS rank FROM r10",
    "k9_passage_mentions": _on("conversations", lambda t: rg.passage_mentions(t, _mentions(t))),
    "k10_term_drift": _on("documents", lambda d: k.term_drift(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 <> 0"))),
    "k8_centroid_classify": """WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS d FROM embeddings WHERE vec_id % 2 = 0),
c AS (SELECT label, d, avg(x) AS c FROM x GROUP BY ALL), cc AS (SELECT label, list(c ORDER BY d) AS c FROM c GROUP BY label),
s AS (SELECT vec_id, e.label, cc.label AS predicted, list_sum(list_transform(list_zip(embedding, c), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2]))) AS far FROM embeddings e, cc WHERE vec_id % 2 <> 0),
b AS (SELECT label, predicted FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY far, predicted) = 1)
SELECT label, predicted, count(*) AS n FROM b GROUP BY ALL""",
    "r4_knn_lsh": """WITH h0 AS (SELECT unnest(range(0, 24 * 8 * 64)) AS i), h1 AS (SELECT i, (i + 12345) * 739982445 % 4294967296 AS x FROM h0),
h2 AS (SELECT i, (xor(x, x >> 15) + 12345) * 695872825 % 4294967296 AS x FROM h1), h3 AS (SELECT i, (xor(x, x >> 13) + 12345) * 739982445 % 4294967296 AS x FROM h2),
p AS (SELECT i // 512 AS t, i // 64 % 8 AS b, list(CASE WHEN xor(x, x >> 16) % 2 = 1 THEN 1 ELSE -1 END ORDER BY i) AS p FROM h3 GROUP BY ALL),
v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1048576)::BIGINT) AS v FROM embeddings),
n AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x))) AS norm FROM v),
s AS (SELECT id, t, sum(CASE WHEN list_sum(list_transform(list_zip(v, p), lambda x: x[1] * x[2])) >= 0 THEN 1 << b::INTEGER ELSE 0 END)::BIGINT AS sig FROM n, p GROUP BY id, t),
m AS (SELECT DISTINCT a.id AS query_id, c.id FROM s a JOIN s c ON a.t = c.t AND a.id % 20 = 0 AND a.id <> c.id AND bit_count(xor(a.sig, c.sig)) <= 1),
x AS (SELECT query_id, m.id, round(list_sum(list_transform(list_zip(a.v, c.v), lambda x: x[1]::DOUBLE * x[2])) / (c.norm * a.norm), 6) AS score FROM m JOIN n a ON a.id = query_id JOIN n c ON c.id = m.id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM x QUALIFY rank <= 10""",
    "r5_fuse": f"""WITH {_TF}, {_SHARED}, {_bm25(None)},
o AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS rank FROM shared),
f AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM b UNION ALL SELECT * FROM o) GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM f QUALIFY rank <= 5""",
    "r6_evaluate": rf"""WITH {_TF}, {_SHARED}, {_bm25(10)}, rel AS (SELECT item_id, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text) WHERE len(list_distinct(regexp_extract_all(lower(benchmark.text), '\p{{L}}+'))) >= 3),
n AS (SELECT item_id, count(*) AS n_relevant FROM rel GROUP BY item_id),
h AS (SELECT item_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM b JOIN rel USING (item_id, doc_id) GROUP BY item_id)
SELECT item_id, n_relevant, coalesce(hits, 0) AS hits, round(coalesce(hits, 0) / n_relevant, 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr,
round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(10, n_relevant) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM n LEFT JOIN h USING (item_id)""",
    "b2_related": f"""WITH g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS rep FROM documents),
docs AS (SELECT documents.* FROM documents JOIN g USING (doc_id) WHERE doc_id = rep),
{_on_docs(_TF)}, {_on_docs(_STATS)}, w AS MATERIALIZED (SELECT doc_id, tf.term, df, (tf * round(idf * 1000)::BIGINT)::DOUBLE AS w FROM tf JOIN stats USING (term)),
norm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
d AS (SELECT a.doc_id, b.doc_id AS other, sum(a.w * b.w) AS dot FROM w a JOIN w b ON a.term = b.term AND a.doc_id <> b.doc_id WHERE a.w > 0 GROUP BY ALL),
s AS (SELECT d.doc_id, other, round(dot / (x.norm * y.norm), 6) AS score FROM d JOIN norm x ON x.doc_id = d.doc_id JOIN norm y ON y.doc_id = other
  UNION ALL SELECT doc_id, doc_id, 1.0 FROM norm WHERE norm > 0)
SELECT a.doc_id, row_number() OVER (PARTITION BY a.doc_id ORDER BY score DESC, b.doc_id) AS rank, b.doc_id AS other, score
FROM s JOIN g a ON a.rep = s.doc_id JOIN g b ON b.rep = s.other WHERE a.doc_id <> b.doc_id QUALIFY rank <= 3""",
    "r1_inverted_index": f"""WITH {_TF}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT term, doc_id // 1000 AS block, any_value(df) AS df, string_agg(doc_id || ':' || tf, ',' ORDER BY doc_id) AS postings FROM tf JOIN df USING (term) GROUP BY term, block""",
    "r2_bm25": rf"""WITH {_TF}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id),
c AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dl) AS total),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (total / n)))), 6) AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), c GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 5""",
    "b1_summarize": rf"""WITH {_TF}, {_STATS}, {_SENTENCES}
SELECT doc_id, count(*) AS n_sentences, string_agg(sentence, ' ' ORDER BY pos) AS summary FROM r JOIN s USING (doc_id, pos) WHERE rank <= 2 GROUP BY doc_id""",
    "b3_assemble_articles": rf"""WITH docs AS (SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
{_on_docs(_TF)}, {_on_docs(_STATS)}, s1 AS (SELECT doc_id, term, round(tf * idf, 6) AS score FROM tf JOIN stats USING (term)),
k AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM s1 QUALIFY rank <= 5),
tags AS (SELECT doc_id, list(term ORDER BY rank) AS tags, string_agg(CASE WHEN rank <= 3 THEN term END, ' ' ORDER BY rank) AS title FROM k GROUP BY doc_id),
{_on_docs(_SENTENCES)}, summed AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) AS summary FROM r JOIN s USING (doc_id, pos) WHERE rank <= 2 GROUP BY doc_id),
l AS (SELECT *, lead(role) OVER o AS nr, lead(text) OVER o AS answer FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
asked AS (SELECT conv_id AS doc_id, list({{'turn': turn, 'question': text, 'answer': answer}} ORDER BY turn) AS sections,
  sum(len(regexp_extract_all(lower(text), '\p{{L}}+')) + len(regexp_extract_all(lower(answer), '\p{{L}}+')))::BIGINT AS n_words FROM l WHERE role = 'user' AND nr = 'assistant' GROUP BY conv_id)
SELECT docs.doc_id AS conv_id, coalesce(len(sections), 0) AS n_sections, coalesce(n_words, 0) AS n_words,
  to_json({{'title': title, 'tags': coalesce(tags, []), 'summary': summary, 'sections': coalesce(sections, [])}})::VARCHAR AS article
FROM docs LEFT JOIN tags USING (doc_id) LEFT JOIN summed USING (doc_id) LEFT JOIN asked USING (doc_id)""",
    "b4_catalog": """WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)
SELECT lang, source, quality, grouping_id(lang, source, quality)::BIGINT AS level, count(*) AS n, sum(n_chars)::BIGINT AS n_chars
FROM documents LEFT JOIN l USING (doc_id) GROUP BY CUBE (lang, source, quality)""",
    "b5_coverage": """WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)
SELECT lang, source, quality, grouping_id(lang, source, quality)::BIGINT AS level, count(*) AS n, sum(n_chars)::BIGINT AS n_chars
FROM documents LEFT JOIN l USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), (lang, quality))""",
    "k9_passage_mentions": f"""WITH RECURSIVE {_MENTIONS}, p AS (SELECT conv_id, turn, len(t) AS n, unnest(range(0, greatest(0, ceil((len(t) - 50) / 40.0)::BIGINT * 40) + 1, 40)) AS first FROM tok WHERE len(t) > 0)
SELECT p.conv_id, p.turn, first, count(*) AS n, count(DISTINCT phrase) AS n_phrases FROM p JOIN m ON m.conv_id = p.conv_id AND m.turn = p.turn AND m.pos >= first AND m.pos < least(first + 50, p.n) GROUP BY ALL""",
    "k10_term_drift": r"""WITH tok AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM documents),
a AS (SELECT term, count(*) AS df FROM tok WHERE doc_id % 2 = 0 GROUP BY term), b AS (SELECT term, count(*) AS df FROM tok WHERE doc_id % 2 <> 0 GROUP BY term)
SELECT *, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT *, 'before' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
UNION ALL SELECT *, 'after' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
    "s9_properties": """WITH x AS (SELECT event_type, unnest(json_keys(props)) AS name, props FROM events),
y AS (SELECT event_type, name, (props ->> name)::DOUBLE AS x FROM x)
SELECT event_type, name, count(*) AS n, round(sum(x), 4) AS total, min(x) AS least, max(x) AS most FROM y WHERE x IS NOT NULL GROUP BY event_type, name""",
    "s10_profiles": """WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL)
SELECT user_id, sum(n)::BIGINT AS n, first(event_type ORDER BY n DESC, event_type) AS main,
'{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}' AS profile FROM n GROUP BY user_id""",
    "s11_after_errors": """SELECT e.event_id AS error_id, count(*) AS n, sum(round(p.value * 100)::BIGINT)::BIGINT AS cents, count(*) FILTER (e.user_id = p.user_id) AS n_own
FROM events e JOIN events p ON e.event_type = 'error' AND p.event_type = 'purchase' AND p.ts >= e.ts AND p.ts < e.ts + INTERVAL 10 MINUTE GROUP BY e.event_id""",
    "s12_daily": """WITH x AS (SELECT date_trunc('week', ts)::DATE AS week, ts::DATE AS day, event_type, round(value * 100)::BIGINT AS cents FROM events)
SELECT week::VARCHAR AS week, day::VARCHAR AS day, event_type, grouping_id(week, day, event_type)::BIGINT AS level, count(*) AS n, sum(cents)::BIGINT AS cents
FROM x GROUP BY ROLLUP (week, day, event_type)""",
    "s1_engagement": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "s2_rolling": """SELECT time_bucket(INTERVAL 1 HOUR, ts) - b * INTERVAL 1 HOUR AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value
FROM events, (VALUES (0), (1)) AS v(b) GROUP BY ALL""",
    "s3_sessions": """WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS e FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(e) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, s""",
    "s4_dedup_stream": "SELECT DISTINCT ON (event_id) event_id, ts, user_id, event_type, value, props FROM events",
    "s5_trending": """WITH n AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, user_id, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, user_id) AS rank FROM n) SELECT window_start, rank, user_id, n FROM r WHERE rank <= 3""",
    "s6_user_state": """SELECT user_id, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents, count(*) FILTER (event_type = 'purchase') AS n_purchases,
arg_max(ts, event_id) AS last_ts, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id""",
    "s8_incremental": f"WITH {_TF} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term",
    "s7_last_touch": """WITH x AS (SELECT *, last_value(CASE WHEN event_type IN ('view', 'click') THEN {'id': event_id, 'at': ts} END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS touch FROM events)
SELECT event_id AS purchase_id, user_id, CASE WHEN touch.at >= ts - INTERVAL 7 DAY THEN touch.id END AS touch_id FROM x WHERE event_type = 'purchase'""",
}
