"""DuckDB SQL equivalents of the registered queries (same column names/types).

Views ``documents``, ``embeddings``, ``labels`` ... are registered by the
caller. Every pattern, list and number is written out here, not taken from
the code that the queries check.
"""

from __future__ import annotations

# Code points of white space; a token; tokens of a text; words of a vocabulary.
_SPACES = (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200,
           8201, 8202, 8232, 8233, 8239, 8287, 12288)
WS = "(" + " || ".join(f"chr({c})" for c in _SPACES) + ")"
PAT = r"[\p{L}\p{N}]+|[^ \t\n\x0B\f\r\p{L}\p{N}]"
L = 64
CAP = 49998

TOKENS_CTE = f"""
d AS (SELECT doc_id AS ord,
             regexp_extract_all(trim(coalesce(text, ''), {WS}), '{PAT}') AS toks
      FROM documents),
t AS (SELECT ord, unnest(generate_series(0, len(toks) - 1))::INTEGER AS pos,
             unnest(toks) AS token FROM d)"""

VOCAB_CTE = TOKENS_CTE + f""",
s AS (SELECT token, count(*) AS cnt, min(ord * 1000000000 + pos) AS first_key
      FROM t GROUP BY token),
r AS (SELECT token, cnt, row_number() OVER (ORDER BY cnt DESC, first_key) AS rn
      FROM s WHERE token NOT IN ('[PAD]', '[UNK]')),
v AS (SELECT '[PAD]' AS word, 0::BIGINT AS id, NULL::BIGINT AS cnt
      UNION ALL SELECT '[UNK]', 1::BIGINT, NULL::BIGINT
      UNION ALL SELECT token, (rn + 1)::BIGINT, cnt FROM r WHERE rn <= {CAP})"""

ORACLES: dict[str, str] = {}

ORACLES["vocab_top"] = f"WITH {VOCAB_CTE} SELECT word, id, cnt FROM v"

ORACLES["token_freq"] = f"WITH {TOKENS_CTE} SELECT token, count(*) AS cnt FROM t GROUP BY token"

ORACLES["tokens"] = f"WITH {TOKENS_CTE} SELECT ord AS doc_id, pos, token FROM t"

ORACLES["encode_ids"] = f"""WITH {VOCAB_CTE},
ti AS (SELECT t.ord, t.pos, coalesce(v.id, 1)::INTEGER AS id
       FROM t LEFT JOIN (SELECT word, id FROM v WHERE id >= 2) v ON t.token = v.word
       WHERE t.pos < {L}),
per AS (SELECT ord, list(id ORDER BY pos) AS ids, count(*)::INTEGER AS n FROM ti GROUP BY ord)
SELECT d.ord AS doc_id,
       array_to_string(list_concat(coalesce(per.ids, []::INTEGER[]),
                       list_resize([]::INTEGER[], {L} - coalesce(per.n, 0), 0)), ',') AS ids,
       coalesce(per.n, 0)::INTEGER AS n_tokens
FROM d LEFT JOIN per ON d.ord = per.ord"""

ORACLES["decode_ids"] = f"""WITH {VOCAB_CTE},
ti AS (SELECT t.ord, t.pos, coalesce(v.id, 1)::INTEGER AS id
       FROM t LEFT JOIN (SELECT word, id FROM v WHERE id >= 2) v ON t.token = v.word
       WHERE t.pos < {L})
SELECT ti.id, ti.ord AS doc_id, ti.pos, v.word FROM ti LEFT JOIN v ON ti.id = v.id"""

ORACLES["corpus_fingerprint"] = """WITH r AS (
  SELECT doc_id AS ord,
         md5(CAST(doc_id AS VARCHAR) || ':' || md5(coalesce(text, ''))) AS d
  FROM documents),
b1 AS (SELECT ord // 65536 AS b1, md5(string_agg(d, '' ORDER BY ord)) AS d1, count(*) AS n
       FROM r GROUP BY 1),
b2 AS (SELECT b1 // 65536 AS b2, md5(string_agg(d1, '' ORDER BY b1)) AS d2, sum(n) AS n
       FROM b1 GROUP BY 1)
SELECT md5(string_agg(d2, '' ORDER BY b2)) AS fingerprint, sum(n)::BIGINT AS n_docs FROM b2"""

_GROUPS = """SELECT ord // 64 AS b, count(*) AS n,
  md5(string_agg(md5(CAST(ord AS VARCHAR) || ':' || md5(coalesce(text, ''))), '' ORDER BY ord)) AS d"""
ORACLES["corpus_changes"] = f"""WITH o AS (SELECT doc_id AS ord, text FROM documents),
w AS (SELECT ord, CASE WHEN ord % 97 = 0 THEN coalesce(text, '') || '!' ELSE text END AS text FROM o
      UNION ALL SELECT ord + 1 + (SELECT max(ord) FROM o), text FROM o),
a AS ({_GROUPS} FROM o GROUP BY 1), z AS ({_GROUPS} FROM w GROUP BY 1)
SELECT b, b * 64 AS low, b * 64 + 63 AS high,
       CASE WHEN a.d IS NULL THEN 'added' WHEN z.d IS NULL THEN 'removed' ELSE 'changed' END AS state,
       coalesce(a.n, 0) AS n_old, coalesce(z.n, 0) AS n_new
FROM a FULL JOIN z USING (b) WHERE a.d IS DISTINCT FROM z.d"""

ORACLES["distinct_texts"] = """SELECT md5(coalesce(text, '')) AS text_key, min(doc_id) AS first_doc,
       count(*) AS n_copies FROM documents GROUP BY 1"""

ORACLES["corpus_size"] = "SELECT count(*) AS n_docs FROM documents"

ORACLES["stripped_texts"] = f"""SELECT doc_id, trim(coalesce(text, ''), {WS}) AS text,
       length(trim(coalesce(text, ''), {WS}))::INTEGER AS n_chars FROM documents"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def _metrics_sql(points: str) -> str:
    """Exact metrics over a ``p(id, cluster, v DOUBLE[])`` CTE body (noise = -1)."""
    return f"""WITH p0 AS ({points}),
p AS (SELECT * FROM p0 WHERE cluster <> -1),
e AS (SELECT id, cluster, unnest(generate_series(1, len(v))) AS j, unnest(v) AS x FROM p),
c AS (SELECT cluster, j, avg(x) AS m FROM e GROUP BY cluster, j),
nk AS (SELECT cluster, count(*) AS n FROM p GROUP BY cluster),
g AS (SELECT c.j, sum(c.m * nk.n) / sum(nk.n) AS m FROM c JOIN nk USING (cluster) GROUP BY c.j),
dc AS (SELECT e.id, e.cluster, sum((e.x - c.m) * (e.x - c.m)) AS sq
       FROM e JOIN c USING (cluster, j) GROUP BY e.id, e.cluster),
sp AS (SELECT cluster, avg(sqrt(sq)) AS s, sum(sq) AS w FROM dc GROUP BY cluster),
bb AS (SELECT sum(nk.n * x.s) AS b FROM (SELECT c.cluster, sum((c.m - g.m) * (c.m - g.m)) AS s
       FROM c JOIN g USING (j) GROUP BY c.cluster) x JOIN nk USING (cluster)),
cd AS (SELECT a.cluster AS ci, b.cluster AS cj, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d
       FROM c a JOIN c b ON a.j = b.j AND a.cluster <> b.cluster GROUP BY 1, 2),
dbr AS (SELECT ci, max(CASE WHEN d = 0 THEN 0 ELSE (si.s + sj.s) / d END) AS worst, max(d) AS md
        FROM cd JOIN sp si ON si.cluster = ci JOIN sp sj ON sj.cluster = cj GROUP BY ci),
pd AS (SELECT a.id, a.cluster AS ca, b.cluster AS cb,
              CASE WHEN a.id = b.id THEN 0 ELSE list_distance(a.v, b.v) END AS d
       FROM p a, p b),
ps AS (SELECT id, ca, cb, sum(d) AS s, count(*) AS n FROM pd GROUP BY 1, 2, 3),
si AS (SELECT id, max(CASE WHEN ca = cb THEN n END) AS own_n,
              max(CASE WHEN ca = cb AND n > 1 THEN s / (n - 1) END) AS a,
              min(CASE WHEN ca <> cb THEN s / n END) AS b FROM ps GROUP BY id),
cnt AS (SELECT count(*) AS n_samples, count(*) FILTER (WHERE cluster <> -1) AS n_in_clusters,
               count(DISTINCT cluster) FILTER (WHERE cluster <> -1) AS n_clusters FROM p0),
ok AS (SELECT n_clusters >= 2 AND n_clusters <= n_in_clusters - 1 AS ok FROM cnt)
SELECT cnt.n_samples, cnt.n_in_clusters, cnt.n_clusters,
  CASE WHEN ok.ok THEN round((SELECT avg(CASE WHEN own_n <= 1 THEN 0
        WHEN greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) FROM si), 6) END AS silhouette,
  CASE WHEN ok.ok THEN round((SELECT CASE WHEN (SELECT sum(w) FROM sp) = 0 THEN 1.0
        ELSE b * (cnt.n_in_clusters - cnt.n_clusters) / ((SELECT sum(w) FROM sp) * (cnt.n_clusters - 1)) END
        FROM bb), 6) END AS calinski,
  CASE WHEN ok.ok THEN round((SELECT CASE WHEN max(s) = 0 OR (SELECT max(md) FROM dbr) = 0 THEN 0.0
        ELSE (SELECT avg(worst) FROM dbr) END FROM sp), 6) END AS davies_bouldin
FROM cnt, ok"""


ORACLES["cluster_metrics"] = _metrics_sql(
    "SELECT vec_id AS id, label AS cluster, embedding::DOUBLE[] AS v FROM embeddings")
ORACLES["cluster_metrics_noise"] = _metrics_sql(
    "SELECT vec_id AS id, CASE WHEN label = 0 THEN -1 ELSE label END AS cluster, "
    "embedding::DOUBLE[] AS v FROM embeddings")
ORACLES["cluster_sizes"] = "SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY 1"

# ---------------------------------------------------------------- tagging
ITEMS_HEADER = "Texts to label:\n"


def _sql_str(s: str) -> str:
    """A DuckDB string expression for an arbitrary Python string (newlines as chr(10))."""
    parts = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)


TAG_CTE = f"""b AS (SELECT doc_id AS ord, text,
                ((row_number() OVER (ORDER BY doc_id)) - 1) // 30 AS batch_id,
                (((row_number() OVER (ORDER BY doc_id)) - 1) % 30 + 1)::INTEGER AS idx
         FROM documents),
ln AS (SELECT batch_id, idx,
         CASE WHEN idx % 11 = 0 THEN NULL
              WHEN idx % 13 = 0 THEN 'n/a: ' || length(coalesce(text, ''))
              WHEN idx = 5 THEN '5: first' || chr(10) || '5: label ' || (length(coalesce(text, '')) % 10)
              ELSE idx || ': label ' || (length(coalesce(text, '')) % 10) END AS line
       FROM b),
r AS (SELECT batch_id,
        CASE WHEN batch_id % 2 = 1 THEN '<think>1: x</think>' ELSE '' END
        || coalesce(string_agg(line, chr(10) ORDER BY idx), '') AS reply
      FROM ln GROUP BY batch_id),
c AS (SELECT batch_id, CASE WHEN len(string_split(reply, '</think>')) > 1
                          THEN string_split(reply, '</think>')[2] ELSE reply END AS clean FROM r),
sl AS (SELECT batch_id, string_split(clean, chr(10)) AS parts FROM c),
l AS (SELECT batch_id, unnest(generate_series(0, len(parts) - 1))::INTEGER AS line_no,
             unnest(parts) AS line FROM sl),
p AS (SELECT batch_id, line_no, line,
             TRY_CAST(trim(split_part(line, ':', 1), {WS}) AS INTEGER) AS idx,
             trim(substr(line, strpos(line, ':') + 1), {WS}) AS label
      FROM l WHERE strpos(line, ':') > 0),
lab AS (SELECT batch_id, idx, arg_max(label, line_no) AS label FROM p
        WHERE idx IS NOT NULL GROUP BY batch_id, idx),
al AS (SELECT b.ord, b.batch_id, b.idx, lab.label, NULL::VARCHAR AS error
       FROM b LEFT JOIN lab USING (batch_id, idx))"""

ORACLES["label_batches"] = f"WITH {TAG_CTE} SELECT ord AS doc_id, batch_id, idx FROM b"
ORACLES["label_prompts"] = f"""WITH {TAG_CTE}
SELECT batch_id, count(*)::INTEGER AS n_texts,
       {_sql_str(ITEMS_HEADER)} || string_agg(idx || '. ' || coalesce(text, ''), chr(10) ORDER BY idx) AS prompt
FROM b GROUP BY batch_id"""
ORACLES["label_replies"] = f"WITH {TAG_CTE} SELECT batch_id, reply, NULL::VARCHAR AS error FROM r"
ORACLES["label_parse"] = f"WITH {TAG_CTE} SELECT batch_id, idx, label FROM lab"
ORACLES["label_quarantine"] = f"""WITH {TAG_CTE}
SELECT batch_id, line_no, line, 'bad_index' AS reason FROM p WHERE idx IS NULL"""
ORACLES["label_align"] = f"WITH {TAG_CTE} SELECT ord AS doc_id, batch_id, idx, label, error FROM al"
_GEN = "'positive', 'negative', 'neutral', 'good review', 'bad review'"
ORACLES["label_validate"] = f"""WITH {TAG_CTE},
v AS (SELECT ord, label, trim(label, {WS}) AS lab FROM al WHERE label IS NOT NULL),
w AS (SELECT ord, label, lab,
             CASE WHEN lab = '' THEN 0 ELSE len(regexp_split_to_array(lab, '\\s+')) END::INTEGER AS n_words
      FROM v)
SELECT ord AS doc_id, label, n_words,
  CASE WHEN lab = '' THEN 'empty'
       WHEN regexp_matches(label, '[\\r\\n]') THEN 'multiline'
       WHEN n_words > 5 THEN 'too_many_words'
       WHEN lower(lab) IN ({_GEN}) THEN 'generic' END IS NULL AS valid,
  CASE WHEN lab = '' THEN 'empty'
       WHEN regexp_matches(label, '[\\r\\n]') THEN 'multiline'
       WHEN n_words > 5 THEN 'too_many_words'
       WHEN lower(lab) IN ({_GEN}) THEN 'generic' END AS reason
FROM w"""
ORACLES["label_freq"] = f"WITH {TAG_CTE} SELECT label, count(*) AS n FROM al WHERE label IS NOT NULL GROUP BY label"

# ---------------------------------------------------------------- vectors
VEC_CTE = VOCAB_CTE + f""",
jj AS (SELECT range AS j FROM range(8)),
wv AS (SELECT v.word, v.id, jj.j,
              ((instr('0123456789abcdef', substr(md5(v.word || ':' || jj.j), 1, 1)) - 8.5) / 8)::DOUBLE AS x
       FROM v, jj WHERE v.id >= 2 AND substr(md5(v.word), 1, 1) <> '0'),
unk AS (SELECT j, avg(x) AS x FROM wv GROUP BY j),
vt AS (SELECT v.id, jj.j, coalesce(wv.x, 0.0) AS x
       FROM (SELECT * FROM v WHERE id >= 2) v CROSS JOIN jj LEFT JOIN wv ON wv.id = v.id AND wv.j = jj.j
       UNION ALL SELECT 1, j, x FROM unk),
ti AS (SELECT t.ord, t.pos, coalesce(vv.id, 1) AS id
       FROM t LEFT JOIN (SELECT word, id FROM v WHERE id >= 2) vv ON t.token = vv.word WHERE t.pos < {L}),
nt AS (SELECT ord, count(*) AS n FROM ti GROUP BY ord),
pooled AS (SELECT ti.ord, vt.j, sum(vt.x) AS s FROM ti JOIN vt ON ti.id = vt.id GROUP BY ti.ord, vt.j),
full_ AS (SELECT d.ord, jj.j, coalesce(p.s / nt.n, 0.0) AS m
          FROM d CROSS JOIN jj LEFT JOIN pooled p ON p.ord = d.ord AND p.j = jj.j
          LEFT JOIN nt ON nt.ord = d.ord),
nrm AS (SELECT ord, greatest(sqrt(sum(m * m)), 1e-12) AS nr FROM full_ GROUP BY ord)"""

ORACLES["sentence_vectors"] = f"""WITH {VEC_CTE}
SELECT full_.ord AS doc_id, full_.j::INTEGER AS j, round(m / nr, 6) AS value FROM full_ JOIN nrm USING (ord)"""

ORACLES["sentence_vectors_300"] = f"""WITH {VEC_CTE.replace(
    "SELECT range AS j FROM range(8)", "SELECT range AS j FROM range(300)")}
SELECT ord AS doc_id, j::INTEGER AS j, CASE WHEN round(m * 0.987654321, 6) = 0 THEN 0.0::DOUBLE
       ELSE round(m * 0.987654321, 6) END AS value FROM full_"""
ORACLES["encoded_texts"] = f"""WITH {TOKENS_CTE},
h AS (SELECT ord, md5(token) AS h FROM t WHERE pos < 64),
n AS (SELECT ord, count(*) AS n FROM h GROUP BY ord),
b AS (SELECT ord, ('0x' || substr(h, 1, 2))::INTEGER % 64 AS j,
             sum(CASE WHEN ('0x' || substr(h, 15, 2))::INTEGER >= 128 THEN -1.0 ELSE 1.0 END) AS s FROM h GROUP BY 1, 2),
v AS (SELECT b.ord, b.j, s / n AS x FROM b JOIN n USING (ord)),
r AS (SELECT ord, greatest(sqrt(sum(x * x)), 1e-12) AS r FROM v GROUP BY ord)
SELECT d.doc_id, jj.j::INTEGER AS j, round(coalesce(x / r, 0)::FLOAT::DOUBLE, 6) AS value
FROM documents d CROSS JOIN (SELECT range AS j FROM range(64)) jj
LEFT JOIN v ON v.ord = d.doc_id AND v.j = jj.j LEFT JOIN r ON r.ord = d.doc_id"""
ORACLES["cluster_gate"] = """SELECT lang, source, count(*) AS n,
       CASE WHEN count(*) >= 60 THEN 'clustered' ELSE 'skipped' END AS status FROM documents GROUP BY CUBE (lang, source)"""
ORACLES["pca_correlation"] = """SELECT least(50, max(len(embedding)), count(*) - 1)::INTEGER AS used, 0.0::DOUBLE AS largest
FROM embeddings"""
ORACLES["polarity_totals"] = """SELECT quality AS label, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY quality"""
ORACLES["kmeans_nearest"] = "SELECT count(*) AS n_rows, 0::BIGINT AS n_wrong FROM embeddings"
ORACLES["vector_coverage"] = f"""WITH {VEC_CTE},
f AS (SELECT count(DISTINCT word) AS found FROM wv)
SELECT f.found, (SELECT count(*) FROM v) AS needed,
       round(f.found / (SELECT count(*) FROM v), 6) AS coverage FROM f"""

ORACLES["padded_vectors"] = f"""WITH {VEC_CTE},
nv AS (SELECT full_.ord, (m / nr)::FLOAT::DOUBLE AS x FROM full_ JOIN nrm USING (ord))
SELECT ord AS doc_id, 768 AS width, round(sqrt(sum(x * x)), 6) AS norm FROM nv GROUP BY ord"""

ORACLES["normalized_embeddings"] = """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT id, v, greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12) AS nr FROM e),
u AS (SELECT id, unnest(generate_series(0, len(v) - 1))::INTEGER AS j, unnest(v) AS x, nr FROM n)
SELECT id, j, round(x / nr, 6) AS value FROM u"""

# ---------------------------------------------------------------- annotation
PARSE_CTE = r"""wd AS (SELECT doc_id AS ord, regexp_extract_all(coalesce(text, ''), '\p{L}+') AS ws FROM documents),
w AS (SELECT ord, unnest(generate_series(0, len(ws) - 1)) AS pos, unnest(ws) AS w FROM wd),
tk AS (SELECT ord, (pos // 8)::INTEGER AS sent_id, (pos % 8 + 1)::INTEGER AS word_id, w AS text,
         ['NOUN', 'VERB', 'ADJ', 'PROPN', 'PRON', 'DET'][length(w) % 6 + 1] AS upos,
         (CASE WHEN pos % 8 = 0 AND NOT (ord % 5 = 0 AND pos < 8) THEN 0
               WHEN pos % 8 = 0 THEN 2
               WHEN (ord + pos) % 7 = 0 AND NOT (ord % 5 = 0 AND pos < 8) THEN 0
               ELSE pos % 8 END)::INTEGER AS head,
         CASE (length(w) + pos) % 4 WHEN 0 THEN 'nsubj' WHEN 1 THEN 'nsubj:pass' ELSE 'dep' END AS deprel
       FROM w)"""

ENTITY_PATTERNS = (
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("URL", r"https?://[^\s]+"),
    ("DATE", r"[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    ("NUMBER", r"[0-9]+(?:[.,][0-9]+)*"),
)

_ENT_ALL = "|".join(f"({p})" for _, p in ENTITY_PATTERNS).replace("'", "''")
_ENT_KIND = "CASE " + " ".join(
    f"WHEN regexp_full_match(text, '{p}') THEN '{n}'" for n, p in ENTITY_PATTERNS) + " END"
ENT_CTE = f"""ed AS (SELECT doc_id AS ord, regexp_extract_all(coalesce(text, ''), '{_ENT_ALL}') AS es FROM documents),
en AS (SELECT ord, unnest(generate_series(0, len(es) - 1))::INTEGER AS ent_ord, unnest(es) AS text FROM ed),
ent AS (SELECT ord, ent_ord, text, {_ENT_KIND} AS type FROM en)"""

SUBJ = "SELECT DISTINCT ord, text AS subject FROM tk WHERE deprel LIKE 'nsubj%'"
PAIRS = """SELECT a.ord, a.sent_id, a.word_id, a.text AS adjective, h.text AS subject
FROM tk a JOIN tk h ON a.ord = h.ord AND a.sent_id = h.sent_id AND a.head = h.word_id
WHERE a.upos = 'ADJ' AND a.head <> 0 AND h.upos IN ('NOUN', 'PROPN', 'PRON')"""
KW = "SELECT DISTINCT ord, text AS keyword FROM tk WHERE upos IN ('NOUN', 'PROPN', 'VERB') AND length(text) > 1"
EV = """SELECT ord, arg_min(text, sent_id * 1000000 + CASE WHEN upos = 'VERB' THEN 0 ELSE 100000 END + word_id)
  AS main_event FROM tk WHERE head = 0 GROUP BY ord"""

ORACLES["parse_tokens"] = f"WITH {PARSE_CTE} SELECT ord AS doc_id, sent_id, word_id, text, upos, head, deprel FROM tk"
ORACLES["entities"] = f"WITH {ENT_CTE} SELECT ord AS doc_id, ent_ord, text, type FROM ent"
ORACLES["subjects"] = f"WITH {PARSE_CTE} SELECT ord AS doc_id, subject FROM ({SUBJ})"
ORACLES["adj_pairs"] = f"WITH {PARSE_CTE} SELECT ord AS doc_id, sent_id, word_id, adjective, subject FROM ({PAIRS})"
ORACLES["keywords"] = f"WITH {PARSE_CTE} SELECT ord AS doc_id, keyword FROM ({KW})"
ORACLES["main_event"] = f"""WITH {PARSE_CTE}, ev AS ({EV})
SELECT d.doc_id, ev.main_event FROM documents d LEFT JOIN ev ON ev.ord = d.doc_id"""
ORACLES["text_analysis"] = f"""WITH {PARSE_CTE}, {ENT_CTE},
e AS (SELECT ord, count(*)::INTEGER AS n, string_agg(text || '/' || type, '|' ORDER BY ent_ord) AS s FROM ent GROUP BY ord),
s AS (SELECT ord, string_agg(subject, '|' ORDER BY subject) AS s FROM ({SUBJ}) GROUP BY ord),
p AS (SELECT ord, string_agg(adjective || '>' || subject, '|' ORDER BY sent_id, word_id) AS s FROM ({PAIRS}) GROUP BY ord),
k AS (SELECT ord, string_agg(keyword, '|' ORDER BY keyword) AS s FROM ({KW}) GROUP BY ord),
ev AS ({EV})
SELECT d.doc_id, coalesce(e.n, 0) AS n_entities, coalesce(e.s, '') AS entities, coalesce(s.s, '') AS subjects,
       coalesce(p.s, '') AS adj_pairs, ev.main_event, coalesce(k.s, '') AS keywords
FROM documents d LEFT JOIN e ON e.ord = d.doc_id LEFT JOIN s ON s.ord = d.doc_id
LEFT JOIN p ON p.ord = d.doc_id LEFT JOIN k ON k.ord = d.doc_id LEFT JOIN ev ON ev.ord = d.doc_id"""

ORACLES["parser_entities"] = f"""WITH {PARSE_CTE},
e AS (SELECT ord, count(*)::INTEGER AS n, string_agg(text, '|' ORDER BY sent_id, word_id) AS s
      FROM tk WHERE upos = 'PROPN' GROUP BY ord)
SELECT d.doc_id, coalesce(e.n, 0) AS n_entities, coalesce(e.s, '') AS entities
FROM documents d LEFT JOIN e ON e.ord = d.doc_id"""
ORACLES["gazetteer_entities"] = f"""WITH {PARSE_CTE},
se AS (SELECT ord, sent_id, list(text ORDER BY word_id) AS ws, list(word_id ORDER BY word_id) AS ids FROM tk GROUP BY 1, 2),
g AS (SELECT DISTINCT array_to_string(ws[1:n], ' ') AS text, n
      FROM (SELECT *, 1 + (ord * 7 + sent_id) % 12 AS n FROM se) WHERE len(ws) >= n),
runs AS (SELECT ord, sent_id, ids[i] AS word_id, n, array_to_string(ws[i:i + n - 1], ' ') AS text
         FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM se, (SELECT DISTINCT n FROM g) WHERE len(ws) >= n))
SELECT ord AS doc_id, sent_id, word_id, text, 'PHRASE' AS type FROM runs JOIN g USING (n, text)"""

# ---------------------------------------------------------------- clustering
CENTRES_CTE = """e AS (SELECT vec_id AS id, label AS cluster, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT id, cluster, unnest(generate_series(1, len(v))) AS j, unnest(v) AS x FROM e WHERE cluster <> -1),
cj AS (SELECT cluster, j, avg(x) AS m FROM u GROUP BY cluster, j),
c AS (SELECT cluster, list(m ORDER BY j) AS cv FROM cj GROUP BY cluster)"""

ORACLES["nearest_centre"] = f"""WITH {CENTRES_CTE},
dd AS (SELECT e.id, c.cluster, list_distance(e.v, c.cv) AS d FROM e, c)
SELECT id, (arg_min(cluster, d * 1000000 + cluster))::INTEGER AS center FROM dd GROUP BY id"""

ORACLES["knn_graph"] = """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
k AS (SELECT greatest(5, (count(*) * 0.01)::BIGINT) AS k FROM e),
dd AS (SELECT a.id, b.id AS nbr, list_distance(a.v, b.v) AS dist FROM e a, e b WHERE a.id <> b.id),
r AS (SELECT id, nbr, dist, row_number() OVER (PARTITION BY id ORDER BY dist, nbr) AS rank FROM dd)
SELECT id, rank::INTEGER AS rank, nbr, round(dist, 6) AS dist FROM r WHERE rank <= (SELECT k FROM k)"""

ORACLES["core_distance"] = """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
k AS (SELECT greatest(5, (count(*) * 0.01)::BIGINT) AS k FROM e),
dd AS (SELECT a.id, list_distance(a.v, b.v) AS dist FROM e a, e b WHERE a.id <> b.id),
r AS (SELECT id, dist, row_number() OVER (PARTITION BY id ORDER BY dist) AS rank FROM dd)
SELECT id, round(max(dist), 6) AS core FROM r WHERE rank <= (SELECT k FROM k) GROUP BY id"""

ORACLES["cluster_attach"] = """SELECT 'given' AS algo, d.doc_id, e.label AS cluster
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"""

ORACLES["cluster_colors"] = """WITH p AS (SELECT DISTINCT CASE WHEN label = 0 THEN -1 ELSE label END AS cluster FROM embeddings)
SELECT cluster, cluster = -1 AS is_noise,
       CASE WHEN cluster = -1 THEN NULL
            ELSE ((dense_rank() OVER (ORDER BY CASE WHEN cluster = -1 THEN NULL ELSE cluster END) - 1) % 10)::INTEGER
       END AS color_idx
FROM p"""

# ---------------------------------------------------------------- sources
ORACLES["csv_roundtrip"] = """SELECT doc_id, text, lang FROM documents"""
ORACLES["csv_texts"] = """SELECT doc_id, md5(text) AS text_md5 FROM documents"""
ORACLES["label_array"] = """WITH n AS (SELECT lang || ' ' || count(*) AS label FROM documents GROUP BY lang)
SELECT row_number() OVER (ORDER BY label) - 1 AS ord, label FROM n"""
ORACLES["label_failures"] = f"""WITH {TAG_CTE}
SELECT ord AS doc_id, batch_id, CASE WHEN batch_id % 3 <> 0 THEN label END AS label,
       CASE WHEN batch_id % 3 = 0 THEN 'TimeoutError: no answer' END AS error FROM al"""
ORACLES["label_retry"] = f"""WITH {TAG_CTE}
SELECT batch_id, CASE WHEN batch_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS runs,
       CASE WHEN batch_id % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS n_failed FROM r"""
ORACLES["label_compacted"] = f"""WITH {TAG_CTE}
SELECT batch_id, 1::BIGINT AS n_rows, CASE WHEN batch_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS run, 0::BIGINT AS n_failed,
       CASE WHEN batch_id % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS n_again, 3::INTEGER AS n_commits FROM r"""
ORACLES["hdbscan_planted"] = """WITH m AS (SELECT vec_id, min(vec_id) OVER (PARTITION BY label) AS first FROM embeddings)
SELECT vec_id AS id, (dense_rank() OVER (ORDER BY first) - 1)::INTEGER AS cluster FROM m"""
ORACLES["tag_job_coverage"] = """WITH u AS (SELECT min(doc_id) AS rep, count(*) AS n FROM documents GROUP BY coalesce(text, '')),
num AS (SELECT n, (row_number() OVER (ORDER BY rep) - 1) % 30 + 1 AS idx FROM u),
t AS (SELECT sum(n)::BIGINT AS n_rows, (sum(n) FILTER (WHERE idx % 11 <> 0 AND idx % 13 <> 0))::BIGINT AS n_labelled FROM num)
SELECT algo, n_rows, n_labelled AS n_clustered, n_labelled AS n_samples FROM t, (VALUES ('kmeans'), ('hdbscan')) a(algo)"""
ORACLES["word_vector_file"] = f"""WITH {VEC_CTE}
SELECT word, j::INTEGER AS j, round(x, 6) AS value FROM wv"""

# ---------------------------------------------------------------- promised features
REVIEW_CTE = TAG_CTE + """,
rv AS (SELECT doc_id AS ord, 'hostile' AS label, 'correct' AS decision, TIMESTAMP '2024-01-02' AS ts
       FROM labels WHERE toxic = 1
       UNION ALL SELECT doc_id, 'low effort', 'correct', TIMESTAMP '2024-01-01' FROM labels WHERE quality = 0
       UNION ALL SELECT doc_id, NULL, 'confirm', TIMESTAMP '2024-01-01' FROM labels
       WHERE quality = 1 AND toxic = 0),
lr AS (SELECT ord, max(ts) AS ts FROM rv GROUP BY ord),
last AS (SELECT rv.ord, rv.label AS review_label, rv.decision FROM rv JOIN lr USING (ord, ts)),
mg AS (SELECT al.ord,
              CASE WHEN last.decision = 'correct' THEN last.review_label ELSE al.label END AS label,
              al.label AS model_label,
              CASE WHEN last.decision IN ('correct', 'confirm') THEN 'human' ELSE 'model' END AS source
       FROM al LEFT JOIN last USING (ord))"""

ORACLES["review_overlay"] = f"WITH {REVIEW_CTE} SELECT ord AS doc_id, label, model_label, source FROM mg"
ORACLES["review_agreement"] = f"""WITH {REVIEW_CTE}
SELECT count(*) AS n_reviewed, count(*) FILTER (WHERE label = model_label) AS n_agree,
       CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE label = model_label) / count(*), 6) END
         AS agreement
FROM mg WHERE source = 'human'"""
ORACLES["online_vectors"] = ORACLES["sentence_vectors"]

# distances compared to 9 places: equal vectors are ties, which go to the smaller centre
ORACLES["online_centres"] = f"""WITH {VEC_CTE},
x AS (SELECT full_.ord, j, m / nr AS x FROM full_ JOIN nrm USING (ord)),
dd AS (SELECT a.ord, c.ord AS center, round(sum((a.x - c.x) * (a.x - c.x)), 9) AS d
       FROM x a JOIN x c ON a.j = c.j AND c.ord < 5 GROUP BY a.ord, c.ord)
SELECT ord AS doc_id, (min(struct_pack(d := d, center := center))).center::INTEGER AS center FROM dd GROUP BY ord"""

ORACLES["online_reuse"] = """SELECT CASE WHEN text IS NOT NULL THEN 'tone ' || (length(text) % 7) END AS label,
  count(*) AS n_rows, count(DISTINCT text) AS n_made FROM conversations GROUP BY 1"""


def _steps(batches: int, k: int) -> str:
    """The mini-batch update, one CTE a batch: nearest centre, sums, centres moved by one over the weight seen."""
    parts = [f"""e AS (SELECT vec_id AS id, vec_id % {batches} AS turn, embedding::DOUBLE[] AS v FROM embeddings
             WHERE embedding IS NOT NULL),
s0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY id) - 1)::INTEGER AS c, 0.0::DOUBLE AS w, v
                    FROM (SELECT * FROM e ORDER BY id LIMIT {k}))"""]
    for t in range(batches):
        parts.append(f"""n{t} AS (SELECT (min(struct_pack(d := list_distance(e.v, s.v), c := s.c))).c AS c, any_value(e.v) AS v
        FROM e, s{t} s WHERE e.turn = {t} GROUP BY e.id),
x{t} AS (SELECT c, unnest(v) AS x, unnest(generate_series(1, len(v))) AS j FROM n{t}),
a{t} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM x{t} GROUP BY c, j),
l{t} AS (SELECT c, list(s ORDER BY j) AS s, any_value(n) AS n FROM a{t} GROUP BY c),
s{t + 1} AS MATERIALIZED (SELECT s.c, s.w + coalesce(l.n, 0) AS w,
    CASE WHEN l.n IS NULL THEN s.v
         ELSE list_transform(generate_series(1, len(s.v)), lambda i: s.v[i] + (l.s[i] - l.n * s.v[i]) / (s.w + l.n)) END AS v
    FROM s{t} s LEFT JOIN l{t} l USING (c))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT c AS cluster, w AS weight, (j - 1)::INTEGER AS j, round(x, 6) AS value
FROM (SELECT c, w, unnest(v) AS x, unnest(generate_series(1, len(v))) AS j FROM s{batches})"""


ORACLES["minibatch_steps"] = _steps(8, 5)
ORACLES["minibatch_cost"] = """SELECT count(*) AS n_rows, least(5, count(*)) AS n_clusters, true AS close FROM embeddings"""

ORACLES["label_single"] = """SELECT conv_id, turn,
  'tone ' || (length(coalesce(text, '')) % 7) AS label, NULL::VARCHAR AS error
FROM conversations"""
ORACLES["label_store_roundtrip"] = f"WITH {TAG_CTE} SELECT ord AS doc_id, batch_id, idx, label FROM al"
ORACLES["vector_table_roundtrip"] = f"""WITH {VEC_CTE}
SELECT full_.ord AS doc_id, full_.j::INTEGER AS j, round((m / nr)::FLOAT::DOUBLE, 6) AS value
FROM full_ JOIN nrm USING (ord)"""
