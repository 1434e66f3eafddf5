"""For each core query that SQL can state, the same in DuckDB's SQL."""

from __future__ import annotations

from ..functions.text import STOPWORDS

_STOP = "[" + ",".join(f"'{w}'" for w in STOPWORDS) + "]"
_RUN = r"[A-Za-z0-9]+|[\p{Han}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}]+"


def terms(text: str) -> str:
    """SQL of the terms of a text."""
    pairs = "flatten(list_transform(range(1, length(r) + 1), lambda i: CASE WHEN i < length(r) THEN [r[i], r[i:i + 1]] ELSE [r[i]] END))"
    each = f"list_transform(regexp_extract_all({text}, '{_RUN}'), lambda r: CASE WHEN regexp_matches(r, '^[A-Za-z0-9]') THEN [lower(r)] ELSE {pairs} END)"
    return f"list_filter(flatten({each}), lambda t: NOT list_contains({_STOP}, t))"


_CUR = "cur AS (SELECT * EXCLUDE (rn, deleted), coalesce(deleted, false) AS deleted FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST) AS rn FROM entities WHERE id IS NOT NULL) WHERE rn = 1)"
_FINITE = "(vector IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64)"
_USABLE = f"({_FINITE} AND len(list_filter(vector, lambda x: x <> 0)) > 0)"
_UNIT = "list_transform(vector, lambda x: x::DOUBLE / sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[])))"
_T = "。！？\n.!?"

_CHANGES = """raw AS (SELECT seq, rec_type::INT AS rec_type, coalesce(ts, -4611686018427387904) AS ts, payload, TRY(decode(payload)) AS s FROM oplog WHERE rec_type IN (1, 2) AND octet_length(payload) > 0),
par AS (SELECT *, CASE WHEN json_valid(s) THEN CASE WHEN regexp_matches(s, '^\\s*\\{') THEN json_extract_string(s, '$.id') WHEN rec_type = 2 THEN regexp_extract(s, '^\\s*"?([0-9]+)"?\\s*$', 1) END END AS raw_id,
  rec_type = 2 OR coalesce(CASE WHEN json_valid(s) AND regexp_matches(s, '^\\s*\\{') THEN json_extract_string(s, '$.deleted') END, '') = 'true' AS gone FROM raw WHERE s IS NOT NULL),
ch AS (SELECT raw_id::BIGINT AS id, seq, rec_type, ts, payload, gone FROM par WHERE regexp_matches(raw_id, '^[0-9]{1,19}$'))"""

_P3 = f"""WITH {_CHANGES},
one AS (SELECT id, rec_type, ts, gone, min(seq) AS seq FROM ch GROUP BY id, rec_type, ts, gone, payload),
last AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, rec_type DESC, seq DESC) AS rn FROM one)"""

_Q = f"q AS (SELECT qid, unnest(list_distinct({terms('query')})) AS term FROM requests)"


def _bm25(stats: str, k: int = 10) -> str:
    return f"""{_CUR},
docs AS (SELECT id, deleted, list_transform(coalesce(terms, []), lambda t: t.term) AS ts FROM cur),
st AS (SELECT count(*)::DOUBLE AS n, sum(len(ts))::DOUBLE / count(*) AS avgdl FROM docs {stats}),
{_Q},
p AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM docs WHERE NOT deleted) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM p GROUP BY term),
sc AS (SELECT q.qid, p.id, round(sum(ln((st.n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / st.avgdl))), 6) AS score
  FROM q JOIN p USING (term) JOIN dfs USING (term), st GROUP BY q.qid, p.id),
kr AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc),
key10 AS (SELECT * FROM kr WHERE rank <= {k})"""


_REQ = """req AS (SELECT qid, CASE WHEN coalesce(collection, '') = '' THEN 'default' ELSE collection END AS collection, coalesce(query, '') AS query,
  CASE WHEN top_k BETWEEN 1 AND 200 THEN top_k ELSE 12 END AS top_k, CASE WHEN metric IN ('cosine', 'l2') THEN metric ELSE 'cosine' END AS metric,
  CASE WHEN index_type IN ('hnsw', 'flat') THEN index_type ELSE 'hnsw' END AS index_type, CASE WHEN rrf_k > 0 THEN rrf_k ELSE 60 END AS rrf_k,
  CASE WHEN vector_weight > 0 THEN vector_weight ELSE 1.0 END AS vector_weight, CASE WHEN keyword_weight > 0 THEN keyword_weight ELSE 1.0 END AS keyword_weight,
  CASE WHEN modality <> '' THEN modality END AS modality, coalesce(filter, '') AS filter,
  CASE WHEN collection IS NOT NULL AND collection <> '' AND collection NOT IN (SELECT name FROM collections) THEN 40400 WHEN trim(coalesce(query, '')) = '' THEN 40001 END AS error FROM requests)"""


def _tag(want: str, op: str = "=") -> str:
    test = (lambda t: f"contains(lower(trim({t})), '{want}')") if op == "has" else (lambda t: f"lower(trim({t})) {op} '{want}'")
    return f"(len(list_filter(coalesce(tags, []), lambda t: {test('t')})) > 0 OR coalesce({test("scalar['tag']")}, false))"


def _has(col: str, want: str) -> str:
    return f"contains(lower(trim(coalesce({col}, ''))), '{want}')"


_MATCH = f"""CASE filter WHEN 'score > 0.02' THEN {{score}} WHEN 'tag == "rag"' THEN {_tag('rag')}
  WHEN 'tags == "zh" || modality == "image"' THEN ({_tag('zh')} OR lower(trim(coalesce(emod, ''))) = 'image') ELSE true END"""


def _hybrid(mode: str) -> str:
    admitted = "JOIN" if mode == "pre" else ""
    ents = f"en AS (SELECT id, deleted, collection AS ecol, modality AS emod, tags, scalar, CASE WHEN {_USABLE} THEN {_UNIT} END AS v FROM cur)"
    dist = "round(CASE WHEN rq.metric = 'l2' THEN list_distance(rq.v, en.v) ELSE 1 - list_dot_product(rq.v, en.v) END, 6)"
    admit = f"AND en.ecol = rq.collection AND (rq.modality IS NULL OR rq.modality = en.emod) AND {_MATCH.format(score='true')}" if admitted else ""
    key = f"kr2 AS (SELECT sc.qid, sc.id, row_number() OVER (PARTITION BY sc.qid ORDER BY sc.score DESC, sc.id) AS rank FROM sc JOIN rq USING (qid) JOIN en ON en.id = sc.id WHERE NOT en.deleted {admit})"
    return f"""WITH {_bm25('WHERE NOT deleted' if mode == 'pre' else '')}, {_REQ}, {ents},
rq AS (SELECT req.*, greatest(4 * top_k, 32) AS pool, e.v FROM req LEFT JOIN (SELECT id, v FROM en WHERE NOT deleted AND v IS NOT NULL) e ON e.id = req.qid WHERE error IS NULL),
vd AS (SELECT rq.qid, en.id, {dist} AS dist FROM rq, en WHERE rq.v IS NOT NULL AND en.v IS NOT NULL AND NOT en.deleted AND (coalesce(rq.modality, '') <> 'image' OR rq.query = '') {admit}),
vr AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM vd),
{key},
fu AS (SELECT qid, id, min(CASE WHEN ch = 0 THEN rank END) AS vk, min(CASE WHEN ch = 1 THEN rank END) AS kk FROM
  (SELECT qid, id, rank, 0 AS ch FROM vr UNION ALL SELECT qid, id, rank, 1 FROM kr2) JOIN (SELECT qid, pool FROM rq) USING (qid) WHERE rank <= pool GROUP BY qid, id),
hi AS (SELECT fu.*, rq.* EXCLUDE (qid), round(coalesce(vector_weight / (rrf_k + vk), 0) + coalesce(keyword_weight / (rrf_k + kk), 0), 9) AS rrf FROM fu JOIN rq USING (qid)),
po AS (SELECT hi.*, en.* EXCLUDE (id, deleted, v), en.v AS ev, row_number() OVER (PARTITION BY hi.qid ORDER BY rrf DESC, hi.id) AS position
  FROM hi JOIN en ON en.id = hi.id WHERE NOT en.deleted AND en.ecol = hi.collection AND (hi.modality IS NULL OR hi.modality = en.emod) AND {_MATCH.format(score='rrf > 0.02')})"""


_HIT = """round(CASE WHEN v IS NOT NULL AND ev IS NOT NULL AND NOT (emod = 'image' AND query <> '') THEN CASE WHEN metric = 'l2' THEN 1 / (1 + list_distance(v, ev)) ELSE list_dot_product(v, ev) END ELSE rrf END, 6)"""


def _hits(mode: str) -> str:
    return f"{_hybrid(mode)} SELECT qid, position::INT AS position, id, {_HIT} AS score, rrf, coalesce(vk, 0)::INT AS vec_rank, coalesce(kk, 0)::INT AS key_rank, coalesce(scalar['title'], '') AS title FROM po WHERE position <= top_k"


_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, octet_length(encode({s})) + 1), lambda i: ('0x' || substr(hex(encode({s})), 2 * i::INT - 1, 2))::INT::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
_SIGNED = "(CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END)::BIGINT"

_FLAT = "WITH d AS (SELECT q.vec_id AS qid, e.vec_id AS id, round({dist}, 6) + 0.0 AS dist FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM d) SELECT qid, id, dist, rank::INT AS rank FROM r WHERE rank <= 10"
_COS = "1 - list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"
_EUC = "list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"

_CITE = f"""WITH {_bm25('', 6)},
ci AS (SELECT k.qid, k.rank::INT AS index, k.id, coalesce(scalar['title'], '') || ' ' || CASE WHEN coalesce(content, '') <> '' THEN content ELSE coalesce(caption, '') END AS context FROM key10 k JOIN cur USING (id))"""
_CUT = r"regexp_replace({s}, '^\s+|\s+$', '', 'g')"
_ANSWER = f"""{_CITE},
li AS (SELECT qid, string_agg(index || ') ' || {_CUT.format(s="CASE WHEN length(context) > 120 THEN substr(context, 1, 120) || '…' ELSE context END")} || chr(10), '' ORDER BY index) AS l FROM ci WHERE index <= 4 GROUP BY qid),
an AS (SELECT r.qid, '[MOCK] 基于检索片段的抽取式回答：' || coalesce(query, '') || chr(10) || chr(10) || CASE WHEN l IS NULL THEN '知识库中暂无足够证据，请先入库文档或图片。' ELSE '综合下列证据：' || chr(10) || l END AS answer FROM requests r LEFT JOIN li USING (qid))"""


def _filtered(where: str) -> str:
    return f"WITH {_CUR} SELECT id FROM cur WHERE NOT deleted AND ({where})"


_BYTES = "(4 * coalesce(len(vector), 0) + coalesce(octet_length(encode(content)), 0) + coalesce(octet_length(encode(caption)), 0) + coalesce(octet_length(encode(content_hash)), 0) + 128)"
_LOG = "lg AS (SELECT *, coalesce(octet_length(payload), 0) + 17 AS bytes FROM oplog)"
_SEG = "SELECT log_file, segment::INT AS segment, count(*) AS rows, sum(bytes)::BIGINT AS bytes, min(ts) AS min_ts, max(ts) AS max_ts FROM s GROUP BY ALL"
_CH = "vec AS (SELECT qid, id, min(vec_rank) AS rank FROM fused WHERE vec_rank > 0 GROUP BY ALL), key AS (SELECT qid, id, min(key_rank) AS rank FROM fused WHERE key_rank > 0 GROUP BY ALL), u AS (SELECT qid, id, min(CASE WHEN c = 0 THEN rank END) AS v, min(CASE WHEN c = 1 THEN rank END) AS k FROM (SELECT *, 0 AS c FROM vec UNION ALL SELECT *, 1 FROM key) GROUP BY ALL)"

_CHUNK = """n AS (SELECT doc_id, text, CASE WHEN length(text) <= 480 THEN 1 ELSE ceil((length(text) - 80) / 400.0)::INT END AS n FROM documents WHERE text IS NOT NULL AND {where}),
c AS (SELECT doc_id, unnest(range(n))::INT AS chunk_index, text FROM n), p AS (SELECT doc_id, chunk_index, substr(text, chunk_index * 400 + 1, 480) AS content FROM c),
z AS (SELECT *, coalesce(sum(octet_length(encode(content))) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS char_offset FROM p)"""

_EMBED = """WITH f AS (SELECT {id}, 't:' || unnest({terms}) AS name, 1.0::DOUBLE AS w FROM {table}
  UNION ALL SELECT {id}, 'g:' || unnest(list_transform(range(1, length({text}) - 1), lambda i: substr({text}, i::INT, 3))), 0.4 FROM {table}
  UNION ALL SELECT {id}, 'raw:' || {text}, 1.2 FROM {table} WHERE length({text}) < 3 AND {text} <> ''),
u AS (SELECT DISTINCT name FROM f), h AS (SELECT name, {fnv} AS h FROM u),
a AS (SELECT {id}, (h % 64)::INT AS i, ((h // 131072) % 64)::INT AS j, CASE WHEN h % 2 = 1 THEN -w ELSE w END AS w FROM f JOIN h USING (name)),
s AS (SELECT {id}, slot, sum(w) AS x FROM (SELECT {id}, i AS slot, w FROM a UNION ALL SELECT {id}, j, w * 0.35 FROM a WHERE i <> j) GROUP BY ALL),
n AS (SELECT {id}, sqrt(sum(x * x)) AS n FROM s GROUP BY {id}) SELECT {id}, slot, round(x / n, {digits}) AS value FROM s JOIN n USING ({id}) WHERE {keep}
UNION ALL SELECT {id}, 0, 1.0 FROM {table} WHERE {id} NOT IN (SELECT {id} FROM f)"""

SQL: dict[str, str] = {
    "p3_fields": f"""{_P3}, f AS (SELECT id, seq, (SELECT TRY(decode(o.payload)) FROM oplog o WHERE o.seq = last.seq) AS s FROM last WHERE rn = 1 AND NOT gone)
SELECT id, seq, {', '.join(f"json_extract_string(s, '$.{c}') AS {c}" for c in ("collection", "modality", "content", "doc_id", "caption", "content_hash", "mime"))},
  TRY_CAST(json_extract_string(s, '$.chunk_index') AS INT) AS chunk_index, TRY_CAST(json_extract_string(s, '$.width') AS INT) AS width,
  array_to_string(TRY_CAST(json_extract(s, '$.tags') AS VARCHAR[]), ',') AS tags, json_extract_string(s, '$.scalar.title') AS title FROM f""",
    "ingest_chunks": f"""WITH {_CHUNK.format(where="length(regexp_replace(text, '\\s+', '', 'g')) > 0 AND coalesce(collection, 'default') IN (SELECT name FROM collections)")}
SELECT doc_id, chunk_index, char_offset, (SELECT coalesce(d.collection, 'default') FROM documents d WHERE d.doc_id = z.doc_id) AS collection, content, 64::INT AS dim FROM z""",
    "rejected_documents": """SELECT doc_id, error::INT AS error FROM (SELECT doc_id, CASE WHEN length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) = 0 THEN 40001
  WHEN coalesce(collection, 'default') NOT IN (SELECT name FROM collections) THEN 40400 END AS error FROM documents) WHERE error IS NOT NULL""",
    "engine_recovery": f"""WITH {_CHUNK.format(where="length(regexp_replace(text, '\\s+', '', 'g')) > 0")}
SELECT count(*) AS rows, count(*) FILTER (doc_id % 3 = 0) AS deleted, count(*) FILTER (doc_id % 3 <> 0) AS compacted,
  (SELECT max(i) FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id, chunk_index) AS i FROM z) WHERE doc_id % 3 <> 0) AS last_id FROM z""",
    "get_entities": f"WITH {_CUR} SELECT id, collection, modality FROM cur WHERE NOT deleted AND id IN (SELECT qid FROM requests)",
    "image_histogram": """WITH c AS (SELECT n_nationkey::INT AS k, (n_nationkey * 37 % 256) / 255.0::DOUBLE AS r, (n_nationkey * 53 % 256) / 255.0::DOUBLE AS g, (n_nationkey * 91 % 256) / 255.0::DOUBLE AS b FROM nation),
m AS (SELECT *, greatest(r, g, b) AS v, least(r, g, b) AS lo FROM c), d AS (SELECT *, v - lo AS d FROM m),
h AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN v = r THEN ((g - b) / d + CASE WHEN g < b THEN 6 ELSE 0 END) / 6 WHEN v = g THEN ((b - r) / d + 2) / 6 ELSE ((r - g) / d + 4) / 6 END AS hue, CASE WHEN v = 0 THEN 0 ELSE d / v END AS sat FROM d)
SELECT k, (least(floor(hue * 8), 7) * 32 + least(floor(sat * 8), 7) * 4 + least(floor(v * 4), 3))::INT AS bin, 1::INT AS bins, 24::INT AS width, 9::INT AS patches FROM h""",
    "image_ingest": "SELECT name, 160::INT AS width, 160::INT AS height, 'image/png' AS mime, 9::INT AS patches, 1.0::DOUBLE AS norm FROM (VALUES ('gradient'), ('stripes'), ('square'), ('grid')) t(name)",
    "patch_evidence": f"""WITH {_CUR}, v AS (SELECT id, {_UNIT} AS v FROM cur WHERE NOT deleted AND modality = 'image' AND {_USABLE}),
q AS (SELECT id, i::INT AS quarter, list_dot_product(v[i * 16 + 1:i * 16 + 16], v[1:16]) AS s FROM v, range(4) t(i)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, quarter) AS rn FROM q)
SELECT id, (rn - 1)::INT AS place, round(s, 6) AS score, quarter FROM r WHERE rn <= 3 AND s >= 0.05""",
    "plan_channels": f"""WITH {_CUR}, {_REQ}, e AS (SELECT id FROM cur WHERE {_USABLE} AND NOT deleted)
SELECT qid, concat_ws(',', CASE WHEN v THEN 'vector' END, CASE WHEN query <> '' THEN 'keyword' END, CASE WHEN v AND query <> '' THEN 'rrf' END) AS channels
FROM (SELECT *, qid IN (SELECT id FROM e) AND (coalesce(modality, '') <> 'image' OR query = '') AS v FROM req WHERE error IS NULL)""",
    "hnsw_reached": "SELECT count(*) AS asked, true AS reached FROM embeddings WHERE vec_id % 20 = 0",
    "eval_recall": "SELECT 1000::INT AS n, 64::INT AS dim, 20::INT AS queries, 10::INT AS k, true AS pass_recall",
    "chunk_offsets": f"""WITH {_CUR}, t AS (SELECT * FROM cur WHERE modality = 'text' AND NOT deleted)
SELECT id, coalesce(sum(octet_length(encode(content))) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_offset FROM t""",
    "hash_embed_documents": _EMBED.format(id="doc_id", text="text", table="documents", terms=terms("text"), fnv=_FNV.format(s="name"), digits=5, keep="abs(round(x / n, 5)) >= 0.00002"),
    "p3_found": f"{_P3} SELECT id, seq FROM last WHERE rn = 1 AND NOT gone",
    "oplog_recover": f"WITH {_CHANGES}, l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM ch) SELECT id, seq FROM l WHERE rn = 1 AND NOT gone",
    "tokenize_terms": f"SELECT doc_id, array_to_string({terms('text')}, ' ') AS terms FROM documents WHERE text IS NOT NULL",
    "distinct_terms": f"WITH {_Q} SELECT qid, term FROM q",
    "term_stats": f"WITH t AS (SELECT doc_id, unnest({terms('text')}) AS term FROM documents), p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term",
    "token_positions": f"WITH {_CUR} SELECT id, t.term AS term, t.start AS start, t.end AS end FROM (SELECT id, unnest(terms) AS t FROM cur WHERE content IS NOT NULL)",
    "chunk_documents": f"WITH {_CHUNK.format(where='true')} SELECT * FROM z",
    "split_sentences": f"""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^{_T}]*[{_T}]|[^{_T}]+')) AS text, generate_subscripts(regexp_extract_all(text, '[^{_T}]*[{_T}]|[^{_T}]+'), 1) AS i FROM documents WHERE text IS NOT NULL),
e AS (SELECT *, sum(octet_length(encode(text))) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM s) SELECT doc_id, (e - octet_length(encode(text)))::INT AS start, e::INT AS end, text FROM e""",
    "fnv_hash_terms": f"WITH t AS (SELECT DISTINCT unnest({terms('query')}) AS term FROM requests), h AS (SELECT term, {_FNV.format(s="('t:' || term)")} AS h FROM t) SELECT term, {_SIGNED} AS hash FROM h",
    "hash_embed_queries": _EMBED.format(id="qid", text="query", table="requests", terms=terms("query"), fnv=_FNV.format(s="name"), digits=6, keep="round(x / n, 6) <> 0"),
    "parse_tags": "WITH t AS (SELECT doc_id, list_filter(list_transform(coalesce(tags, []), lambda x: trim(x)), lambda x: x <> '') AS t FROM documents) SELECT doc_id, array_to_string(t, '|') AS tags, coalesce(t[1], '') AS first FROM t",
    "answer_excerpts": f"SELECT doc_id, {_CUT.format(s="CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '…' ELSE text END")} AS excerpt FROM documents",
    "vector_pairs": "WITH p AS (SELECT x.vec_id, x.embedding::DOUBLE[] AS a, y.embedding::DOUBLE[] AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1) SELECT vec_id, round(list_dot_product(a, b), 6) AS dot, round(list_distance(a, b), 6) AS l2, round(1 - list_dot_product(a, b), 6) AS cosine_distance, round(1 / (1 + list_distance(a, b)), 6) AS l2_similarity FROM p",
    "vector_normalize": f"WITH {_CUR}, v AS (SELECT id, {_UNIT} AS v FROM cur WHERE NOT deleted AND {_USABLE}) SELECT id, (generate_subscripts(v, 1) - 1)::INT AS slot, round(unnest(v), 6) AS value FROM v",
    "vector_pad": "WITH p AS (SELECT vec_id, list_transform(range(0, 100), lambda i: CASE WHEN i < len(embedding) THEN embedding[i + 1]::DOUBLE ELSE embedding[i % len(embedding) + 1]::DOUBLE * 0.15 END) AS v FROM embeddings) SELECT vec_id, (generate_subscripts(v, 1) - 1)::INT AS slot, round(unnest(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 6) AS value FROM p",
    "vector_valid": f"WITH {_CUR} SELECT id, {_FINITE} AS valid FROM cur",
    "flat_topk_cosine": _FLAT.format(dist=_COS),
    "flat_topk_l2": _FLAT.format(dist=_EUC),
    "flat_native": _FLAT.format(dist=_COS),
    "flat_serial": _FLAT.format(dist=_COS),
    "flat_entities": f"""WITH {_CUR}, v AS (SELECT id, {_UNIT} AS v FROM cur WHERE NOT deleted AND {_USABLE}), q AS (SELECT qid, metric, v FROM requests JOIN v ON v.id = qid),
d AS (SELECT q.qid, v.id, round(CASE WHEN metric = 'l2' THEN list_distance(q.v, v.v) ELSE 1 - list_dot_product(q.v, v.v) END, 6) + 0.0 AS dist FROM q, v),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM d) SELECT qid, id, dist, rank::INT AS rank FROM r WHERE rank <= 10""",
    "bm25_topk": f"WITH {_bm25('')} SELECT qid, id, score, rank::INT AS rank FROM key10",
    "bm25_live_stats": f"WITH {_bm25('WHERE NOT deleted')} SELECT qid, id, score, rank::INT AS rank FROM key10",
    "normalize_requests": f"WITH {_REQ} SELECT * FROM req",
    "rrf_fuse": f"WITH {_CH} SELECT qid, id, round(coalesce(vector_weight / (rrf_k + v), 0) + coalesce(keyword_weight / (rrf_k + k), 0), 9) AS rrf, coalesce(v, 0)::INT AS vec_rank, coalesce(k, 0)::INT AS key_rank FROM u JOIN (SELECT qid, CASE WHEN rrf_k > 0 THEN rrf_k ELSE 60 END AS rrf_k, CASE WHEN vector_weight > 0 THEN vector_weight ELSE 1 END AS vector_weight, CASE WHEN keyword_weight > 0 THEN keyword_weight ELSE 1 END AS keyword_weight FROM requests) USING (qid)",
    "rrf_unweighted": f"WITH {_CH}, s AS (SELECT qid, id, round(coalesce(1 / (60 + v), 0) + coalesce(1 / (60 + k), 0), 9) AS rrf FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, id) AS rank FROM s) SELECT qid, id, rank::INT AS rank, rrf FROM r WHERE rank <= 12",
    "recall_at_k": f"WITH {_CH} SELECT key.qid, round(count(vec.id) / count(*), 6) AS recall FROM key LEFT JOIN (SELECT * FROM vec WHERE rank <= 10) vec USING (qid, id) WHERE key.rank <= 10 GROUP BY key.qid",
    "hybrid_search": _hits("post"),
    "hybrid_prefilter": _hits("pre"),
    "compare_flat": f"""{_hybrid('post')}, gt AS (SELECT rq.qid, en.id, row_number() OVER (PARTITION BY rq.qid ORDER BY round(CASE WHEN rq.metric = 'l2' THEN list_distance(rq.v, en.v) ELSE 1 - list_dot_product(rq.v, en.v) END, 6), en.id) AS rank FROM rq, en WHERE rq.v IS NOT NULL AND en.v IS NOT NULL AND NOT en.deleted)
SELECT gt.qid, round(count(h.id) / count(*), 6) AS recall FROM gt LEFT JOIN (SELECT qid, id FROM po WHERE position <= least(top_k, 12)) h ON h.qid = gt.qid AND h.id = gt.id WHERE gt.rank <= 12 GROUP BY gt.qid""",
    "term_evidence": f"""WITH {_bm25('')}, qt AS (SELECT qid, unnest(t) AS term, generate_subscripts(t, 1) AS q FROM (SELECT qid, {terms('query')} AS t FROM requests)),
q1 AS (SELECT qid, term, min(q) AS q FROM qt GROUP BY ALL), pl AS (SELECT id, unnest(terms) AS t, generate_subscripts(terms, 1) AS p FROM cur WHERE id IN (SELECT id FROM key10)),
o AS (SELECT k.qid, k.id, pl.t.start AS start, pl.t.end AS "end", q1.q, pl.p FROM key10 k JOIN pl USING (id) JOIN q1 ON q1.qid = k.qid AND q1.term = pl.t.term),
f AS (SELECT *, row_number() OVER (PARTITION BY qid, id, start, "end" ORDER BY q, p) AS rn FROM o)
SELECT qid, id, row_number() OVER (PARTITION BY qid, id ORDER BY q, p, start, "end")::INT AS ord, start, "end" FROM f WHERE rn = 1""",
    "rag_citations": f"{_CITE} SELECT qid, index, id, context FROM ci",
    "rag_answer": f"{_ANSWER} SELECT qid, answer FROM an",
    "rag_tokens": f"{_ANSWER} SELECT qid, 'token' AS event, length(answer) AS n, length(answer) - 1 AS last FROM an UNION ALL SELECT qid, 'done', 1, length(answer) FROM an",
    "filter_tag": _filtered(_tag("rag")),
    "filter_tag_not": _filtered(_tag("rag", "<>")),
    "filter_tag_contains": _filtered(_tag("stor", "has")),
    "filter_caption": _filtered(" OR ".join(_has(c, w) for w in ("memory", "日志") for c in ("caption", "content"))),
    "filter_modality": _filtered("lower(trim(coalesce(modality, ''))) = 'image'"),
    "filter_collection": _filtered("lower(trim(coalesce(collection, ''))) = 'handbook' AND lower(trim(coalesce(modality, ''))) <> 'image'"),
    "filter_doc": _filtered(_has("doc_id", "1719446")),
    "filter_source": _filtered(f"{_has('source_ref', 'handbook')} OR {_has('source_ref', 'gallery')}"),
    "filter_nested": _filtered(f"({_tag('rag')} OR {_tag('storage')}) AND (collection = 'handbook' OR modality = 'image') AND {_tag('zh', '<>')}"),
    "filter_blank": _filtered("true"),
    "filter_score": "SELECT DISTINCT qid, id, rrf FROM fused WHERE rrf >= 0.03 AND rrf < 0.05",
    "list_collections": "SELECT name, dim, metric, index_type FROM collections",
    "create_collection": "SELECT name, dim, metric, index_type FROM collections UNION ALL SELECT 'new shelf', 64, 'cosine', 'hnsw'",
    "current_entities": f"WITH {_CUR} SELECT id, deleted, collection, modality, source_ref FROM cur",
    "drop_collection": f'WITH {_CUR} SELECT collection, count(*) FILTER (WHERE NOT deleted AND coalesce(collection, \'\') <> \'handbook\') AS live, count(*) AS "all" FROM cur GROUP BY collection',
    "compact": f"WITH {_CUR} SELECT id, collection, modality, content, caption, array_to_string(tags, ',') AS tags FROM cur WHERE NOT deleted",
    "compact_summary": f"WITH {_CUR} SELECT (SELECT count(*) FROM entities) AS rows_before, count(*) AS rows_after, sum({_BYTES})::BIGINT AS bytes_after FROM cur WHERE NOT deleted",
    "segment_bytes": f"SELECT collection, 0 AS segment, count(*) AS rows, sum({_BYTES})::BIGINT AS bytes, min(created_at) AS min_ts, max(created_at) AS max_ts FROM entities GROUP BY collection",
    "seal_rows": f"WITH {_LOG}, s AS (SELECT *, (row_number() OVER (PARTITION BY log_file ORDER BY seq) - 1) // 100 AS segment FROM lg) {_SEG}",
    "seal_idle": f"WITH {_LOG}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY log_file ORDER BY ts, seq) >= 3600000 THEN 1 ELSE 0 END AS g FROM lg), s AS (SELECT *, sum(g) OVER (PARTITION BY log_file ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS segment FROM g) {_SEG}",
    "seal_segments": f"""WITH RECURSIVE {_LOG}, o AS (SELECT log_file, ts, seq, bytes, row_number() OVER (PARTITION BY log_file ORDER BY ts, seq) AS i FROM lg WHERE log_file IS NOT NULL AND ts IS NOT NULL),
f AS (SELECT log_file, i, seq, ts, 0 AS segment, 1 AS n, bytes AS b FROM o WHERE i = 1
  UNION ALL SELECT o.log_file, o.i, o.seq, o.ts, f.segment + CASE WHEN f.b >= 4096 OR f.n >= 25 OR o.ts - f.ts >= 36000000 THEN 1 ELSE 0 END,
  CASE WHEN f.b >= 4096 OR f.n >= 25 OR o.ts - f.ts >= 36000000 THEN 1 ELSE f.n + 1 END, CASE WHEN f.b >= 4096 OR f.n >= 25 OR o.ts - f.ts >= 36000000 THEN o.bytes ELSE f.b + o.bytes END FROM f JOIN o ON o.log_file = f.log_file AND o.i = f.i + 1)
SELECT log_file, seq, segment::INT AS segment, CASE WHEN b >= 4096 THEN 'max_bytes' WHEN n >= 25 THEN 'max_rows' END AS reason FROM f""",
    "live_counts": f"WITH {_CUR} SELECT count(*) AS entities, count(*) FILTER (WHERE len(vector) > 0) AS vectors, 0::BIGINT AS patches, (SELECT count(*) FROM collections) AS collections FROM cur WHERE NOT deleted",
    "latency_stats": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events), l AS (SELECT event_type, list_sort(list(value)) AS v FROM r WHERE r <= 512 AND value IS NOT NULL GROUP BY event_type) SELECT event_type, v[len(v) // 2 + 1] AS p50, v[greatest(len(v) * 99 // 100 - 1, 0) + 1] AS p99 FROM l",
    "latency_quantile": "WITH l AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, v[floor((len(v) - 1) * 0.99)::INT + 1] AS p99 FROM l",
    "query_rate": "SELECT event_type, count(*) AS n, round(count(*) / (date_diff('microsecond', min(ts), max(ts)) / 1e6), 9) AS qps FROM events GROUP BY event_type",
    "cost_spent": "SELECT round(sum(value) FILTER (WHERE event_type <> 'error'), 2) AS spent FROM events",
    "budget_breaker": "WITH b AS (SELECT event_id, user_id, value, coalesce(sum(CASE WHEN event_type <> 'error' THEN value ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events) SELECT event_id, user_id, round(before, 4) AS before, round(before + value, 6) > 300 AS open FROM b",
}
