"""For each query that SQL can state, the same in DuckDB's SQL."""

from .percentile import _CENTRAL, _MIDDLE, _TAIL

# The current row of each id; live records.
_LIVE = """
cur AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST) AS rn FROM entities WHERE id IS NOT NULL),
live AS (SELECT * FROM cur WHERE rn = 1 AND NOT coalesce(deleted, false))"""

_P1 = f"""WITH {_LIVE},
tx AS (SELECT id, list_transform(terms, lambda t: t.term) AS ts FROM live WHERE modality = 'text'),
p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ts) AS term FROM tx) WHERE term IS NOT NULL GROUP BY ALL),
dls AS (SELECT id, sum(tf) AS dl FROM p GROUP BY id),
st AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM p GROUP BY term),
g AS (SELECT (SELECT count(*) FROM tx)::DOUBLE AS n, (SELECT sum(tf) FROM p)::DOUBLE / (SELECT count(*) FROM tx) AS avgdl),
s AS (SELECT p.id, p.term, p.tf, dls.dl, st.df, st.cf,
  p.tf * log2(1 + g.avgdl / dls.dl) AS tfn, st.cf / g.n AS lam
  FROM p JOIN dls USING (id) JOIN st USING (term), g),
z AS (SELECT *, (log2(1 + lam) + tfn * log2((1 + lam) / lam)) / (tfn + 1) AS sc FROM s)"""

_P7 = f"""WITH {_LIVE},
v AS (SELECT id, 'term' AS kind, unnest(list_transform(terms, lambda t: t.term)) AS value FROM live
  UNION ALL SELECT id, 'tag', unnest(list_transform(tags, lambda t: lower(trim(t)))) FROM live),
c AS (SELECT kind, value, count(*) AS occurrences, count(DISTINCT id) AS records FROM v
  WHERE value IS NOT NULL AND (kind = 'term' OR value <> '') GROUP BY ALL),
m AS (SELECT *, CASE WHEN records <= 1 THEN 'rare' WHEN records > 0.25 * (SELECT count(*) FROM live) THEN 'common' END AS mark FROM c)"""

_P5 = """WITH f AS (SELECT qid, id,
    max(CASE WHEN vec_rank > 0 THEN vec_score END) AS vec, max(CASE WHEN key_rank > 0 THEN key_score END) AS key, max(rrf) AS rrf
  FROM fused GROUP BY ALL),
r AS (SELECT qid, id,
  rank() OVER (PARTITION BY qid ORDER BY vec ASC NULLS LAST) AS a,
  rank() OVER (PARTITION BY qid ORDER BY key DESC NULLS LAST) AS b,
  rank() OVER (PARTITION BY qid ORDER BY rrf DESC NULLS LAST) AS c FROM f)"""



def _horner(coefficients: tuple, x: str) -> str:
    out = repr(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = f"({out} * {x} + {c!r})"
    return out


def _inverse_normal(p: str) -> str:
    """SQL of the normal quantile, by the same coefficients."""
    ratio = lambda pair, x: f"({_horner(pair[0], x)} / {_horner(pair[1], x)})"
    return f"""CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {ratio(_CENTRAL, f'(0.180625 - ({p} - 0.5) * ({p} - 0.5))')}
  ELSE (CASE WHEN {p} < 0.5 THEN -1 ELSE 1 END) * CASE WHEN sqrt(-ln(least({p}, 1 - {p}))) <= 5
    THEN {ratio(_MIDDLE, f'(sqrt(-ln(least({p}, 1 - {p}))) - 1.6)')} ELSE {ratio(_TAIL, f'(sqrt(-ln(least({p}, 1 - {p}))) - 5.0)')} END END"""


_P5_RANKED = f"""{_P5},
n AS (SELECT qid, id, count(*) OVER (PARTITION BY qid)::DOUBLE AS n, a, b, c,
  count(*) OVER (PARTITION BY qid, vec) AS ta, count(*) OVER (PARTITION BY qid, key) AS tb, count(*) OVER (PARTITION BY qid, rrf) AS tc FROM f JOIN r USING (qid, id)),
p AS (SELECT qid, id, (n - (a - 1) - (ta - 1) / 2.0 - 0.5) / n AS pa, (n - (b - 1) - (tb - 1) / 2.0 - 0.5) / n AS pb, (n - (c - 1) - (tc - 1) / 2.0 - 0.5) / n AS pc FROM n),
s AS (SELECT qid, id, round((({_inverse_normal('pa')}) + ({_inverse_normal('pb')}) + ({_inverse_normal('pc')})) / 3.0, 9) AS score FROM p)
SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS position, score FROM s"""

# Vectors that count, as unit vectors of doubles.
_VEC = f"""WITH {_LIVE},
v AS (SELECT id, modality, list_transform(vector, lambda x: x::DOUBLE) AS v FROM live WHERE vector IS NOT NULL AND len(vector) = 64
  AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0)"""

_GRAMS = " UNION ALL ".join(
    f"SELECT id, {n} AS n, unnest(list_transform(range(1, len(ts) - {n - 2}), lambda i: array_to_string(ts[i:i + {n - 1}], ' '))) AS gram FROM tx WHERE len(ts) >= {n}" for n in (1, 2, 3)
)

SQL: dict[str, str] = {
    "p1_top": f"{_P1}, t AS (SELECT id, term, sc, row_number() OVER (PARTITION BY id ORDER BY sc DESC, term) AS rank FROM (SELECT id, term, round(sc, 10) AS sc FROM z)) SELECT id, rank::INT AS rank, term, round(sc, 5) AS score FROM t WHERE rank <= 10",
    # Every record with 15 similar ones names a seed; whoever averages 0.58 with what is similar to the seed is a group to check.
    "p2_found": f"""{_VEC},
u AS (SELECT id, modality, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM v),
p AS MATERIALIZED (SELECT a.id AS a, b.id AS b, list_dot_product(a.u, b.u) AS c FROM u a JOIN u b ON a.modality IS NOT DISTINCT FROM b.modality),
n AS MATERIALIZED (SELECT a, b FROM p WHERE c >= 0.55),
seeds AS (SELECT DISTINCT lo AS seed FROM (SELECT a, min(b) AS lo FROM n GROUP BY a HAVING count(*) >= 8)),
m AS (SELECT seed, p.a AS id, avg(c) AS mean FROM seeds JOIN n ON n.a = seed JOIN p ON p.b = n.b GROUP BY ALL),
g AS MATERIALIZED (SELECT seed, id, count(*) OVER (PARTITION BY seed) AS size FROM m WHERE mean >= 0.58),
w AS (SELECT g.seed, p.a AS id, sum(c) AS s, any_value(g.size) AS size FROM g JOIN p ON p.b = g.id GROUP BY ALL),
ok AS (SELECT w.seed FROM w LEFT JOIN g ON g.seed = w.seed AND g.id = w.id GROUP BY w.seed
  HAVING any_value(w.size) >= 15 AND min(CASE WHEN g.id IS NOT NULL THEN (s - 1) / (w.size - 1) END) >= 0.65 AND coalesce(max(CASE WHEN g.id IS NULL THEN s / w.size END), 0) < 0.5)
SELECT DISTINCT id, min(id) OVER (PARTITION BY seed) AS group_id FROM g WHERE seed IN (SELECT seed FROM ok)""",
    "p4_found": f"""WITH {_LIVE},
x AS (SELECT id, doc_id, regexp_replace(lower(content), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS s FROM live WHERE modality = 'text' AND content IS NOT NULL),
g AS (SELECT DISTINCT id, unnest(list_transform(range(1, length(s) - 6), lambda i: s[i:i + 7])) AS gram FROM x WHERE length(s) >= 8),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
o AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id GROUP BY ALL)
SELECT a AS id_a, b AS id_b FROM o JOIN n p ON p.id = a JOIN n q ON q.id = b JOIN x y ON y.id = a JOIN x z ON z.id = b
WHERE common >= 0.6 * (p.n + q.n - common) AND (y.doc_id IS NULL OR z.doc_id IS NULL OR y.doc_id <> z.doc_id)""",
    "p4_groups": f"""WITH RECURSIVE {_LIVE},
x AS (SELECT id, regexp_replace(lower(content), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS s FROM live WHERE modality = 'text' AND content IS NOT NULL),
m AS (SELECT id, s, min(id) OVER (PARTITION BY s) AS rep FROM x WHERE length(s) >= 8),
g AS (SELECT DISTINCT rep AS id, unnest(list_transform(range(1, length(s) - 6), lambda i: s[i:i + 7])) AS gram FROM (SELECT DISTINCT rep, s FROM m)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
o AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE common >= 0.6 * (p.n + q.n - common)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, lo) AS (SELECT DISTINCT rep, rep FROM m UNION SELECT l.b, r.lo FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(lo) AS lo FROM r GROUP BY node), d AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT m.id, m.rep AS class_id, c.lo AS group_id, coalesce(d.links, 0) AS links FROM m JOIN c ON c.node = m.rep LEFT JOIN d ON d.a = m.rep""",
    "p5_ranked": _P5_RANKED,
    "p6_found": f"""{_VEC},
s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS c FROM v a JOIN v b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c, 12) DESC, b) AS rank FROM s WHERE c >= 0.95)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE rank <= 5 AND c >= 0.955""",
    "p6_recall": f"{_VEC} SELECT count(*) AS asked, true AS reached FROM v WHERE id % 20 = 0",
    "p7_ngrams": f"""WITH {_LIVE}, tx AS (SELECT id, list_filter(list_transform(terms, lambda t: t.term), lambda t: t IS NOT NULL) AS ts FROM live WHERE terms IS NOT NULL),
g AS ({_GRAMS}) SELECT gram, n::INT AS n, count(*) AS occurrences, count(DISTINCT id) AS records FROM g GROUP BY gram, n""",
    "p1_found": f"{_P1} SELECT id, term FROM z WHERE tf >= 3 AND df BETWEEN 2 AND 12",
    "p1_scores": f"{_P1} SELECT id, term, tf::INT AS tf, dl::INT AS dl, df::BIGINT AS df, cf::BIGINT AS cf, round(sc, 6) AS score FROM z",
    "p5_found": f"{_P5} SELECT qid, id FROM r WHERE a <= 3 AND b <= 3 AND c <= 3",
    "p7_found": f"{_P7} SELECT kind, value, mark FROM m WHERE mark IS NOT NULL",
    "p7_frequencies": f"{_P7} SELECT kind, value, occurrences, records, mark FROM m",
    "p8_offsets": "SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS bytes FROM documents",
    "p8_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
