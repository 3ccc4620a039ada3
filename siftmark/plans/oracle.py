"""SQL that states the core's queries, for a second engine on the same tables. Fractions are rounded to six
places on both sides, similarities that decide an order to nine."""

from __future__ import annotations

from siftmark.functions.text import PY_SPACE
from siftmark.operators.metrics import RANK_BUCKETS, bin_edges
from siftmark.operators.sampling import caps

_SP = "||".join(f"chr({ord(c)})" for c in PY_SPACE)
_SPACES = "".join(f"\\x{{{ord(c):x}}}" for c in PY_SPACE)
KS = "(VALUES (10::BIGINT), (50), (100)) AS t(k)"
L4 = range(1, 5)


def _strip(x: str) -> str:
    return f"trim({x}, {_SP})"


def _codes_of(x: str) -> str:
    return f"regexp_extract_all({x}, '<r[0-9]+_([0-9]+)>', 1)::INT[]"


DOCS = """docs AS MATERIALIZED (SELECT doc, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS v FROM (
  SELECT doc_idx AS doc, min(embedding)::DOUBLE[] AS e FROM doc_embeddings
  WHERE doc_idx IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1))"""
CODES = "codes AS MATERIALIZED (SELECT doc_idx AS doc, min(codes) AS codes FROM rq_codes WHERE codes IS NOT NULL GROUP BY 1)"
SIM = "round(list_inner_product({a}, {b}), 9)"


def _top(source: str, k: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, doc) AS rank FROM ({source})) WHERE rank <= {k}"


SELF = f"SELECT a.doc AS query, b.doc AS doc, {SIM.format(a='a.v', b='b.v')} AS sim FROM docs a JOIN docs b ON a.doc <> b.doc"
QUERIES = f"""known AS (SELECT doc_id, min(doc_idx) AS gold FROM pseudo_queries WHERE doc_id IS NOT NULL GROUP BY 1),
numbered AS (SELECT doc, v, row_number() OVER (ORDER BY doc) - 1 AS n FROM docs),
mixed AS (SELECT t.query_idx AS query, k.gold, {_codes_of("coalesce(t.gt_rqid, t.output)")} AS codes,
    list_transform(list_zip(a.v, b.v), lambda z: ((t.query_idx % 5) / 4.0)::DOUBLE * z[1] + z[2]) AS m
  FROM test_samples t JOIN known k ON t.gt_semid = k.doc_id JOIN numbered a ON a.doc = k.gold
  JOIN numbered b ON b.n = (7 * a.n + 1) % (SELECT count(*) FROM docs)),
queries AS MATERIALIZED (SELECT query, gold, codes, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS v FROM mixed)"""
ASKED = f"SELECT q.query, d.doc, {SIM.format(a='q.v', b='d.v')} AS sim FROM queries q CROSS JOIN docs d"
ASKED_X = ASKED + " WHERE d.doc <> q.gold"
SHARED = "CASE WHEN a[1] IS DISTINCT FROM b[1] THEN 0 WHEN a[2] IS DISTINCT FROM b[2] THEN 1 WHEN a[3] IS DISTINCT FROM b[3] THEN 2 WHEN a[4] IS DISTINCT FROM b[4] THEN 3 ELSE 4 END"
DOC_NEAR = f"""WITH {DOCS}, {CODES}, top AS MATERIALIZED ({_top(SELF, 100)}),
near AS MATERIALIZED (SELECT query, doc, sim, rank, {SHARED} AS shared, b[1] AS c0 FROM (
  SELECT t.*, x.codes AS a, y.codes AS b FROM top t JOIN codes x ON x.doc = t.query JOIN codes y ON y.doc = t.doc))"""
ALL_PAIRS = f"""WITH {DOCS}, {CODES}, near AS MATERIALIZED (SELECT sim, {SHARED} AS shared FROM (
  SELECT t.sim, x.codes AS a, y.codes AS b FROM ({SELF}) t JOIN codes x ON x.doc = t.query JOIN codes y ON y.doc = t.doc))"""
QUERY_NEAR = f"""WITH {DOCS}, {CODES}, {QUERIES}, top AS MATERIALIZED ({_top(ASKED, 100)}),
near AS MATERIALIZED (SELECT query, doc, sim, rank, {SHARED} AS shared, b[1] AS c0 FROM (
  SELECT t.*, q.codes AS a, y.codes AS b FROM top t JOIN queries q ON q.query = t.query JOIN codes y ON y.doc = t.doc WHERE len(q.codes) > 0))"""
_RECALL = "SELECT k, " + ", ".join(f"round(avg((shared >= {n})::INT), 6) AS l{n}" for n in L4) + f" FROM near JOIN {KS} ON rank <= k GROUP BY k"
_HIT = "SELECT k, " + ", ".join(f"round(avg((shared >= {n})::INT), 6) AS l{n}" for n in L4) + f" FROM (SELECT k, query, max(shared) AS shared FROM near JOIN {KS} ON rank <= k GROUP BY 1, 2) GROUP BY k"
_UNIQUE = f"SELECT k, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.25), 6) AS q25, round(quantile_cont(n, 0.75), 6) AS q75 FROM (SELECT k, query, count(DISTINCT c0) AS n FROM near JOIN {KS} ON rank <= k GROUP BY 1, 2) GROUP BY k"
_EDGES = bin_edges()
_EDGE_ROWS = ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:])))
_BINS = f"""SELECT round(lo, 6) AS bin_left, round(hi, 6) AS bin_right, round((lo + hi) / 2, 6) AS bin_mid, count(sim) AS n_pairs, round(avg(sim), 6) AS mean_similarity, {", ".join(f"round(avg((shared >= {n})::INT), 6) AS l{n}" for n in L4)}
FROM (VALUES {_EDGE_ROWS}) AS e(i, lo, hi) LEFT JOIN near ON sim >= lo AND (sim < hi OR (i = {len(_EDGES) - 2} AND sim <= hi)) GROUP BY lo, hi"""
RANKS = f"""WITH {DOCS}, {QUERIES}, sims AS MATERIALIZED (SELECT q.query, q.gold, d.doc, {SIM.format(a='q.v', b='d.v')} AS sim FROM queries q CROSS JOIN docs d),
gold AS (SELECT query, sim AS gold_sim FROM sims WHERE doc = gold),
first AS (SELECT query, doc AS top1_doc, sim AS top1_sim FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, doc) AS r FROM sims) WHERE r = 1),
other AS (SELECT query, avg(sim) AS top_mean FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, doc) AS r FROM sims WHERE doc <> gold) WHERE r <= 10 GROUP BY 1),
ranks AS MATERIALIZED (SELECT s.query, any_value(s.gold) AS gold, (1 + count_if(s.sim > g.gold_sim))::BIGINT AS gold_rank, any_value(g.gold_sim) AS gold_sim, any_value(f.top1_doc) AS top1_doc, any_value(f.top1_sim) AS top1_sim, any_value(o.top_mean) AS top_mean
  FROM sims s JOIN gold g USING (query) JOIN first f USING (query) LEFT JOIN other o USING (query) GROUP BY 1)"""
_PAIRS = f"""flat AS (SELECT split, split_ord, line_no, query, passages.passage_text AS ts, passages.is_selected AS fs, passages.url AS us, unnest(range(len(passages.passage_text))) AS pos FROM raw_qa WHERE {_strip("query")} <> ''),
pairs AS MATERIALIZED (SELECT split, split_ord, line_no, pos, {_strip("query")} AS query, ts[pos + 1] AS text, us[pos + 1] AS url,
  'doc_' || substr(sha1(coalesce(us[pos + 1], '') || chr(10) || {_strip("ts[pos + 1]")}), 1, 16) AS doc_id FROM flat WHERE fs[pos + 1] = 1 AND {_strip("ts[pos + 1]")} <> ''),
first_docs AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY split_ord, line_no, pos, text) AS r FROM pairs) WHERE r = 1)"""
_SEMI = CODES + """, own AS (SELECT doc_id, array_to_string(list_transform(list_zip(range(len(codes)), codes), lambda z: '<r' || z[1] || '_' || z[2] || '>'), ' ') AS rqid
  FROM (SELECT doc_id, row_number() OVER (ORDER BY split_ord, line_no, pos, doc_id) - 1 AS doc FROM first_docs) JOIN codes USING (doc)),
rqids AS (SELECT doc_id, rqid FROM own UNION ALL SELECT doc_id, rqid FROM semid_to_rqid WHERE doc_id NOT IN (SELECT doc_id FROM own))"""
_PSEUDO = f"SELECT 'query: ' || {_strip('q')} AS input, rqid AS output FROM (SELECT doc_id, unnest(pseudo_queries) AS q FROM pseudo_queries) JOIN semid_to_rqid USING (doc_id) WHERE {_strip('q')} <> ''"
_OPS = "WITH ops AS (SELECT 'train' AS split, 0 AS split_ord, doc_id AS line_no, 'indexing' AS operation, doc_id::VARCHAR AS doc_id, text FROM documents UNION ALL SELECT split, CASE WHEN split = 'valid' THEN 1 ELSE 2 END, query_idx, 'query', gt_semid, input FROM test_samples)"


def _assign() -> str:
    out = f"WITH {DOCS}, r0 AS (SELECT doc, v AS rest FROM docs)"
    for i in range(4):
        out += f""",
near{i} AS MATERIALIZED (SELECT r.doc, arg_min(b.code, (round(list_distance(r.rest, b.centroid), 12), b.code)) AS code FROM r{i} r CROSS JOIN rq_codebooks b WHERE b.level = {i} GROUP BY r.doc),
r{i + 1} AS MATERIALIZED (SELECT r.doc, list_transform(list_zip(r.rest, b.centroid), lambda z: z[1] - z[2]) AS rest FROM r{i} r JOIN near{i} USING (doc) JOIN rq_codebooks b ON b.level = {i} AND b.code = near{i}.code)"""
    return out


_TEST = f"""tq AS MATERIALIZED (SELECT query_idx, CASE WHEN lower(input[1:6]) = 'query:' THEN {_strip('input[7:]')} ELSE {_strip('input')} END AS text, coalesce(gt_semid, '') AS gt_semid, coalesce(nullif(gt_rqid, ''), output) AS gt_rqid,
  {_codes_of("coalesce(nullif(gt_rqid, ''), output)")} AS codes FROM test_samples WHERE coalesce(nullif(gt_rqid, ''), output) IS NOT NULL)"""
_TRIE = f"""paths AS (SELECT DISTINCT {_codes_of('rqid')} AS codes FROM semid_to_rqid WHERE rqid IS NOT NULL),
trie AS MATERIALIZED (SELECT DISTINCT codes[1:n] AS prefix, codes[n + 1] AS next FROM (SELECT codes, unnest(range(len(codes))) AS n FROM paths))"""


def _beam() -> str:
    out = f"WITH {_TEST}, {_TRIE}, b0 AS (SELECT query_idx AS query, []::INT[] AS path, 0::DOUBLE AS total FROM tq)"
    for i in range(4):
        out += f""",
b{i + 1} AS MATERIALIZED (SELECT query, path, total FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY total DESC, path) AS r FROM (
  SELECT b.query, list_append(b.path, t.next) AS path, round(b.total + round(1.0::DOUBLE / (1 + abs(t.next - q.codes[{i + 1}])), 9), 9) AS total
  FROM b{i} b JOIN trie t ON t.prefix = b.path JOIN tq q ON q.query_idx = b.query)) WHERE r <= 10)"""
    return out + """,
beams AS MATERIALIZED (SELECT query, row_number() OVER (PARTITION BY query ORDER BY total DESC, path) AS rank, '<r0_' || path[1] || '> <r1_' || path[2] || '> <r2_' || path[3] || '> <r3_' || path[4] || '>' AS rqid, round(total, 6) AS total FROM b4)"""


def _dealt(step: int) -> str:
    return f"(SELECT a.doc, b.codes FROM cn a JOIN cn b ON b.n = (a.n * {step} + 1) % (SELECT count(*) FROM cn))"


_STEPS = (1_000_003, 998_244_353)
_BASE = f"""WITH {DOCS}, {CODES}, top AS MATERIALIZED ({_top(SELF, 100)}), cn AS MATERIALIZED (SELECT doc, codes, row_number() OVER (ORDER BY doc) - 1 AS n FROM codes),
rand AS (""" + " UNION ALL ".join(
    f"""SELECT 'random_code_{i + 1}' AS method, k, {", ".join(f"avg((shared >= {n})::INT) AS l{n}" for n in L4)} FROM (SELECT rank, {SHARED} AS shared FROM (
  SELECT t.rank, x.codes AS a, y.codes AS b FROM top t JOIN {_dealt(step)} x ON x.doc = t.query JOIN {_dealt(step)} y ON y.doc = t.doc)) JOIN {KS} ON rank <= k GROUP BY k"""
    for i, step in enumerate(_STEPS)
) + ") SELECT method, k, " + ", ".join(f"round(l{n}, 6) AS l{n}" for n in L4) + " FROM rand UNION ALL SELECT 'random_code_mean', k, " + ", ".join(f"round(avg(l{n}), 6)" for n in L4) + " FROM rand GROUP BY k"


def _summary(src: str) -> str:
    q = {"p10": 0.1, "q25": 0.25, "q75": 0.75, "p90": 0.9, "p95": 0.95}
    return f"SELECT metric, count(v) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(coalesce(stddev_samp(v), 0), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, " + ", ".join(f"round(quantile_cont(v, {x}), 6) AS {n}" for n, x in q.items()) + f" FROM ({src}) GROUP BY metric"


_HIST = ", ".join(f"('{n}', {lo}, {hi if hi else 'NULL'})" for n, lo, hi in RANK_BUCKETS)
_CAPS = ", ".join(f"({c}::BIGINT)" for c in caps(5, 50_000))

ORACLE: dict[str, str] = {
    "knn_top10": f"WITH {DOCS} SELECT query, doc, round(sim, 6) AS sim, rank FROM ({_top(SELF, 10)})",
    "knn_pairs": f"WITH {DOCS} SELECT query AS i, doc AS j, round(sim, 6) AS sim FROM ({_top(SELF, 100)})",
    "qa_unnest": f"WITH {_PAIRS} SELECT split, line_no, pos, query, url, doc_id FROM pairs",
    "doc_key_dedup": f"WITH {_PAIRS} SELECT doc_id, text, split, line_no, pos FROM first_docs",
    "doc_index": f"WITH {_PAIRS} SELECT row_number() OVER (ORDER BY split_ord, line_no, pos, doc_id) - 1 AS doc_idx, doc_id FROM first_docs",
    "split_counts": f"WITH {_PAIRS} SELECT coalesce(q.split, f.split) AS split, coalesce(n_queries, 0) AS n_queries, coalesce(n_docs, 0) AS n_docs FROM (SELECT split, count(*) AS n_queries FROM pairs GROUP BY 1) q FULL JOIN (SELECT split, count(*) AS n_docs FROM first_docs GROUP BY 1) f ON q.split = f.split",
    "operation_extract": _OPS + " SELECT 'doc' AS kind, split, line_no, doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY split_ord, line_no, text) AS r FROM ops WHERE operation = 'indexing' AND doc_id IS NOT NULL AND text IS NOT NULL) WHERE r = 1 UNION ALL SELECT 'query', split, line_no, doc_id, text FROM ops WHERE operation = 'query' AND doc_id IS NOT NULL AND text IS NOT NULL",
    "rq_assign": _assign() + " SELECT a.doc, a.code::BIGINT AS c0, b.code::BIGINT AS c1, c.code::BIGINT AS c2, d.code::BIGINT AS c3 FROM near0 a JOIN near1 b USING (doc) JOIN near2 c USING (doc) JOIN near3 d USING (doc)",
    "rq_residual_norm": _assign() + " " + " UNION ALL ".join(f"SELECT {i}::BIGINT AS level, round(avg(sqrt(list_inner_product(rest, rest))), 6) AS mean_norm FROM r{i + 1}" for i in range(4)),
    "rq_docid_strings": f"WITH {CODES} SELECT doc, array_to_string(list_transform(list_zip(range(len(codes)), codes), lambda z: '<r' || z[1] || '_' || z[2] || '>'), ' ') AS rqid FROM codes",
    "rq_uniqueness": "SELECT count(*) AS n_docs, count(DISTINCT rqid) AS n_rqids, round(count(DISTINCT rqid) / count(*), 6) AS ratio FROM semid_to_rqid WHERE rqid IS NOT NULL",
    "rqid_parse": "SELECT sample_id, array_to_string(regexp_extract_all(output, '<r[0-9]+_([0-9]+)>', 1), ',') AS codes FROM train_samples WHERE output IS NOT NULL",
    "doc_prefix_recall": f"{DOC_NEAR} {_RECALL}",
    "doc_prefix_hit": f"{DOC_NEAR} {_HIT}",
    "doc_unique_l1": f"{DOC_NEAR} {_UNIQUE}",
    "doc_prefix_random_baseline": _BASE,
    "query_topk": f"WITH {DOCS}, {QUERIES} SELECT query, doc, round(sim, 6) AS sim, rank FROM ({_top(ASKED, 10)})",
    "query_topk_excl_gold": f"WITH {DOCS}, {QUERIES} SELECT query, doc, round(sim, 6) AS sim, rank FROM ({_top(ASKED_X, 10)})",
    "query_prefix_recall": f"{QUERY_NEAR} {_RECALL}",
    "query_prefix_hit": f"{QUERY_NEAR} {_HIT}",
    "query_unique_l1": f"{QUERY_NEAR} {_UNIQUE}",
    "gold_rank_per_query": f"{RANKS} SELECT query, gold, gold_rank, round(gold_sim, 6) AS gold_sim, top1_doc, round(top1_sim, 6) AS top1_sim, round(top_mean, 6) AS top_mean, (top1_doc = gold)::BIGINT AS top1_is_gold, round(top1_sim - gold_sim, 6) AS gap FROM ranks",
    "gold_recall_at_k": f"{RANKS} SELECT k, round(avg((gold_rank <= k)::INT), 6) AS gold_recall_at_k FROM ranks CROSS JOIN (VALUES (1::BIGINT), (5), (10), (20), (50), (100), (200), (500), (1000)) AS t(k) GROUP BY k",
    "gold_rank_histogram": f"{RANKS} SELECT bucket, count(gold_rank) AS count, round(count(gold_rank) / (SELECT count(*) FROM ranks), 6) AS fraction FROM (VALUES {_HIST}) AS b(bucket, lo, hi) LEFT JOIN ranks ON gold_rank >= lo AND (hi IS NULL OR gold_rank <= hi) GROUP BY bucket",
    "gold_summary": f"{RANKS} " + _summary("SELECT 'gold_rank' AS metric, gold_rank::DOUBLE AS v FROM ranks UNION ALL SELECT 'gold_sim', gold_sim FROM ranks UNION ALL SELECT 'top1_sim', top1_sim FROM ranks"),
    "gold_gap_summary": f"{RANKS} SELECT round(avg(g), 6) AS mean, round(quantile_cont(g, 0.5), 6) AS median, round(avg((g < 0.01)::INT), 6) AS below_001, round(avg((g < 0.05)::INT), 6) AS below_005 FROM (SELECT top1_sim - gold_sim AS g FROM ranks)",
    "consistency_bins_doc": f"{DOC_NEAR} {_BINS}",
    "consistency_bins_query": f"{QUERY_NEAR} {_BINS}",
    "consistency_outside": f"{DOC_NEAR} SELECT count(*) AS n_pairs, count_if(sim < 0.3::DOUBLE)::BIGINT AS outside_low, count_if(sim > 0.9::DOUBLE)::BIGINT AS outside_high FROM near",
    "prefix_groups": f"WITH {CODES} SELECT level, count(*) AS n_groups_total, count_if(s >= 2)::BIGINT AS n_groups_valid, sum(s * (s - 1) // 2)::BIGINT AS n_pairs FROM (SELECT level, codes[1:level] AS p, count(*) AS s FROM codes CROSS JOIN range(1, 5) AS r(level) GROUP BY 1, 2) GROUP BY level",
    "shared_prefix_ratio": f"{DOC_NEAR} SELECT count(*) AS n_pairs, " + ", ".join(f"round(avg((shared >= {n})::INT), 6) AS l{n}" for n in L4) + " FROM near",
    "group_cap": f"WITH {CODES}, g AS (SELECT s * (s - 1) // 2 AS n FROM (SELECT count(*) AS s FROM codes GROUP BY codes[1:1])), t AS (SELECT cap, sum(least(n, cap))::BIGINT AS total FROM g CROSS JOIN (VALUES {_CAPS}) AS c(cap) GROUP BY cap) SELECT cap, total FROM t WHERE cap = coalesce((SELECT min(cap) FROM t WHERE total >= 20000), (SELECT max(cap) FROM t))",
    "pair_cosine_summary": f"{ALL_PAIRS} SELECT shared::BIGINT AS shared, n AS n_pairs, round(m, 6) AS mean, round(med, 6) AS median, round(s, 6) AS std, round(q1, 6) AS q25, round(q3, 6) AS q75, round(m - 1.96 * s / sqrt(n), 6) AS ci95_low, round(m + 1.96 * s / sqrt(n), 6) AS ci95_high FROM (SELECT shared, count(*) AS n, avg(sim) AS m, quantile_cont(sim, 0.5) AS med, coalesce(stddev_samp(sim), 0) AS s, quantile_cont(sim, 0.25) AS q1, quantile_cont(sim, 0.75) AS q3 FROM near GROUP BY 1)",
    "mann_whitney": f"""{DOC_NEAR}, v AS (SELECT shared > 0 AS x, sim FROM near), r AS (SELECT x, sim, rank() OVER (ORDER BY sim) + (count(*) OVER (PARTITION BY sim) - 1) / 2.0::DOUBLE AS r FROM v),
s AS (SELECT count_if(x)::DOUBLE AS nx, count_if(NOT x)::DOUBLE AS ny, sum(CASE WHEN x THEN r ELSE 0 END) AS rx, avg(CASE WHEN x THEN sim END) AS mx, avg(CASE WHEN NOT x THEN sim END) AS my, var_samp(CASE WHEN x THEN sim END) AS vx, var_samp(CASE WHEN NOT x THEN sim END) AS vy FROM r),
t AS (SELECT sum(c::DOUBLE * c * c - c) AS ties FROM (SELECT count(*) AS c FROM v GROUP BY sim)), u AS (SELECT *, rx - nx * (nx + 1) / 2 AS u1, nx * ny / 12 * (nx + ny + 1 - ties / ((nx + ny) * (nx + ny - 1))) AS va FROM s, t)
SELECT nx::BIGINT AS n_x, ny::BIGINT AS n_y, round(u1, 6) AS u1, round(nx * ny - u1, 6) AS u2, round(least(u1, nx * ny - u1), 6) AS u_min, round((abs(u1 - nx * ny / 2) - 0.5) / sqrt(va), 6) AS z_approx, round(2 * u1 / (nx * ny) - 1, 6) AS cliffs_delta, round((mx - my) / sqrt(((nx - 1) * vx + (ny - 1) * vy) / (nx + ny - 2)), 6) AS cohens_d, round(mx - my, 6) AS mean_diff FROM u""",
    "similarity_cdf": f"{RANKS} SELECT round(top1_sim, 6) AS value, round(row_number() OVER (ORDER BY top1_sim) / (SELECT count(*) FROM ranks), 6) AS cdf FROM ranks",
    "train_samples": f"WITH {_PAIRS}, {_SEMI} SELECT 'query: ' || query AS input, rqid AS output FROM pairs JOIN rqids USING (doc_id) WHERE split IN ('train', 'valid') UNION ALL SELECT 'document: ' || text, rqid FROM first_docs JOIN rqids USING (doc_id) UNION ALL {_PSEUDO}",
    "test_samples": f"WITH {_PAIRS}, {_SEMI} SELECT 'query: ' || query AS input, rqid AS output, doc_id AS gt_semid, rqid AS gt_rqid FROM pairs JOIN rqids USING (doc_id) WHERE split = 'test'",
    "pseudo_query_samples": _PSEUDO,
    "skipped_pairs": f"WITH {_PAIRS}, {_SEMI} SELECT count(*) AS n_skipped FROM pairs WHERE doc_id NOT IN (SELECT doc_id FROM rqids)",
    "test_query_scan": f"WITH {_TEST} SELECT query_idx, text, gt_semid, gt_rqid, array_to_string(codes, ',') AS codes FROM tq",
    "gold_lookup": "SELECT query_idx, doc_idx AS gold FROM test_samples JOIN pseudo_queries ON gt_semid = doc_id",
    "gold_code_check": "SELECT count(*) AS n_rows, count_if(gt_rqid <> rqid)::BIGINT AS n_mismatches FROM test_samples JOIN semid_to_rqid ON gt_semid = doc_id",
    "trie_edges": f"WITH {_TRIE} SELECT array_to_string(prefix, ',') AS prefix, next::BIGINT AS next FROM trie",
    "trie_allowed": f"WITH {CODES}, {_TRIE}, asked AS (SELECT DISTINCT codes[1:n] AS prefix FROM (SELECT codes, unnest(range(len(codes) + 1)) AS n FROM codes)) SELECT array_to_string(a.prefix, ',') AS prefix, t.next::BIGINT AS next FROM asked a LEFT JOIN trie t ON a.prefix = t.prefix",
    "beam_search": _beam() + " SELECT query, rank, rqid, total FROM beams",
    "hits_at_k": _beam() + f", gold AS (SELECT query_idx AS query, '<r0_' || codes[1] || '> <r1_' || codes[2] || '> <r2_' || codes[3] || '> <r3_' || codes[4] || '>' AS gold FROM tq), pos AS (SELECT g.query, min(b.rank) AS rank FROM gold g LEFT JOIN beams b ON b.query = g.query AND b.rqid = g.gold GROUP BY 1) SELECT k, round(avg(coalesce(rank <= k, false)::INT), 4) AS hits FROM pos CROSS JOIN (VALUES (1::BIGINT), (5), (10)) AS t(k) GROUP BY k",
    "files_scan": f"WITH {_PAIRS} SELECT split, query, doc_id FROM pairs",
    "files_documents": f"WITH {_PAIRS} SELECT doc_id, split FROM first_docs",
    "files_formats": "SELECT * FROM (VALUES ('test', 'qa'), ('train', 'qa'), ('valid', 'operation')) t(split, format)",
    "codes_from_ids": "SELECT doc_id, array_to_string(regexp_extract_all(rqid, '<r[0-9]+_([0-9]+)>', 1), ',') AS codes FROM semid_to_rqid WHERE rqid IS NOT NULL",
    "generate_pseudo_queries": f"WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[{_SPACES}]+'), lambda x: x <> '') AS w FROM documents), q AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE list_transform(range(5), lambda i: array_to_string(w[len(w) * i // 5 + 1:len(w) * i // 5 + 6], ' ')) END AS q FROM w) SELECT doc_id, len(q) AS n, array_to_string(q, '|') AS queries FROM q",
    "encode_documents": "SELECT doc_id, 64 AS dim FROM documents",
    "stream_ingest": f"WITH {_PAIRS} SELECT doc_id FROM first_docs",
}
