"""The pN_ queries and, where SQL can state them at this size, their SQL."""

from __future__ import annotations

from siftmark.llm import clusters, copies, leaks, near, overlaps, similar, subjects, tokenise
from siftmark.runtime import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str):
    def add(f):
        QUERIES[name] = f
        return f

    return add


@query("p2_found")
def p2_found(spark, d):
    from pyspark.sql import functions as F

    a = copies.input_copies(table(spark, d, "train_samples")).select(F.lit("train_samples").alias("tab"), "keep_id", "copy_id")
    b = copies.list_copies(table(spark, d, "pseudo_queries")).select(F.lit("pseudo_queries").alias("tab"), "keep_id", "copy_id")
    return a.unionByName(b)


@query("p3_found")
def p3_found(spark, d):
    return overlaps.overlaps(table(spark, d, "test_samples"), table(spark, d, "train_samples"))


@query("p6_ids")
def p6_ids(spark, d):
    return tokenise.encode(table(spark, d, "documents"), "doc_id", "text")


@query("p7_found")
def p7_found(spark, d):
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_passages"))


@query("p4_found")
def p4_found(spark, d):
    return near.near_pairs(near.passages(table(spark, d, "raw_qa")))


@query("p5_found")
def p5_found(spark, d):
    return similar.similar_pairs(table(spark, d, "doc_embeddings"), "doc_idx", "embedding")


@query("p1_found")
def p1_found(spark, d):
    return clusters.clusters(table(spark, d, "doc_embeddings"), "doc_idx", "embedding")


@query("p1_clusters")
def p1_clusters(spark, d):
    """(cluster_idx, size, typical, codes): the lists as text, with commas."""
    from pyspark.sql import functions as F

    rows = table(spark, d, "doc_embeddings")
    found = clusters.described(rows, "doc_idx", "embedding", table(spark, d, "rq_codes"), p1_found(spark, d))
    return found.select("cluster_idx", "size", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("typical", "codes")))


@query("p8_found")
def p8_found(spark, d):
    return subjects.subjects_of(table(spark, d, "documents"), table(spark, d, "subject_examples"))


@query("p2_kept")
def p2_kept(spark, d):
    rows = table(spark, d, "train_samples")
    return copies.kept(rows, "sample_id", copies.input_copies(rows))


@query("p2_kept_both")
def p2_kept_both(spark, d):
    """p2_kept over both tables."""
    from pyspark.sql import functions as F

    out = []
    for name, key, found in (("train_samples", "sample_id", copies.input_copies), ("pseudo_queries", "doc_idx", copies.list_copies)):
        rows = table(spark, d, name)
        out.append(copies.kept(rows, key, found(rows)).select(F.lit(name).alias("tab"), "keep_id", "n_copies"))
    return out[0].unionByName(out[1])


@query("p3_counts")
def p3_counts(spark, d):
    rows = table(spark, d, "test_samples")
    return overlaps.overlap_counts(rows, overlaps.overlaps(rows, table(spark, d, "train_samples")))


@query("p4_groups")
def p4_groups(spark, d):
    return near.near_groups(near.passages(table(spark, d, "raw_qa")))


@query("p6_decoded")
def p6_decoded(spark, d):
    return tokenise.decode(p6_ids(spark, d))


@query("p7_near")
def p7_near(spark, d):
    """With one word of twelve edited."""
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_passages"), budget=1)


@query("p8_mix")
def p8_mix(spark, d):
    """(subject, source, lang, n_docs): the make-up of the corpus."""
    docs = table(spark, d, "documents")
    found = subjects.subjects_of(docs, table(spark, d, "subject_examples"))
    return docs.select("doc_id", "source", "lang").join(found, "doc_id").groupBy("subject", "source", "lang").count().withColumnRenamed("count", "n_docs")


# A word is a run of letters and numbers; a text's words as one string with single spaces, and as a list.
def _text(x: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({x}, ''), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')))"


def _words(x: str) -> str:
    return f"list_filter(string_split({_text(x)}, ' '), lambda w: w <> '')"


def _mark(x: str) -> str:
    return f"lower(regexp_extract(coalesce({x}, ''), '^\\s*(query|document)\\s*:', 1, 'i'))"


def _body(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^\\s*(query|document)\\s*:', '', 'i')"


def _fields(x: str) -> str:
    return f"list_sort(list_filter(list_transform({x}, lambda f: {_text('f')}), lambda f: f <> ''))"


_P2 = f"""WITH r AS (SELECT 'train_samples' AS tab, sample_id AS id, {_mark("input")} AS mark, {_fields("regexp_split_to_array(" + _body("input") + ", '[|;\\n\\r]')")} AS f FROM train_samples
UNION ALL SELECT 'pseudo_queries', doc_idx, '', {_fields("coalesce(pseudo_queries, []::VARCHAR[])")} FROM pseudo_queries),
k AS (SELECT tab, id, min(id) OVER (PARTITION BY tab, mark, f) AS keep_id FROM r WHERE len(f) > 0)"""
_P3 = f"""WITH h AS (SELECT query_idx, list_distinct({_words(_body("input"))}) AS w FROM test_samples), t AS (SELECT sample_id, list_distinct({_words(_body("input"))}) AS w FROM train_samples),
c AS (SELECT query_idx, sample_id, count(*) AS n FROM (SELECT query_idx, unnest(w) AS x FROM h) JOIN (SELECT sample_id, unnest(w) AS x FROM t) USING (x) GROUP BY 1, 2),
found AS (SELECT query_idx, sample_id FROM c JOIN h USING (query_idx) JOIN t USING (sample_id) WHERE n >= 0.75 * (len(h.w) + len(t.w) - n))"""
_P7 = f"""WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents), i AS (SELECT item_id, {_words("text")} AS w FROM eval_passages),
g AS (SELECT item_id, s AS n, w[k + 1:k + s] AS g FROM (SELECT item_id, w, least(len(w), 12) AS s, unnest(range(len(w) - least(len(w), 12) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM g)
SELECT DISTINCT x.doc_id, g.item_id FROM (SELECT doc_id, n, w[k + 1:k + n] AS g FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS k FROM d JOIN sizes ON n <= len(w))) x JOIN g ON g.n = x.n AND g.g = x.g"""
_P1 = """WITH RECURSIVE e AS (SELECT doc_idx, min(embedding) AS v FROM doc_embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND doc_idx IS NOT NULL GROUP BY 1),
u AS (SELECT doc_idx, v::DOUBLE[] AS v, sqrt(list_inner_product(v::DOUBLE[], v::DOUBLE[])) AS n FROM e),
l AS MATERIALIZED (SELECT a.doc_idx AS a, b.doc_idx AS b FROM u a JOIN u b ON a.doc_idx <> b.doc_idx WHERE list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.9),
r AS (SELECT DISTINCT a AS doc, a AS near FROM l UNION SELECT l.b, r.near FROM r JOIN l ON l.a = r.doc),
c AS (SELECT min(near) AS cluster_idx, doc AS doc_idx, count(*) AS n FROM r GROUP BY doc HAVING count(*) >= 5)"""
_P4 = f"""WITH f AS (SELECT line_no, passages.passage_text AS ts, unnest(range(len(passages.passage_text))) AS pos FROM raw_qa),
p AS (SELECT DISTINCT line_no * 100 + pos AS k, list_sort(list_distinct({_words("ts[pos + 1]")})) AS w FROM f WHERE ts[pos + 1] IS NOT NULL),
s AS (SELECT min(k) AS id, w FROM p WHERE len(w) > 0 GROUP BY w), m AS (SELECT k, id FROM p JOIN s USING (w)),
x AS (SELECT id, len(w) AS n, unnest(w) AS x FROM s),
c AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM x a JOIN x b ON a.x = b.x AND a.id < b.id AND 10 * b.n >= 7 * a.n AND 7 * b.n <= 10 * a.n GROUP BY 1, 2),
l AS (SELECT a, b FROM c WHERE 10 * c >= 7 * (n + m - c))"""
ORACLE |= {
    "p1_found": _P1 + " SELECT cluster_idx, doc_idx FROM c",
    "p1_clusters": _P1 + """, o AS (SELECT c.cluster_idx, c.doc_idx, u.v, u.n AS len, c.n FROM c JOIN u USING (doc_idx)),
t AS (SELECT a.cluster_idx, a.doc_idx, round(sum(list_inner_product(a.v, b.v) / (a.len * b.len)) / any_value(a.n), 9) AS own, any_value(a.n) AS size FROM o a JOIN o b USING (cluster_idx) GROUP BY 1, 2),
y AS (SELECT cluster_idx, any_value(size) AS size, array_to_string(list(doc_idx ORDER BY own DESC, doc_idx)[1:5], ',') AS typical FROM t GROUP BY 1),
k AS (SELECT DISTINCT doc_idx, level, codes[level] AS code FROM (SELECT doc_idx, codes, unnest(range(1, len(codes) + 1)) AS level FROM rq_codes)),
w AS (SELECT cluster_idx, level, code, row_number() OVER (PARTITION BY cluster_idx, level ORDER BY count(*) DESC, code) AS r FROM k JOIN c USING (doc_idx) GROUP BY 1, 2, 3),
z AS (SELECT cluster_idx, array_to_string(list(code ORDER BY level), ',') AS codes FROM w WHERE r = 1 GROUP BY 1)
SELECT cluster_idx, size, typical, codes FROM y LEFT JOIN z USING (cluster_idx)""",
    "p4_found": _P4 + ", y AS (SELECT a, b FROM l UNION ALL SELECT id, id FROM s) SELECT DISTINCT least(v.k, w.k) AS passage_a, greatest(v.k, w.k) AS passage_b FROM y JOIN m v ON v.id = y.a JOIN m w ON w.id = y.b WHERE v.k <> w.k",
    "p4_groups": _P4 + ", n AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM l UNION ALL SELECT b FROM l) GROUP BY 1) SELECT k AS key, id AS class_key, coalesce(n, 0) AS n_links FROM m LEFT JOIN n USING (id)",
    "p2_found": _P2 + " SELECT tab, keep_id, id AS copy_id FROM k WHERE id <> keep_id",
    "p2_kept": _P2 + ", c AS (SELECT id, keep_id FROM k WHERE tab = 'train_samples' AND id <> keep_id), n AS (SELECT keep_id, count(*) AS n FROM c GROUP BY 1) SELECT sample_id AS keep_id, coalesce(n, 0) + 1 AS n_copies FROM train_samples LEFT JOIN n ON n.keep_id = sample_id WHERE sample_id NOT IN (SELECT id FROM c)",
    "p2_kept_both": _P2 + ", c AS (SELECT tab, id, keep_id FROM k WHERE id <> keep_id), n AS (SELECT tab, keep_id, count(*) AS n FROM c GROUP BY 1, 2), a AS (SELECT DISTINCT tab, id FROM r) SELECT a.tab, a.id AS keep_id, coalesce(n, 0) + 1 AS n_copies FROM a LEFT JOIN n ON n.tab = a.tab AND n.keep_id = a.id LEFT JOIN c ON c.tab = a.tab AND c.id = a.id WHERE c.id IS NULL",
    "p3_found": _P3 + " SELECT query_idx, sample_id FROM found",
    "p3_counts": _P3 + ", p AS (SELECT query_idx, count(*) AS n FROM found GROUP BY 1) SELECT split, source, count(*) AS n_rows, sum(n)::BIGINT AS n_pairs FROM test_samples JOIN p USING (query_idx) GROUP BY 1, 2",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_found": _P7,
}
