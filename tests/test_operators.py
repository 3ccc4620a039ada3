"""Hand-worked cases of the core operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmark.functions import text, vectors
from siftmark.operators import allpairs, ingest, knn, metrics, models, order, rq, sampling, samples, stats, trie
from siftmark.plans import catalogue
from siftmark.sources import readers, sinks


def one(df):
    return [tuple(r) for r in df.collect()]


def value(spark, column, **cells):
    return spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'array<int>'}" for k, v in cells.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize("url,t,want", [(None, "hello", "doc_8f45ee418ad4d96c"), (None, " hello\n", "doc_8f45ee418ad4d96c"), ("http://a", "hello", "doc_b8627a6f24e93020"), (None, None, None)])
def test_doc_key(spark, url, t, want):
    assert value(spark, text.doc_key(F.col("t"), F.col("u")), t=t, u=url) == want


def test_strip(spark):
    s = " \x1c a b　\x85"
    assert value(spark, text.py_strip(F.col("t")), t=s) == s.strip() == "a b"


def test_positive(spark):
    yes = ["1", " true ", "True"]
    no = ["0", "TRUE", "2", None]
    df = spark.createDataFrame([(x,) for x in yes + no], "f string").select(text.is_positive(F.col("f"), "string").alias("p"))
    assert [r.p for r in df.collect()] == [True] * 3 + [False] * 4
    nums = spark.createDataFrame([(1.0,), (1.9,), (0.0,), (2.0,), (None,)], "f double").select(text.is_positive(F.col("f"), "double").alias("p"))
    assert [r.p for r in nums.collect()] == [True, True, False, False, False]
    flags = spark.createDataFrame([(True,), (False,), (None,)], "f boolean").select(text.is_positive(F.col("f"), "boolean").alias("p"))
    assert [r.p for r in flags.collect()] == [True, False, False]


@pytest.mark.parametrize("t,keep,want", [("Query: x ", False, "x"), ("Query: x ", True, "Query: x "), (" query: x", False, "query: x"), (None, False, None)])
def test_query_text(spark, t, keep, want):
    assert value(spark, text.query_text(F.col("t"), keep), t=t) == want


def test_rqid(spark):
    assert value(spark, text.rqid(F.col("c")), c=[12, 7]) == "<r0_12> <r1_7>"
    assert value(spark, text.rqid_codes(F.col("t")), t="<r0_12> <r1_7>") == [12, 7]
    with pytest.raises(Exception, match="no codes in"):
        value(spark, text.rqid_codes(F.col("t")), t="abc")


RAW = "split string, split_ord int, line_no long, query string, passages struct<passage_text: array<string>, is_selected: array<int>, url: array<string>>, id string, pos string"


def raw(spark, *rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], RAW)


def test_qa_pairs(spark):
    rows = raw(
        spark,
        ("train", 0, 1, " q ", (["a", "b", " ", "c"], [1, 0, 1], ["u"])),
        ("train", 0, 2, " ", (["a"], [1], None)),
        ("train", 0, 3, None, (["a"], [1], None)),
        ("train", 0, 4, "two", (["x", None, "y"], [1, 1, 1], [None, None, "v"])),
        ("train", 0, 5, "none", None),
        ("train", 0, 6, "empty", ([], [], [])),
    )
    got = one(ingest.qa_pairs(rows).select("line_no", "pos", "query", "text", "url").orderBy("line_no", "pos"))
    assert got == [(1, 0, "q", "a", "u"), (4, 0, "two", "x", None), (4, 2, "two", "y", "v")]
    assert one(ingest.qa_pairs(rows.limit(0))) == []


def test_first_docs_and_numbers(spark):
    rows = raw(spark, ("test", 2, 1, "q", (["same ", "z"], [1, 1], None)), ("train", 0, 9, "q", ([" same"], [1], None)), ("train", 0, 9, "q", ([" same"], [1], None)))
    pairs = ingest.qa_pairs(rows)
    docs = ingest.first_docs(pairs)
    got = {r.text: (r.doc_idx, r.split) for r in ingest.with_doc_idx(docs).collect()}
    assert got == {" same": (0, "train"), "z": (1, "test")}
    assert sorted(one(ingest.split_counts(pairs, docs))) == [("test", 2, 1), ("train", 2, 1)]


def test_operation_rows(spark):
    rows = spark.createDataFrame([("train", 0, 0, "indexing", "d", " t"), ("valid", 1, 0, "indexing", "d", "u"), ("test", 2, 1, "query", "d", "q"), ("test", 2, 2, "query", None, "q"), ("test", 2, 3, "other", "d", "q")], "split string, split_ord int, line_no long, operation string, doc_id string, text string")
    assert one(ingest.first_docs(ingest.operation_docs(rows)).select("doc_id", "text", "split")) == [("d", " t", "train")]
    assert one(ingest.operation_queries(rows).select("line_no", "text")) == [(1, "q")]


def test_numbering_is_the_same_for_any_partitioning(spark):
    rows = [(i * 37 % 101, "x") for i in range(101)]
    for parts in (1, 8):
        df = spark.createDataFrame(rows, "v long, w string").repartition(parts)
        assert {r.v: r.n for r in order.numbered(df, [F.col("v")]).collect()} == {i: i for i in range(101)}
    assert one(order.numbered(spark.createDataFrame([], "v long"), [F.col("v")])) == []


def q_and_d(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0], 11), (2, [0.0, 1.0], 99)], "query long, v array<double>, gold long")
    d = spark.createDataFrame([(10, [0.9, 0.1]), (11, [0.5, 0.5]), (12, [0.5, 0.2]), (13, [0.1, 0.9])], "doc long, v array<double>")
    return q, d


def test_top_k(spark, monkeypatch):
    q, d = q_and_d(spark)
    want = [(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 13, 1), (2, 11, 2), (2, 12, 3)]
    assert one(knn.top_k(q, d, 3).select("query", "doc", "rank").orderBy("query", "rank")) == want
    assert one(knn.top_k(q, d, 1, "gold").select("query", "doc").orderBy("query")) == [(1, 10), (2, 13)]
    assert one(knn.top_k(q, d, 9).where("query = 1").select("doc").orderBy("rank")) == [(10,), (11,), (12,), (13,)]
    assert one(knn.top_k(q.limit(0), d, 3)) == [] and one(knn.top_k(q, d.limit(0), 3)) == []
    monkeypatch.setattr(knn, "BLOCK", 1)
    assert one(knn.top_k(q, d, 3).select("query", "doc", "rank").orderBy("query", "rank")) == want
    with pytest.raises(ValueError):
        knn.top_k(q, d, 0)


def test_gold_rank_ignores_ties(spark):
    q, d = q_and_d(spark)
    got = knn.gold_ranks(q.where("query = 1"), d, 2).first()
    assert (got.gold_rank, got.gold_sim, got.top1_doc, got.top1_sim) == (2, 0.5, 10, 0.9)
    assert math.isclose(got.top_mean, 0.7)
    with pytest.raises(Exception, match="gold document without a vector"):
        knn.gold_ranks(q, d).collect()


def test_vectors(spark):
    with pytest.raises(Exception, match="length zero"):
        spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(vectors.normalised(F.col("v"))).collect()


def test_assign_and_uniqueness(spark):
    books = spark.createDataFrame([(0, 0, [0.0, 0.0]), (0, 1, [1.0, 1.0]), (1, 0, [0.1, 0.0]), (1, 1, [-0.1, 0.0])], "level int, code int, centroid array<double>")
    docs = spark.createDataFrame([(1, [0.1, 0.0]), (2, [0.9, 1.0]), (3, [0.5, 0.5])], "doc long, v array<double>")
    got = rq.assign(docs, books)
    assert {r.doc: r.codes for r in got.collect()} == {1: [0, 0], 2: [1, 1], 3: [0, 0]}
    assert one(rq.uniqueness(rq.docids(got))) == [(3, 2, 2 / 3)]
    assert one(rq.assign(docs.limit(0), books)) == []
    assert rq.residual_norms(got).count() == 2


def test_k_means(spark):
    pts = [(i, [float(i % 3 * 10 + i / 1000), 0.0]) for i in range(60)]
    docs = spark.createDataFrame(pts, "doc long, v array<double>")
    books = rq.fit(docs, levels=2, codes=6, rounds=15)
    codes = {r.doc: tuple(r.codes) for r in rq.assign(docs, books).collect()}
    assert all(codes[a][0] != codes[b][0] for a in range(3) for b in range(3) if a != b)
    assert len(rq.lloyd(docs, 100, 2)) == 60 and len(rq.lloyd(docs.limit(0), 5)) == 0


def test_prefix_metrics(spark):
    near = spark.createDataFrame([(1, d, 0.9, r) for r, d in enumerate((2, 3, 4), 1)], "query long, doc long, sim double, rank long")
    codes = spark.createDataFrame([(1, [1, 2]), (2, [1, 2]), (3, [1, 3]), (4, [4, 2])], "doc long, codes array<int>")
    rows = metrics.with_shared(near, codes.withColumnRenamed("doc", "query"), codes, 2)
    assert one(metrics.prefix_recall(rows, [3, 2, 2], 2).orderBy("k")) == [(2, 1.0, 0.5), (3, 2 / 3, 1 / 3)]
    assert one(metrics.prefix_hit(rows, [2], 2)) == [(2, 1.0, 1.0)]
    assert [(r.k, r["mean"]) for r in metrics.unique_first_codes(rows, [2, 3]).orderBy("k").collect()] == [(2, 1.0), (3, 2.0)]
    with pytest.raises(ValueError):
        metrics.k_values([0])


def test_recall_and_histogram(spark):
    ranks = spark.createDataFrame([(1,), (3,), (7,)], "gold_rank long")
    assert one(metrics.recall_at(ranks, [1, 5, 10]).orderBy("k")) == [(1, 1 / 3), (5, 2 / 3), (10, 1.0)]
    h = {r.bucket: r["count"] for r in metrics.rank_histogram(ranks).collect()}
    assert len(h) == 8 and h["1"] == h["2-5"] == h["6-10"] == 1 and sum(h.values()) == 3
    assert all(r.fraction is None for r in metrics.rank_histogram(ranks.limit(0)).collect())


def test_bins(spark):
    assert len(metrics.bin_edges()) == 21 and metrics.bin_edges()[3] == 0.15000000000000002
    assert [round(e, 9) for e in metrics.bin_edges(0, 1, 0.3)] == [0, 0.3, 0.6, 0.9, 1]
    df = spark.createDataFrame([(x, 1) for x in (0.0, 1.0, -0.1, 1.0000001, 0.15)], "sim double, shared int")
    assert [r.b for r in df.select(metrics.bin_of(F.col("sim"), metrics.bin_edges()).alias("b")).collect()] == [0, 19, -1, 20, 2]
    bins = metrics.consistency(df, metrics.bin_edges(), 1).collect()
    assert len(bins) == 20 and sum(r.n_pairs for r in bins) == 3
    assert one(metrics.outside(df, metrics.bin_edges())) == [(5, 1, 1)]
    with pytest.raises(ValueError):
        metrics.bin_edges(1, 0)


def test_summary(spark):
    s = stats.summary(spark.createDataFrame([(1,), (2,), (4,), (9,), (None,)], "x int"), F.col("x")).first()
    assert (s.n, s.p10, s.q25, s["median"], round(s.p90, 9)) == (4, 1.3, 1.75, 3.0, 7.5)
    assert stats.summary(spark.createDataFrame([(5,)], "x int"), F.col("x")).first()["std"] == 0.0
    e = stats.summary(spark.createDataFrame([], "x int"), F.col("x")).first()
    assert e.n == 0 and e["mean"] is None


def test_mann_whitney(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", 2.0), ("y", 3.0)], "g string, v double")
    r = stats.mann_whitney(df, F.col("g"), F.col("v")).first()
    assert (r.u1, r.u2, r.cliffs_delta, r.mean_diff) == (0.5, 3.5, -0.75, -1.0)
    assert round(r.z_approx, 6) == 0.816497 and round(r.cohens_d, 6) == -1.414214
    assert round(stats.p_two_sided(r.z_approx), 6) == 0.414216
    e = stats.mann_whitney(df.where("g = 'x'"), F.col("g"), F.col("v")).first()
    assert e.n_x == 2 and e.n_y == 0 and e.u1 is None


def test_group_cap(spark):
    g = spark.createDataFrame([(1,), (10,), (1000,)], "n_pairs long")
    assert one(sampling.group_cap(g, 21, 5, 40)) == [(10, 21)]
    assert one(sampling.group_cap(g, 50, 5, 40)) == [(40, 51)]


def test_pair_samples(spark):
    codes = spark.createDataFrame([(i, [i % 3, i]) for i in range(60)], "doc long, codes array<int>")
    got = one(sampling.same_prefix_pairs(codes, 1, 100))
    assert len(got) == len({frozenset(p) for p in got}) == 100 and all(a != b and a % 3 == b % 3 for a, b in got)
    every = one(sampling.random_pairs(codes, 60 * 59 // 2))
    assert len({frozenset(p) for p in every}) == 60 * 59 // 2
    assert one(sampling.random_pairs(codes.repartition(5), 50)) and sorted(one(sampling.random_pairs(codes.repartition(5), 50))) == sorted(one(sampling.random_pairs(codes.repartition(2), 50)))
    with pytest.raises(ValueError):
        sampling.random_pairs(codes, 10_000)
    assert sampling.anchors(codes, 7).count() == 7 and sampling.anchors(codes, 0).count() == 60


def test_random_docs(spark):
    q = spark.range(200).select(F.col("id").alias("query"), F.lit(1).alias("gold"))
    rows = sampling.random_docs(q, 2, 4).collect()
    assert len(rows) == 800 and all(r.doc == 0 for r in rows)


def test_shuffled_codes(spark):
    codes = spark.createDataFrame([(i, [i, i % 2]) for i in range(30)], "doc long, codes array<int>")
    for got in (metrics.shuffled(codes, 1), metrics.dealt(codes, 7)):
        rows = got.collect()
        assert sorted(tuple(r.codes) for r in rows) == [(i, i % 2) for i in range(30)] and any(r.doc != r.codes[0] for r in rows)
    m = spark.createDataFrame([("rq", 1, 0.5), ("random_code_1", 1, 0.2), ("random_code_2", 1, 0.4)], "method string, k long, l1 double")
    assert {r.method: round(r.l1, 6) for r in metrics.averaged(m).collect()}["random_code_mean"] == 0.3


def test_trie(spark):
    t = trie.edges(spark.createDataFrame([([1, 2],), ([1, 3],), ([1, 3],), (None,), ([],)], "codes array<int>"))
    asked = spark.createDataFrame([([],), ([1],), ([1, 2],), ([9],)], "prefix array<int>")
    got = {}
    for r in trie.allowed(asked, t).collect():
        got.setdefault(tuple(r.prefix), set()).add(r.next)
    assert got == {(): {1}, (1,): {2, 3}, (1, 2): {None}, (9,): {None}}


def test_beam_search_is_exhaustive_when_wide(spark):
    import itertools

    paths = [list(p) for p in itertools.product(range(3), repeat=3) if sum(p) % 2] + [[7]]
    t = trie.edges(spark.createDataFrame([(p,) for p in paths], "codes array<int>"))
    score = spark.createDataFrame([(1, lv, c, round(((c * 7 + lv * 5) % 11) / 10, 3)) for lv in range(3) for c in range(8)], "query long, level int, code int, s double")
    s = {(r.level, r.code): r.s for r in score.collect()}
    want = sorted(((-round(sum(s[i, c] for i, c in enumerate(p)), 9), p) for p in paths))
    got = [(-r.total, r.codes) for r in trie.beam_search(spark.createDataFrame([(1,)], "query long"), t, score, 3, 50).orderBy("rank").collect()]
    assert [p for _, p in got] == [p for _, p in want]


def test_hits(spark):
    beams = [f"<r0_{i}>" for i in range(10)]
    df = spark.createDataFrame([("<r0_2>", beams), (None, beams), ("<r0_2>", None)], "gold string, beams array<string>")
    assert one(metrics.hits_at(df.limit(1)).orderBy("k")) == [(1, 0.0), (5, 1.0), (10, 1.0)]
    assert one(metrics.hits_at(df).orderBy("k"))[2] == (10, 0.3333)


def test_samples(spark):
    pairs = spark.createDataFrame([("train", "q1", "a"), ("valid", "q2", "a"), ("test", "q3", "a"), ("train", "q4", "zz")], "split string, query string, doc_id string")
    docs = spark.createDataFrame([("a", "text"), ("zz", "lost")], "doc_id string, text string")
    pseudo = spark.createDataFrame([("a", [" p ", None, " "]), (None, ["x"])], "doc_id string, pseudo_queries array<string>")
    ids = spark.createDataFrame([("a", "<r0_1>")], "doc_id string, rqid string")
    got = sorted(r.input for r in samples.train_samples(pairs, docs, pseudo, ids).collect())
    assert got == ["document: text", "query: p", "query: q1", "query: q2"]
    assert one(samples.test_samples(pairs, ids)) == [("query: q3", "<r0_1>", "a", "<r0_1>")]
    assert one(samples.skipped(pairs, ids)) == [(1,)]


def test_models(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, "")], "doc_id long, text string")
    v = {r.doc_id: r.embedding for r in models.encode(df, "doc_id", "text", models.HashingEncoder(8)).collect()}
    assert all(math.isclose(sum(x * x for x in e), 1, rel_tol=1e-5) for e in v.values())
    q = {r.doc_id: r.pseudo_queries for r in models.pseudo_queries(df, ["doc_id"], "text", models.SpanGenerator(2), 3).collect()}
    assert q == {1: ["a b", "b c", "c"], 2: [], 3: []}
    t = models.tokenised(spark.createDataFrame([("abc", "d"), (None, None)], "input string, output string"), lambda ts: [[ord(c) for c in t] for t in ts], 2, 2)
    assert one(t) == [([97, 98], [1, 1], [100]), ([], [], [])]


def test_cache_rules(spark, tmp_path):
    made = []

    def make(n):
        def f():
            made.append(n)
            return spark.range(n).withColumnRenamed("id", "query_idx")

        return f

    p = str(tmp_path / "c")
    assert models.cached(spark, p, 5, make(5), False).count() == 5
    assert models.cached(spark, p, 3, make(3), False).count() == 3 and made == [5]
    assert models.cached(spark, p, 3, make(3), True).count() == 3 and made == [5, 3]


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"operation": "indexing", "doc_id": "1", "text": "x"}\n  \n{"operation": "query", "doc_id": "1", "text": "é"}\n', encoding="utf-8")
    rows = readers.json_lines(spark, str(p), readers.OPERATION).orderBy("line_no").collect()
    assert [r.text for r in rows] == ["x", "é"] and readers.detect_format(spark, str(p)) == "operation"
    q = tmp_path / "b.jsonl"
    q.write_text('[1]\n{"other": 1}\n{"query": "q", "passages": {"passage_text": ["t"], "is_selected": [1], "url": ["u"]}}\n')
    assert readers.detect_format(spark, str(q)) == "qa"
    bad = tmp_path / "c.jsonl"
    bad.write_text('{"operation": \n')
    with pytest.raises(Exception, match="MALFORMED|malformed|JSON"):
        readers.json_lines(spark, str(bad), readers.OPERATION).collect()
    assert readers.detect_format(spark, str(bad)) == "unknown"
    kinds, all_rows = readers.splits(spark, {"train": str(p), "test": str(p), "valid": str(bad)})
    assert kinds == {"train": "operation", "test": "operation", "valid": "unknown"} and not all_rows["qa"].collect()
    assert sorted((r.split, r.split_ord) for r in all_rows["operation"].collect()) == [("test", 1)] * 2 + [("train", 0)] * 2
    # splits of different formats
    one_qa = tmp_path / "d.jsonl"
    one_qa.write_text(q.read_text().splitlines()[-1])
    kinds, all_rows = readers.splits(spark, {"train": str(p), "test": str(one_qa)})
    assert kinds == {"train": "operation", "test": "qa"} and all_rows["operation"].count() == 2 and [r.query for r in all_rows["qa"].collect()] == ["q"]


def test_json_flags(spark, tmp_path):
    """What counts as selected, by the JSON type of the flag."""
    flags = '[true, 1, 1.0, 1.9, " true ", "True", "1", false, 0, 2, "TRUE", "1.0", null, [1], {"a": 1}, -1, 0.9]'
    texts = str([f"t{i}" for i in range(17)]).replace("'", '"')
    p = tmp_path / "q.jsonl"
    p.write_text(f'{{"query": " q ", "passages": {{"passage_text": {texts}, "is_selected": {flags}, "url": []}}}}\n{{"query": "r", "passages": null}}\n{{"query": "s", "passages": {{"passage_text": ["x"]}}}}\n')
    rows = readers.splits(spark, {"train": str(p)})[1]["qa"]
    assert sorted(r.text for r in ingest.qa_pairs(rows).collect()) == [f"t{i}" for i in range(7)]


def test_other_sources(spark, tmp_path):
    import numpy as np

    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert one(readers.matrix(spark, str(tmp_path / "m.npy")).where("doc_idx = 2")) == [(2, [4.0, 5.0])]
    np.save(tmp_path / "v.npy", np.arange(3))
    with pytest.raises(ValueError):
        readers.matrix(spark, str(tmp_path / "v.npy"))
    (tmp_path / "m.json").write_text('{"a": "<r0_1>", "b": "<r0_2>"}')
    ids = readers.json_map(spark, str(tmp_path / "m.json"), "doc", "rqid")
    assert sorted(one(readers.codes(None, ids))) == [("a", [1]), ("b", [2])]
    with pytest.raises(ValueError):
        readers.codes(None, None)
    with pytest.raises(ValueError, match="widths"):
        readers.codes(spark.createDataFrame([(1, [1]), (2, [1, 2])], "doc long, codes array<int>"), None)
    corpus = spark.createDataFrame([(["x", "y"], [("q", "1", "test")])], "corpus array<string>, queries array<struct<text: string, doc_id: string, split: string>>")
    rows = readers.qa_corpus(corpus)
    assert rows.where("operation = 'indexing'").count() == 6 and one(rows.where("operation = 'query'").select("text", "split", "split_ord")) == [("q", "test", 2)]
    (tmp_path / "d.json").write_text('{\n "k": [1,\n 2]}')
    assert readers.json_document(spark, str(tmp_path / "d.json")).first().k == [1, 2]


def test_test_queries_and_gold(spark):
    schema = "query_idx long, input string, output string, gt_semid string, gt_rqid string"
    t = spark.createDataFrame([(0, "query: a", "<r0_1>", None, ""), (1, "b", "<r0_2>", "s", "<r0_3>")], schema)
    assert one(readers.test_queries(t).orderBy("query_idx")) == [(0, "a", "", "<r0_1>", [1]), (1, "b", "s", "<r0_3>", [3])]
    assert readers.test_queries(t, 1).count() == 1
    with pytest.raises(ValueError):
        readers.test_queries(t.limit(0))
    docs = spark.createDataFrame([(5, "s")], "doc long, doc_id string")
    assert one(readers.gold_docs(t.where("query_idx = 1").select("gt_semid"), docs)) == [("s", 5)]
    with pytest.raises(ValueError, match="1 gold"):
        readers.gold_docs(spark.createDataFrame([("zz",)], "gt_semid string"), docs)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "k long, v double")
    assert sorted(one(sinks.without_nan(df))) == [(1, None), (2, 0.5)]
    report = sinks.json_report({"t": df}, {"x": float("inf")}, str(tmp_path / "r.json"))
    assert report["x"] is None and {r["k"]: r["v"] for r in report["t"]} == {1: None, 2: 0.5}
    sinks.csv_report(df, str(tmp_path / "csv"), ["k"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    sinks.csv_report(df.limit(0), str(tmp_path / "none"), skip_empty=True)
    assert not (tmp_path / "none").exists()
    sinks.json_samples(spark.createDataFrame([("é", None)], "input string, output string"), str(tmp_path / "s"))
    assert one(spark.read.schema("input string, output string").json(str(tmp_path / "s"))) == [("é", None)]
    assert sinks.curve(spark.createDataFrame([(5,), (100,)], "n_pairs long")).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    from siftmark.streaming import ingest as stream

    rows = spark.createDataFrame([("train", 0, i, "q", ([f"t{i % 3}"], ["1"], [None])) for i in range(9)], "split string, split_ord int, line_no long, query string, passages struct<passage_text: array<string>, is_selected: array<string>, url: array<string>>")
    rows.repartition(3).write.json(str(tmp_path / "in"))
    stream.write(stream.documents(stream.read(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(r.doc_id for r in ingest.first_docs(ingest.qa_pairs(rows)).collect()) and len(got) == 3


def test_queries_of_long_texts(spark, sf):
    from siftmark.plans import catalogue

    words = [f"w{i}" for i in range(1000)]
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    got = models.pseudo_queries(df, ["doc_id"], "text", models.SpanGenerator(2), 5).first().pseudo_queries
    assert got == [" ".join(words[s : s + 2]) for s in range(0, 1000, 200)]
    text = {r.doc_id: (r.text or "").split() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in catalogue.QUERIES["generated_queries"](spark, sf).collect():
        w = text[r.doc_id]
        assert r.pseudo_queries == ([" ".join(w[len(w) * i // 5 :][:6]) for i in range(5)] if w else [])


def test_encoding_of_long_texts(spark, sf):
    import hashlib

    from siftmark.plans import catalogue

    def plain(t, dim):
        out = [0.0] * dim
        for w in (t or "").lower().split():
            v = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[v % dim] += 1 if v >> 63 else -1
        n = math.sqrt(sum(x * x for x in out))
        return [x / n for x in out] if n else [1.0] + [0.0] * (dim - 1)

    head = "same opening " * 300
    texts = {1: head + "one end " * 50, 2: head + "another close " * 50}
    got = {r.doc_id: r.embedding for r in models.encode(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id", "text", models.HashingEncoder(8)).collect()}
    assert got[1] != got[2]
    assert all(math.isclose(x, y, abs_tol=1e-6) for i in texts for x, y in zip(got[i], plain(texts[i], 8)))
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in catalogue.QUERIES["encoded_documents"](spark, sf).collect():
        assert all(math.isclose(x, y, abs_tol=1e-6) for x, y in zip(r.embedding, plain(text[r.doc_id], 64)))


def test_registered_codes_are_those_of_the_reference(spark, sf, monkeypatch):
    """256 codes and 20 rounds, as in its train.yaml; more than 32 codes are in use even on a small table."""
    from siftmark.plans import catalogue

    asked, fit = [], rq.fit
    monkeypatch.setattr(rq, "fit", lambda docs, levels=4, codes=256, rounds=20, **more: asked.append((levels, codes, rounds)) or fit(docs, levels, codes, rounds, **more))
    ids = [r.rqid for r in catalogue.QUERIES["rq_kmeans_codes"](spark, sf).collect()]
    assert asked == [(4, 256, 20)] and len({i.split()[0] for i in ids}) > 32


def test_same_prefix_summary_has_far_pairs(spark, sf):
    """With as few pairs as here, every pair with the same first codes is in, near or not."""
    from siftmark.plans import catalogue, frames

    docs = {r.doc for r in frames.docs(spark, sf).collect()}
    size = {}
    for r in frames.codes(spark, sf).collect():
        for n in range(1, 5) if r.doc in docs else ():
            size[n, tuple(r.codes[:n])] = size.get((n, tuple(r.codes[:n])), 0) + 1
    want = {f"same_l{n}": sum(s * (s - 1) // 2 for (m, _), s in size.items() if m == n) for n in range(1, 5)}
    got = {r.pair_type: r.n_pairs for r in catalogue.QUERIES["same_prefix_summary"](spark, sf).collect()}
    assert {k: v for k, v in got.items() if k != "random_all"} == {k: v for k, v in want.items() if v}
    assert len(catalogue.QUERIES["same_prefix_tests"](spark, sf).collect()) == 4


def test_tokens_checkpoints_and_pooling(spark, tmp_path):
    from siftmark.functions.text import rqid_tokens

    assert rqid_tokens(2, 2) == ["<r0_0>", "<r0_1>", "<r1_0>", "<r1_1>"]
    assert models.best_checkpoint(spark, str(tmp_path)) is None
    for name, best in (("checkpoint-10", "x"), ("checkpoint-20", "y")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "trainer_state.json").write_text('{"best_model_checkpoint": "%s", "epoch": 1}' % best)
    assert models.best_checkpoint(spark, str(tmp_path)) == "y"
    states = np.arange(24.0).reshape(2, 4, 3)
    left, right = np.array([[0, 1, 1, 1], [1, 1, 1, 1]]), np.array([[1, 1, 0, 0], [1, 1, 1, 1]])
    assert (models.last_states(states, left) == states[:, -1]).all()
    assert (models.last_states(states, right) == states[[0, 1], [1, 3]]).all()
    enc = models.PooledEncoder(lambda t: (np.ones((len(t), 2, 4)), np.ones((len(t), 2), int)), 2)
    assert np.allclose(enc(["a", "b", "c"]), 0.5) and enc([]).shape[0] == 0


def test_empty_centres_and_gaps(spark):
    """Nine copies of one point and one other: no centre stays empty while a cluster can be split."""
    rows = [(i, [1.0, 2.0 + 0.01 * i]) for i in range(40)] + [(100, [50.0, 50.0])]
    c = rq.lloyd(spark.createDataFrame(rows, "doc long, v array<double>"), 6, 10)
    x = np.array([v for _, v in rows])
    near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
    assert len(np.unique(near)) == 6
    books = spark.createDataFrame([(0, 0, [1.0]), (0, 2, [2.0])], "level int, code int, centroid array<double>")
    with pytest.raises(ValueError, match="gap"):
        rq.codebook_arrays(books)


def test_plans_without_hot_keys(spark):
    """No window over a whole table or a whole prefix group, and no query key at the root of the trie."""
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()


    cdf = plan(stats.empirical_cdf(spark.range(100).select(F.col("id").cast("double").alias("v")), F.col("v")))
    windows = [x for x in cdf.splitlines() if "Window [" in x]
    assert windows and all("__part" in x for x in windows)
    edges = trie.edges(spark.createDataFrame([([1, 2],), ([1, 3],)], "codes array<int>"))
    q = spark.createDataFrame([(1,), (2,)], "query long")
    score = spark.createDataFrame([(i, 0, 1, 0.5) for i in (1, 2)], "query long, level int, code int, s double")
    assert "BroadcastNestedLoopJoin" in (p := plan(trie.beam_search(q, edges, score, 1))) or "BroadcastHashJoin" in p


def test_strata_of_pair_numbers(spark):
    """Drawn pairs are spread over all documents: of 2,000 among 1,000, each tenth of the documents has about a tenth."""
    docs = spark.range(1000).select(F.col("id").alias("doc"))
    got = one(sampling.random_pairs(docs, 2000))
    assert len({frozenset(p) for p in got}) == 2000
    each = np.bincount([x // 100 for p in got for x in p], minlength=10)
    assert each.min() > 300 and each.max() < 500
    codes = docs.select("doc", F.array((F.col("doc") % 3).cast("int")).alias("codes"))
    other = one(sampling.random_pairs(docs, 500, codes=codes))
    assert len({frozenset(p) for p in other}) == 500 and all(a % 3 != b % 3 for a, b in other)
    with pytest.raises(ValueError):
        sampling.random_pairs(docs.limit(3), 4, codes=codes)
    one_group = spark.range(3000).select(F.col("id").alias("doc"), F.array(F.lit(1)).alias("codes"))
    same = one(sampling.same_prefix_pairs(one_group, 1, 1500))
    each = np.bincount([x // 300 for p in same for x in p], minlength=10)
    assert len({frozenset(p) for p in same}) == 1500 and each.min() > 220 and each.max() < 390


def test_scores_are_never_broadcast(spark):
    """Scores exploded from a few rows look small to the planner; the driver must not gather them."""
    q = spark.createDataFrame([(1,)], "query long")
    score = spark.createDataFrame([(1, 0)], "query long, level int").select("query", "level", F.explode(F.sequence(F.lit(0), F.lit(5000))).alias("code")).withColumn("s", F.lit(0.5))
    edges = trie.edges(spark.createDataFrame([([1, 2],), ([1, 3],)], "codes array<int>"))
    text = trie.beam_search(q, edges, score, 2)._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in text.splitlines() if "Join [query" in x]
    assert len(joins) == 2 and all("SortMergeJoin" in x for x in joins), text


def test_top_k_shuffles_no_vectors_per_block(spark, monkeypatch):
    """Whatever the number of blocks, vectors don't come several times in a shuffle; ties and codes as by plain code."""
    import numpy as np

    monkeypatch.setattr(knn, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 8))
    x[40:60] = x[0]  # copies
    x /= np.sqrt((x * x).sum(1))[:, None]
    codes = [None if i == 7 else [int(c) for c in rng.integers(0, 2, 3)] for i in range(90)]
    d = spark.createDataFrame([(i, v.tolist(), c) for i, (v, c) in enumerate(zip(x, codes))], "doc long, v array<double>, codes0 array<int>")
    q = d.withColumn("query", F.col("doc")).withColumnRenamed("doc", "self")
    got = knn.top_k(q, d, 5, "self", levels=[3])
    assert "Group" not in (p := got._jdf.queryExecution().executedPlan().toString()) and "Generate" not in p
    sim = np.round(x @ x.T, 9)
    want = []
    for i in range(90):
        near = sorted((j for j in range(90) if j != i), key=lambda j: (-sim[i, j], j))[:5]
        for r, j in enumerate(near):
            if codes[i] and codes[j]:
                shared = next((n for n in range(3) if codes[i][n] != codes[j][n]), 3)
                want.append((i, j, r + 1, shared, codes[j][0]))
    assert sorted(one(got.select("query", "doc", "rank", "shared0", "c0"))) == sorted(want)


def test_cosine_summary_of_all_pairs(spark, monkeypatch):
    """All pairs count, not those of the nearest documents only; files that meet on one core or several give the same."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(400, 64))
    v[300:] = v[:100] + 0.01 * rng.normal(size=(100, 64))
    v[390:] = v[0]
    v /= np.sqrt((v * v).sum(1))[:, None]
    codes = [[int(x) for x in rng.integers(0, 3, 4)] for _ in v]
    codes[5], codes[6], codes[7], codes[8] = [1], [1], [], [1, None, 2, 0]
    whole = [tuple((c + [None] * 4)[:4]) for c in codes]
    groups = {}
    for i in range(len(v)):
        for j in range(len(v)):
            if i != j:
                same = [a == b for a, b in zip(whole[i], whole[j])]
                groups.setdefault(same.index(False) if False in same else 4, []).append(round(float(v[i] @ v[j]), 9))
    docs = spark.createDataFrame([(i, x.tolist(), c) for i, (x, c) in enumerate(zip(v, codes))], "doc long, v array<double>, codes array<int>")
    for block in (8192, 40):
        monkeypatch.setattr(allpairs, "BLOCK", block)
        got = {r.shared: r for r in allpairs.cosine_summary(docs, 4).collect()}
        assert set(got) == set(groups) == {0, 1, 2, 3, 4}
        for g, x in groups.items():
            r, half = got[g], 1.96 * np.std(x, ddof=1) / len(x) ** 0.5
            assert r.n_pairs == len(x)
            want = [np.mean(x), *np.percentile(x, [25, 50, 75]), np.std(x, ddof=1), np.mean(x) - half, np.mean(x) + half]
            assert [r.mean, r.q25, r.median, r.q75, r.std, r.ci95_low, r.ci95_high] == pytest.approx(want, abs=2e-9)
    assert allpairs.cosine_summary(docs.limit(0), 4).collect() == allpairs.cosine_summary(docs.limit(1), 4).collect() == []


def test_pair_cosine_summary_has_all_pairs(spark, sf):
    """A document has pairs with all others that have codes, not with its hundred nearest only."""
    docs = catalogue.frames.docs(spark, sf).join(catalogue.frames.codes(spark, sf), "doc").count()
    assert sum(r.n_pairs for r in catalogue.pair_cosine_summary(spark, sf).collect()) == docs * (docs - 1)
