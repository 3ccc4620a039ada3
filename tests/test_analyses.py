"""The six reports on one small set of vectors."""

import numpy as np
import pytest

from siftmark.plans import analyses


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((120, 8))
    v[60:] = v[:60] + 0.2 * rng.standard_normal((60, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    docs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc long, v array<double>")
    codes = spark.createDataFrame([(i, [i % 60 % 6, i % 60]) for i in range(120)], "doc long, codes array<int>")
    queries = spark.createDataFrame([(i, v[i + 60].tolist(), i, [i % 6, i]) for i in range(40)], "query long, v array<double>, gold long, codes array<int>")
    return queries, docs, codes


def test_gold_rank(frames):
    q, d, _ = frames
    r = analyses.gold_rank(q, d, (1, 2, 10), 5, 2)
    recall = {x.k: x.gold_recall_at_k for x in r["recall"].collect()}
    assert recall[1] <= recall[2] <= recall[10] and sum(x["count"] for x in r["histogram"].collect()) == 40
    assert {x.metric for x in r["summary"].collect()} >= {"gold_rank", "random_mean", "gap"}
    with pytest.raises(ValueError):
        analyses.gold_rank(q, d, (500,))


def test_prefix_reports(frames):
    q, d, c = frames
    for r in (analyses.query_prefix(q, d, c, (1, 5), 4), analyses.neighbour_prefix(d, c, (1, 5), 2, 50, 2)):
        hit = {(x.method, x.k): x for x in r["hit"].collect()}
        for x in r["recall"].collect():
            h = hit[x.method, x.k]
            assert h.l1 >= x.l1 and x.l1 >= x.l2
        assert all(x["mean"] >= 1 for x in r["unique_l1"].collect())
    assert "random_code_mean" in {x.method for x in r["recall"].collect()}
    with pytest.raises(ValueError):
        analyses.neighbour_prefix(d, c, (120,))


def test_consistency_reports(frames):
    q, d, c = frames
    for r in (analyses.document_consistency(d, c, 10), analyses.query_consistency(q, d, c, 10)):
        bins, out = r["bins"].collect(), r["outside"].first()
        assert len(bins) == 40 and sum(b.n_pairs for b in bins) + out.outside_low + out.outside_high == out.n_pairs
    with pytest.raises(ValueError):
        analyses.query_consistency(q, d, c.withColumn("codes", c.codes), 200)


def test_semanticity(frames):
    _, d, c = frames
    r = analyses.semanticity(d, c, 300)
    s = {x.pair_type: x for x in r["summary"].collect()}
    assert s["random_all"].n_pairs == 300 and s["same_l2"]["mean"] > s["same_l1"]["mean"] > s["random_all"]["mean"] - 0.2
    for x in r["significance"].collect():
        assert x.u1 + x.u2 == x.n_x * x.n_y


def test_encoded_queries_to_report(spark, tmp_path):
    """Test rows to the report of single queries, under its published names; vectors come from the cache."""
    from siftmark.operators import models
    from siftmark.plans import frames as inputs

    words = [f"w{i} x{i}" for i in range(40)]
    docs = models.encode(spark.createDataFrame([(i, f"s{i}", t) for i, t in enumerate(words)], "doc long, doc_id string, text string"), "doc", "text", models.HashingEncoder())
    docs = docs.select("doc", docs.embedding.cast("array<double>").alias("v"))
    names = spark.createDataFrame([(i, f"s{i}") for i in range(40)], "doc long, doc_id string")
    rows = spark.createDataFrame([(i, f"query: {words[i]}", "<r0_1> <r1_2>", f"s{i}", None) for i in range(20)], "query_idx long, input string, output string, gt_semid string, gt_rqid string")
    path = str(tmp_path / "cache")
    q = inputs.encoded_queries(rows, names, models.HashingEncoder(), max_queries=15, cache=path)
    assert q.count() == 15 and q.first().codes == [1, 2]
    again = inputs.encoded_queries(rows, names, None, max_queries=10, cache=path)  # no encoder is needed
    assert again.count() == 10
    got = analyses.gold_rank(q, docs, (1, 5), 3)["per_query"]
    assert got.columns == ["query_index", "gt_semid", "gt_doc_index", "gold_rank", "gold_similarity", "top1_doc_index", "top1_similarity", "top1_is_gold", "top1_minus_gold_gap", "top_non_gold_mean_similarity", "random_mean_similarity"]
    for r in got.collect():
        assert r.gt_semid == f"s{r.gt_doc_index}" and r.gold_rank == 1 and abs(r.gold_similarity - 1) < 1e-6
    with pytest.raises(ValueError):
        inputs.encoded_queries(rows, names.limit(3), models.HashingEncoder())


def test_levels_end_with_the_gold_codes(frames):
    from pyspark.sql import functions as F

    q, d, c = frames
    short = q.withColumn("codes", F.slice("codes", 1, 1))
    r = analyses.query_prefix(short, d, c, (5,), 4)["recall"]
    assert "l1" in r.columns and "l2" not in r.columns
    r = analyses.semanticity(d, c, 300)["significance"].collect()
    assert all(0 <= x.p_two_sided_approx <= 1 for x in r)
