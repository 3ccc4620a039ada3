"""Every operator on the whole small tables, against plain versions."""

import random

import pyarrow.parquet as pq
import pytest

from siftmark.llm import queries, subjects, tokenise
from tests.llm import brute


def rows(sf, table, *cols):
    t = pq.read_table(f"{sf}/{table}.parquet", columns=list(cols))
    return list(zip(*(t[c].to_pylist() for c in cols)))


def found(spark, sf, name):
    return [tuple(r) for r in queries.QUERIES[name](spark, sf).collect()]


def same(got, want):
    assert len(got) == len(set(got))
    assert set(got) == set(want)


def test_p1(spark, sf):
    same(found(spark, sf, "p1_found"), brute.p1(rows(sf, "doc_embeddings", "doc_idx", "embedding")))


def test_p2(spark, sf):
    a = brute.p2_inputs(rows(sf, "train_samples", "sample_id", "input"))
    b = brute.p2_lists(rows(sf, "pseudo_queries", "doc_idx", "pseudo_queries"))
    same(found(spark, sf, "p2_found"), {("train_samples", *x) for x in a} | {("pseudo_queries", *x) for x in b})


def test_p3(spark, sf):
    left = [(i, brute.mark_body(t)[1]) for i, t in rows(sf, "test_samples", "query_idx", "input")]
    right = [(i, brute.mark_body(t)[1]) for i, t in rows(sf, "train_samples", "sample_id", "input")]
    same(found(spark, sf, "p3_found"), brute.jaccard_pairs(left, right, 0.75))


def test_p4(spark, sf):
    texts = [(n * 100 + k, t) for n, p in rows(sf, "raw_qa", "line_no", "passages") if p for k, t in enumerate(p["passage_text"] or [])]
    same(found(spark, sf, "p4_found"), brute.jaccard_pairs(texts, None, 0.7))


def test_p5(spark, sf):
    want = brute.p5(rows(sf, "doc_embeddings", "doc_idx", "embedding"))
    got = set(found(spark, sf, "p5_found"))
    assert len(got & want) >= 0.98 * len(want)
    assert len(got - want) <= 0.02 * len(want)


def test_p6(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokenise.tokenizer_dir()}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    want = {i: t.encode(x, add_special_tokens=False).ids if x else [] for i, x in rows(sf, "documents", "doc_id", "text")}
    assert {i: list(x) for i, x in found(spark, sf, "p6_ids")} == want


def test_p6_round_trip(spark, sf):
    assert dict(found(spark, sf, "p6_decoded")) == {i: x or "" for i, x in rows(sf, "documents", "doc_id", "text")}


def test_p7(spark, sf):
    same(found(spark, sf, "p7_found"), brute.p7(rows(sf, "documents", "doc_id", "text"), rows(sf, "eval_passages", "item_id", "text")))


def test_p8_held_out(spark):
    """A model of three quarters of the examples, on the documents of a larger table, knows the rest."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    examples = sorted(rows(d, "subject_examples", "example_id", "subject", "text"))
    # a random quarter: the examples' numbers follow their subjects and languages, and each fourth one would
    # leave some subjects without any example in one language
    random.Random(1).shuffle(examples)
    train, rest = [(s, t) for _, s, t in examples[135:]], [(s, t) for _, s, t in examples[:135]]
    model = subjects.fit(docs.select("doc_id", "text", "source"), train)
    labels = model.classify([t for _, t in rest], [None] * len(rest))
    right = sum({model.subjects[k] for k in r.nonzero()[0]} == {s} for (s, _), r in zip(rest, labels))
    assert right >= 0.85 * len(rest)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle_columns(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("raw_qa", "doc_embeddings", "rq_codes", "pseudo_queries", "train_samples", "test_samples", "documents", "eval_passages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    r = con.execute(queries.ORACLE[name])
    names = [c[0] for c in r.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(names) == sorted(df.columns)
    want = sorted(map(repr, r.fetchall()))
    got = sorted(repr(tuple(x[c] for c in names)) for x in df.collect())
    assert got == want


def test_p2_kept_both(spark, sf):
    want = set()
    for tab, key, col, plain in (("train_samples", "sample_id", "input", brute.p2_inputs), ("pseudo_queries", "doc_idx", "pseudo_queries", brute.p2_lists)):
        r = rows(sf, tab, key, col)
        found = plain(r)
        gone = {c for _, c in found}
        want |= {(tab, i, 1 + sum(k == i for k, _ in found)) for i, _ in r if i not in gone}
    same([tuple(r) for r in queries.QUERIES["p2_kept_both"](spark, sf).collect()], want)
