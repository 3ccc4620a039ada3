"""Training and test samples from pairs, documents and pseudo-queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.functions.text import is_blank, py_strip


def as_query(c: Column) -> Column:
    return F.concat(F.lit("query: "), c)


def as_document(c: Column) -> Column:
    return F.concat(F.lit("document: "), c)


def query_samples(pairs: DataFrame, rqids: DataFrame) -> DataFrame:
    """(input, output) of the pairs (query, doc_id) whose document has an rqid; one row for each pair."""
    return pairs.select("query", "doc_id").join(rqids, "doc_id").select(as_query(F.col("query")).alias("input"), F.col("rqid").alias("output"))


def skipped(pairs: DataFrame, rqids: DataFrame) -> DataFrame:
    """(n_skipped): the pairs whose document has no rqid."""
    return pairs.join(rqids, "doc_id", "left_anti").agg(F.count("*").alias("n_skipped"))


def document_samples(docs: DataFrame, rqids: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").join(rqids, "doc_id").select(as_document(F.col("text")).alias("input"), F.col("rqid").alias("output"))


def pseudo_samples(pseudo: DataFrame, rqids: DataFrame) -> DataFrame:
    """(input, output) of every pseudo-query that is not blank, stripped."""
    q = pseudo.select("doc_id", F.explode("pseudo_queries").alias("q")).where(~is_blank(F.col("q")))
    return q.join(rqids, "doc_id").select(as_query(py_strip(F.col("q"))).alias("input"), F.col("rqid").alias("output"))


def train_samples(pairs: DataFrame, docs: DataFrame, pseudo: DataFrame, rqids: DataFrame) -> DataFrame:
    """(input, output): the pairs of train and valid, the documents and the pseudo-queries."""
    return query_samples(pairs.where(F.col("split").isin("train", "valid")), rqids).unionByName(document_samples(docs, rqids)).unionByName(pseudo_samples(pseudo, rqids))


def test_samples(pairs: DataFrame, rqids: DataFrame) -> DataFrame:
    """(input, output, gt_semid, gt_rqid) of the test pairs whose document has an rqid."""
    rows = pairs.where(F.col("split") == "test").select("query", "doc_id").join(rqids, "doc_id")
    return rows.select(as_query(F.col("query")).alias("input"), F.col("rqid").alias("output"), F.col("doc_id").alias("gt_semid"), F.col("rqid").alias("gt_rqid"))
