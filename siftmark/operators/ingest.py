"""Raw rows to documents and queries, first occurrence wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.functions.text import doc_key, is_blank, is_positive, py_strip
from siftmark.operators.order import numbered


def _flag_kind(raw: DataFrame) -> str:
    return raw.select(F.col("passages.is_selected").alias("f")).schema["f"].dataType.elementType.simpleString()


def qa_pairs(raw: DataFrame) -> DataFrame:
    """(split, split_ord, line_no, pos, query, text, url, doc_id): the selected passages of question rows.

    Rows with a null or blank query are left out, as are passages that are null or blank or not selected;
    a missing flag is not selected, a missing url is null. The query comes out stripped, the passage as
    it is. Nested columns beside the three lists are not read.
    """
    p = F.transform(F.sequence(F.lit(0), F.size("passages.passage_text") - 1), lambda i: F.struct(F.get("passages.passage_text", i).alias("t"), F.get("passages.is_selected", i).alias("f"), F.get("passages.url", i).alias("u")))
    kept = raw.where(~is_blank(F.col("query")) & (F.size("passages.passage_text") > 0))
    rows = kept.select("split", "split_ord", "line_no", py_strip(F.col("query")).alias("query"), F.posexplode(p).alias("pos", "p"))
    rows = rows.where(is_positive(F.col("p.f"), _flag_kind(raw)) & ~is_blank(F.col("p.t")))
    return rows.select("split", "split_ord", "line_no", "pos", "query", F.col("p.t").alias("text"), F.col("p.u").alias("url"), doc_key(F.col("p.t"), F.col("p.u")).alias("doc_id"))


def operation_docs(raw: DataFrame) -> DataFrame:
    """(split, split_ord, line_no, pos, doc_id, text) of the rows whose operation is ``indexing``."""
    return _operation(raw, "indexing")


def operation_queries(raw: DataFrame) -> DataFrame:
    """(split, split_ord, line_no, pos, doc_id, text) of the rows whose operation is ``query``."""
    return _operation(raw, "query")


def _operation(raw: DataFrame, name: str) -> DataFrame:
    rows = raw.where((F.col("operation") == name) & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return rows.select("split", "split_ord", "line_no", F.lit(0).alias("pos"), "doc_id", "text")


def first_docs(rows: DataFrame) -> DataFrame:
    """(doc_id, text, split, split_ord, line_no, pos): of each doc_id the first row by split, line and
    position. One aggregate with partial minima: a document that occurs in a third of all rows is not
    gathered anywhere. Ties: the smaller text."""
    first = F.min(F.struct("split_ord", "line_no", "pos", "text", "split")).alias("f")
    return rows.groupBy("doc_id").agg(first).select("doc_id", "f.text", "f.split", "f.split_ord", "f.line_no", "f.pos")


def with_doc_idx(docs: DataFrame) -> DataFrame:
    """Adds doc_idx, dense from 0 in order of split, line and position."""
    return numbered(docs, [F.col(c) for c in ("split_ord", "line_no", "pos", "doc_id")], "doc_idx")


def split_counts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(split, n_queries, n_docs): pairs of each split, and documents that came first in it."""
    q = pairs.groupBy("split").agg(F.count("*").alias("n_queries"))
    d = docs.groupBy("split").agg(F.count("*").alias("n_docs"))
    return q.join(d, "split", "full").select("split", F.coalesce("n_queries", F.lit(0)).cast("long").alias("n_queries"), F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"))
