"""Sources: JSON lines and documents, splits, codes, test queries, maps, matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.functions.text import py_strip, query_text, rqid_codes

QA = "query STRING, passages STRUCT<passage_text: ARRAY<STRING>, is_selected: ARRAY<STRING>, url: ARRAY<STRING>>"
OPERATION = "operation STRING, doc_id STRING, text STRING"
SPLITS = ("train", "valid", "test")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(line_no, fields of ``schema``) of a UTF-8 file of JSON objects, one a line. Lines of white space are
    skipped; a line that is no JSON object fails the read. Numbers follow the lines' order."""
    lines = spark.read.text(path, wholetext=False).withColumn("n", F.monotonically_increasing_id())
    lines = lines.where(py_strip(F.col("value")) != "")
    # without this mode a broken line would come out as nulls
    parsed = lines.select(F.col("n").alias("line_no"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("j"), "value")
    if schema == QA:
        raw = F.get_json_object("value", "$.passages.is_selected")
        parsed = parsed.withColumn("j", F.col("j").withField("passages", F.when(F.col("j.passages").isNotNull(), F.col("j.passages").withField("is_selected", _flags(raw)))))
    return parsed.select("line_no", "j.*")


def _flags(raw: Column) -> Column:
    """Strings of a JSON list of flags by their types, as ``functions.text.is_positive`` takes them: a number that
    truncates to 1 is ``1``, another ``0``; a string stays as it is; what is neither, nor a boolean, is null."""
    each = F.from_json(raw, "array<variant>", {"mode": "PERMISSIVE"})

    def one(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        number = F.try_variant_get(v, "$", "double")
        as_number = F.when((number >= 1) & (number < 2), "1").otherwise("0")
        return F.when(v.isNull() | (kind == "VOID") | kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.lit(None)).when(kind.isin("STRING", "BOOLEAN"), F.try_variant_get(v, "$", "string")).otherwise(as_number)

    return F.transform(each, one)


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (r.schema(schema) if schema else r).json(path)


def detect_format(spark: SparkSession, path: str) -> str:
    """``operation``, ``qa`` or ``unknown``, by the first line that has either signature: operation and text
    fields, or query and passages. Lines that are no objects say nothing."""
    raw = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    keys = F.json_object_keys("value")
    op, qa = F.array_contains(keys, "operation"), F.array_contains(keys, "query") & F.array_contains(keys, "passages")
    first = raw.select("n", F.when(op, "operation").when(qa, "qa").alias("f")).where("f is not null").agg(F.min_by("f", "n").alias("f")).first()
    return first.f or "unknown"


def splits(spark: SparkSession, paths: dict[str, str]) -> tuple[dict[str, str], dict[str, DataFrame]]:
    """(format of each split, rows of each format with split and split_ord), the splits in the order of ``paths``.
    Splits may have different formats; one of unknown format gives no rows. Both formats are keys of the rows."""
    found = {name: detect_format(spark, p) for name, p in paths.items()}
    rows = {}
    for kind, schema in (("operation", OPERATION), ("qa", QA)):
        rows[kind] = spark.createDataFrame([], f"line_no LONG, {schema}, split STRING, split_ord INT")
        for i, (s, p) in enumerate(paths.items()):
            if found[s] == kind:
                rows[kind] = rows[kind].unionByName(json_lines(spark, p, schema).withColumns({"split": F.lit(s), "split_ord": F.lit(i)}))
    return found, rows


def qa_corpus(corpus: DataFrame) -> DataFrame:
    """Rows of the operation format from (corpus ARRAY<STRING>, queries ARRAY<STRUCT<text, doc_id, split>>):
    the position in the corpus is the doc_id, and the whole corpus stands in each split."""
    docs = corpus.select(F.posexplode("corpus").alias("p", "text")).select(F.lit("indexing").alias("operation"), F.col("p").cast("string").alias("doc_id"), "text")
    each = docs.crossJoin(F.broadcast(corpus.sparkSession.createDataFrame([(s, i) for i, s in enumerate(SPLITS)], "split string, split_ord int")))
    q = corpus.select(F.explode("queries").alias("q")).select(F.lit("query").alias("operation"), F.col("q.doc_id").cast("string").alias("doc_id"), F.col("q.text").alias("text"), F.col("q.split").alias("split"))
    q = q.withColumn("split_ord", F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split")).cast("int") - 1)
    return each.unionByName(q)


def matrix(spark: SparkSession, path: str, key: str = "doc_idx") -> DataFrame:
    """(key, embedding ARRAY<FLOAT>) of a 2-D .npy file on the driver, memory-mapped and sent as Arrow tables of
    65,536 rows."""
    m = np.load(path, mmap_mode="r")
    if m.ndim != 2:
        raise ValueError(f"{path}: expected two dimensions, found {m.ndim}")
    schema = pa.schema([(key, pa.int64()), ("embedding", pa.list_(pa.float32()))])
    parts = []
    for s in range(0, len(m), 65_536):
        x = np.ascontiguousarray(m[s : s + 65_536], np.float32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        parts.append(pa.table([pa.array(np.arange(s, s + len(x))), lists], schema=schema))
    return spark.createDataFrame(pa.concat_tables(parts) if parts else schema.empty_table())


def json_map(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """Two columns of a JSON object of strings."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})).alias(key, value))


def codes(table: DataFrame | None, ids: DataFrame | None) -> DataFrame:
    """(doc, codes) from a table (doc, codes), or else from identifiers (doc, rqid). Neither, no rows or
    different widths are errors."""
    if table is not None:
        out = table.select("doc", "codes")
    elif ids is not None:
        out = ids.select("doc", rqid_codes(F.col("rqid")).alias("codes"))
    else:
        raise ValueError("neither codes nor identifiers")
    widths = [r[0] for r in out.select(F.size("codes")).distinct().limit(2).collect()]
    if len(widths) != 1:
        raise ValueError("no codes" if not widths else "codes of different widths")
    return out


def test_queries(rows: DataFrame, max_queries: int = -1, keep_prefix: bool = False) -> DataFrame:
    """(query_idx, text, gt_semid, gt_rqid, codes): the first ``max_queries`` rows, all if it is not positive.
    gt_rqid is output where it is null or empty, a missing gt_semid is empty. No rows are an error."""
    r = rows.where(F.col("query_idx") < max_queries) if max_queries > 0 else rows
    gt = F.coalesce(F.nullif(F.col("gt_rqid"), F.lit("")), F.col("output"))
    out = r.select("query_idx", query_text(F.col("input"), keep_prefix).alias("text"), F.coalesce("gt_semid", F.lit("")).alias("gt_semid"), gt.alias("gt_rqid"))
    if out.isEmpty():
        raise ValueError("no test queries")
    return out.withColumn("codes", rqid_codes(F.col("gt_rqid")))


def gold_docs(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``queries`` (gt_semid) with gold, the doc of ``docs`` (doc, doc_id); a miss is an error that tells how
    many there are and the least of them."""
    missing = queries.join(docs, queries.gt_semid == docs.doc_id, "left_anti").agg(F.count("*").alias("n"), F.min("gt_semid").alias("first")).first()
    if missing.n:
        raise ValueError(f"{missing.n} gold documents are unknown, such as {missing.first!r}")
    return queries.join(docs.select(F.col("doc").alias("gold"), F.col("doc_id").alias("gt_semid")), "gt_semid")
