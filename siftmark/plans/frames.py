"""The inputs of the analyses, from the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.functions.vectors import normalised, usable
from siftmark.operators import models
from siftmark.operators.order import numbered
from siftmark.runtime import Scratch, table
from siftmark.sources import readers

DIM = 64


def docs(spark: SparkSession, d: str) -> DataFrame:
    """(doc, v): unit vectors of the usable rows, one for each document, written once."""
    rows = table(spark, d, "doc_embeddings").where(usable(F.col("embedding"), DIM) & F.col("doc_idx").isNotNull())
    one = rows.groupBy("doc_idx").agg(F.min("embedding").alias("e"))
    return Scratch(spark, "frames").keep(one.select(F.col("doc_idx").alias("doc"), normalised(F.col("e")).alias("v")), "docs")


def codes(spark: SparkSession, d: str) -> DataFrame:
    """(doc, codes): one list for each document that has one."""
    return table(spark, d, "rq_codes").where("codes is not null").groupBy(F.col("doc_idx").alias("doc")).agg(F.min("codes").alias("codes"))


def encoded_queries(rows: DataFrame, docs: DataFrame, encoder: models.Encoder, instruction: str = "", max_queries: int = -1, keep_prefix: bool = False, cache: str | None = None, recompute: bool = False) -> DataFrame:
    """(query, v, gold, codes, gt_semid): what the query reports take, from test rows (query_idx, input, output,
    gt_semid, gt_rqid) and documents (doc, doc_id).

    The first ``max_queries`` rows, all if it is not positive; texts without their leading mark unless
    ``keep_prefix``; ``instruction`` goes before each text. With ``cache`` the vectors are kept there and used
    again if there are enough of them, unless ``recompute``. An unknown gold document is an error.
    """
    spark = rows.sparkSession
    asked = readers.gold_docs(readers.test_queries(rows, max_queries, keep_prefix), docs)

    def make() -> DataFrame:
        return models.encode(asked, "query_idx", "text", encoder, instruction)

    if not cache:
        vectors = make()
    elif recompute:
        make().write.mode("overwrite").parquet(cache)
        vectors = spark.read.parquet(cache)
    else:
        vectors = models.cached(spark, cache, asked.count(), make, False)
    met = asked.join(vectors, "query_idx")
    return met.select(F.col("query_idx").alias("query"), normalised(F.col("embedding")).alias("v"), "gold", "codes", "gt_semid")


def queries(spark: SparkSession, d: str, all_docs: DataFrame) -> DataFrame:
    """(query, v, gold, codes): test rows whose gold document is known and has a vector.

    There are no query vectors in the tables: a query's is its gold document's, more or less of it by the
    query's number, and another document's, and then normalised.
    """
    known = table(spark, d, "pseudo_queries").where("doc_id is not null").groupBy("doc_id").agg(F.min("doc_idx").alias("gold"))
    at = numbered(all_docs, [F.col("doc")])
    n = at.count()
    t = table(spark, d, "test_samples").select(F.col("query_idx").alias("query"), F.col("gt_semid").alias("doc_id"), F.coalesce("gt_rqid", "output").alias("r"))
    t = t.join(known, "doc_id").join(at.select(F.col("doc").alias("gold"), F.col("n"), F.col("v").alias("g")), "gold")
    t = t.withColumn("n", F.pmod(7 * F.col("n") + 1, F.lit(n))).join(at.select("n", F.col("v").alias("h")), "n")
    w = F.pmod(F.col("query"), F.lit(5)) / 4
    mixed = F.zip_with("g", "h", lambda a, b: w * a + b)
    out = t.select("query", mixed.alias("m"), "gold", F.regexp_extract_all("r", F.lit(r"<r[0-9]+_([0-9]+)>"), F.lit(1)).cast("array<int>").alias("codes"))
    return Scratch(spark, "frames").keep(out.select("query", normalised(F.col("m")).alias("v"), "gold", "codes"), "queries")
