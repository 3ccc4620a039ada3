"""Incremental ingest: JSON lines as a stream, each document once.

First means first by arrival here, not by split, line and position as in the batch operators: a stream
can't wait for an earlier line. Within one micro-batch the batch order holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftmark.operators.ingest import qa_pairs
from siftmark.sources.readers import QA


def read(spark: SparkSession, folder: str, schema: str = f"split STRING, split_ord INT, line_no LONG, {QA}", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def documents(stream: DataFrame) -> DataFrame:
    """(doc_id, text, url, split, line_no, pos): every document when it first arrives. The state holds one
    key for each document; bound it with a watermark on an arrival time where the sources allow."""
    return qa_pairs(stream).select("doc_id", "text", "url", "split", "line_no", "pos").dropDuplicates(["doc_id"])


def write(docs: DataFrame, path: str, checkpoint: str):
    """A query that appends new documents to Parquet until all that is there is read."""
    return docs.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
