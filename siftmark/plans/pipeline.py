"""From files to training data in one call: documents and pairs of the splits, vectors, identifiers, pseudo-queries,
samples. Every step can be called alone; each writes its table before the next one starts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.functions.text import rqid
from siftmark.functions.vectors import normalised
from siftmark.operators import ingest, models, rq, samples
from siftmark.operators.sampling import shuffle
from siftmark.sources import readers, sinks


@dataclass
class Settings:
    """Parameters of ``run``; the defaults are those of the published configuration."""

    levels: int = 4
    codes: int = 256
    rounds: int = 20
    queries: int = 5
    seed: int = 42
    encoder: models.Encoder = field(default_factory=models.HashingEncoder)
    generator: models.Generator = field(default_factory=models.SpanGenerator)


def loaded(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """(documents, queries, formats): every document once, the first by split, line and position, with doc_idx; and
    the queries (split, split_ord, line_no, pos, query, doc_id) of all splits, whatever the format of each."""
    formats, rows = readers.splits(spark, paths)
    qa, op = ingest.qa_pairs(rows["qa"]), rows["operation"]
    cols = ["split", "split_ord", "line_no", "pos", "doc_id", "text"]
    docs = ingest.first_docs(qa.select(*cols).unionByName(ingest.operation_docs(op).select(*cols)))
    asked = ingest.operation_queries(op).withColumnRenamed("text", "query")
    cols = ["split", "split_ord", "line_no", "pos", "query", "doc_id"]
    return ingest.with_doc_idx(docs), qa.select(*cols).unionByName(asked.select(*cols)), formats


def run(spark: SparkSession, paths: dict[str, str], out: str, settings: Settings | None = None) -> dict[str, DataFrame]:
    """Runs all steps on the JSON line files of ``paths`` (split: path) and returns the tables by name.

    Below ``out``: docs, queries, embeddings, codebooks, codes, semid_to_rqid, pseudo_queries as Parquet, train and
    test as JSON lines. Training samples are the queries of all splits but ``test``, all documents and all
    pseudo-queries, in an order by hash; test samples are the queries of ``test``. Queries whose document has no
    identifier are left out. Files without usable rows give empty tables.
    """
    s = settings or Settings()
    done: dict[str, DataFrame] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        sinks.parquet(df, f"{out}/{name}")
        done[name] = spark.read.schema(df.schema).parquet(f"{out}/{name}")
        return done[name]

    docs, queries, _ = loaded(spark, paths)
    docs, queries = keep("docs", docs), keep("queries", queries)
    vectors = models.encode(docs, "doc_idx", "text", s.encoder)
    unit = keep("embeddings", vectors.select("doc_idx", normalised(F.col("embedding")).cast("array<float>").alias("embedding")))
    points = unit.select(F.col("doc_idx").alias("doc"), F.col("embedding").alias("v"))
    books = keep("codebooks", rq.fit(points, s.levels, s.codes, s.rounds, s.seed))
    codes = keep("codes", rq.assign(points, books).select(F.col("doc").alias("doc_idx"), "codes"))
    ids = keep("semid_to_rqid", docs.select("doc_idx", "doc_id").join(codes, "doc_idx").select("doc_id", rqid(F.col("codes")).alias("rqid")))
    pseudo = keep("pseudo_queries", models.pseudo_queries(docs, ["doc_idx", "doc_id"], "text", s.generator, s.queries))
    other = queries.where("split <> 'test'").withColumn("split", F.lit("train"))
    train = shuffle(samples.train_samples(other, docs, pseudo, ids).withColumn("k", F.concat_ws("\n", "input", "output")), "k", s.seed).drop("k")
    test = samples.test_samples(queries, ids)
    for name, df in (("train", train), ("test", test)):
        sinks.json_samples(df, f"{out}/{name}")
        done[name] = spark.read.schema(df.schema).json(f"{out}/{name}")
    return done
