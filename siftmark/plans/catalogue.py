"""Registered queries of the core. Each is one call of the operators on whole tables; the SQL that states
the same is in ``oracle``."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmark.functions.text import rqid, rqid_codes
from siftmark.operators import allpairs, ingest, knn, metrics, models, rq, sampling, samples, stats, trie
from siftmark.plans import frames, pipeline
from siftmark.plans.oracle import ORACLE
from siftmark.runtime import Scratch, table
from siftmark.sources import readers, sinks
from siftmark.streaming import ingest as stream

__all__ = ["ORACLE", "QUERIES"]
QUERIES: dict = {}
KS, LEVELS = [10, 50, 100], 4


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _self_near(spark, d, k):
    docs = frames.docs(spark, d)
    return docs, knn.top_k(docs.select(F.col("doc").alias("query"), "v", F.col("doc").alias("self")), docs, k, "self")


@query
def knn_top10(spark, d):
    return rounded(_self_near(spark, d, 10)[1], "sim")


@query
def knn_pairs(spark, d):
    return rounded(_self_near(spark, d, 100)[1].select(F.col("query").alias("i"), F.col("doc").alias("j"), "sim"), "sim")


@query
def qa_unnest(spark, d):
    return ingest.qa_pairs(table(spark, d, "raw_qa")).select("split", "line_no", F.col("pos").cast("long").alias("pos"), "query", "url", "doc_id")


@query
def doc_key_dedup(spark, d):
    return ingest.first_docs(ingest.qa_pairs(table(spark, d, "raw_qa"))).select("doc_id", "text", "split", "line_no", F.col("pos").cast("long").alias("pos"))


@query
def doc_index(spark, d):
    return ingest.with_doc_idx(ingest.first_docs(ingest.qa_pairs(table(spark, d, "raw_qa")))).select("doc_idx", "doc_id")


@query
def split_counts(spark, d):
    pairs = ingest.qa_pairs(table(spark, d, "raw_qa"))
    return ingest.split_counts(pairs, ingest.first_docs(pairs))


def _operations(spark, d):
    docs = table(spark, d, "documents").select(F.lit("train").alias("split"), F.lit(0).alias("split_ord"), F.col("doc_id").alias("line_no"), F.lit("indexing").alias("operation"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    asked = table(spark, d, "test_samples").select("split", F.when(F.col("split") == "valid", 1).otherwise(2).alias("split_ord"), F.col("query_idx").alias("line_no"), F.lit("query").alias("operation"), F.col("gt_semid").alias("doc_id"), F.col("input").alias("text"))
    return docs.unionByName(asked)


@query
def operation_extract(spark, d):
    rows = _operations(spark, d)
    docs = ingest.first_docs(ingest.operation_docs(rows)).select(F.lit("doc").alias("kind"), "split", "line_no", "doc_id", "text")
    return docs.unionByName(ingest.operation_queries(rows).select(F.lit("query").alias("kind"), "split", "line_no", "doc_id", "text"))


@query
def rq_assign(spark, d):
    got = rq.assign(frames.docs(spark, d), table(spark, d, "rq_codebooks"))
    return got.select("doc", *(F.col("codes")[i].cast("long").alias(f"c{i}") for i in range(LEVELS)))


@query
def rq_residual_norm(spark, d):
    got = rq.residual_norms(rq.assign(frames.docs(spark, d), table(spark, d, "rq_codebooks")))
    return rounded(got.withColumn("level", F.col("level").cast("long")), "mean_norm")


@query
def rq_docid_strings(spark, d):
    return rq.docids(frames.codes(spark, d))


@query
def rq_uniqueness(spark, d):
    return rounded(rq.uniqueness(table(spark, d, "semid_to_rqid")), "ratio")


@query
def rq_kmeans_codes(spark, d):
    docs = frames.docs(spark, d)
    books = rq.fit(docs, levels=LEVELS, codes=256, rounds=20)
    return rq.assign(docs, books).select("doc", rqid(F.col("codes")).alias("rqid"))


def _as_files(spark, d):
    """The raw rows as JSON line files: train and test as questions, valid in the operation format."""
    root = Scratch(spark, "files").root
    qa = table(spark, d, "raw_qa")
    for split in ("train", "test"):
        sinks.json_samples(qa.where(F.col("split") == split).select("query", "passages"), f"{root}/{split}")
    pairs = ingest.qa_pairs(qa.where("split = 'valid'"))
    rows = pairs.select(F.lit("indexing").alias("operation"), "doc_id", "text").unionByName(pairs.select(F.lit("query").alias("operation"), "doc_id", F.col("query").alias("text")))
    sinks.json_samples(rows, f"{root}/valid")
    return {s: f"{root}/{s}" for s in ("train", "valid", "test")}


@query
def files_scan(spark, d):
    """The pairs of all splits, written as JSON lines of two formats and read again."""
    return pipeline.loaded(spark, _as_files(spark, d))[1].select("split", "query", "doc_id")


@query
def files_documents(spark, d):
    """The documents of the same files, each once."""
    return pipeline.loaded(spark, _as_files(spark, d))[0].select("doc_id", "split")


@query
def files_formats(spark, d):
    """The format that is found in each file."""
    found = {s: readers.detect_format(spark, p) for s, p in _as_files(spark, d).items()}
    return spark.createDataFrame(sorted(found.items()), "split string, format string")


@query
def codes_from_ids(spark, d):
    """Codes by document where only identifiers are there."""
    ids = table(spark, d, "semid_to_rqid").where("rqid is not null").select(F.col("doc_id").alias("doc"), "rqid")
    return readers.codes(None, ids).select(F.col("doc").alias("doc_id"), F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))


@query
def rqid_parse(spark, d):
    rows = table(spark, d, "train_samples").where("output is not null")
    return rows.select("sample_id", F.array_join(rqid_codes(F.col("output")).cast("array<string>"), ",").alias("codes"))


def _doc_coded(spark, d, *codes):
    """(query, sim, rank, shared0, shared1, ..., c0): every document's nearest ones, with the codes they share in each of
    the tables ``codes``. Codes go along with the vectors, so that no pairs are shuffled."""
    docs = frames.docs(spark, d)
    for i, c in enumerate(codes):
        docs = docs.join(c.select("doc", F.col("codes").alias(f"codes{i}")), "doc", "left")
    docs = Scratch(spark, "near").keep(docs, "docs")
    asked = docs.withColumn("query", F.col("doc")).withColumnRenamed("doc", "self")
    return knn.top_k(asked, docs, max(KS), "self", levels=[LEVELS] * len(codes)).drop("doc")


def _doc_shared(spark, d):
    return _doc_coded(spark, d, frames.codes(spark, d)).withColumnRenamed("shared0", "shared")


def _kept_shared(spark, d):
    """What several passes read of them."""
    return Scratch(spark, "near").keep(_doc_shared(spark, d).select("sim", "shared"), "shared")


LS = [f"l{n}" for n in range(1, LEVELS + 1)]


@query
def doc_prefix_recall(spark, d):
    return rounded(metrics.prefix_recall(_doc_shared(spark, d), KS, LEVELS), *LS)


@query
def doc_prefix_hit(spark, d):
    return rounded(metrics.prefix_hit(_doc_shared(spark, d), KS, LEVELS), *LS)


@query
def doc_unique_l1(spark, d):
    return rounded(metrics.unique_first_codes(_doc_shared(spark, d), KS), "mean", "median", "q25", "q75")


@query
def doc_prefix_random_baseline(spark, d):
    codes = frames.codes(spark, d)
    near = _doc_coded(spark, d, *(metrics.dealt(codes, step) for step in (1_000_003, 998_244_353)))
    each = F.explode(F.array(*(F.struct(F.lit(f"random_code_{i + 1}").alias("method"), F.col(f"shared{i}").alias("shared")) for i in range(2)))).alias("m")
    out = Scratch(spark, "near").keep(metrics.prefix_recall(near.select("rank", each).select("rank", "m.*"), KS, LEVELS, ["method"]), "recall")
    return rounded(metrics.averaged(out), *LS)


def _query_near(spark, d, k, without_gold):
    docs = frames.docs(spark, d)
    asked = frames.queries(spark, d, docs)
    return docs, asked, knn.top_k(asked, docs, k, "gold" if without_gold else None)


@query
def query_topk(spark, d):
    return rounded(_query_near(spark, d, 10, False)[2], "sim")


@query
def query_topk_excl_gold(spark, d):
    return rounded(_query_near(spark, d, 10, True)[2], "sim")


def _query_shared(spark, d):
    _, asked, near = _query_near(spark, d, max(KS), False)
    return Scratch(spark, "near").keep(metrics.with_shared(near, asked.where("size(codes) > 0"), frames.codes(spark, d), LEVELS), "shared")


@query
def query_prefix_recall(spark, d):
    return rounded(metrics.prefix_recall(_query_shared(spark, d), KS, LEVELS), *LS)


@query
def query_prefix_hit(spark, d):
    return rounded(metrics.prefix_hit(_query_shared(spark, d), KS, LEVELS), *LS)


@query
def query_unique_l1(spark, d):
    return rounded(metrics.unique_first_codes(_query_shared(spark, d), KS), "mean", "median", "q25", "q75")


def _ranks(spark, d):
    docs = frames.docs(spark, d)
    return Scratch(spark, "ranks").keep(knn.gold_ranks(frames.queries(spark, d, docs), docs), "ranks")


@query
def gold_rank_per_query(spark, d):
    r = _ranks(spark, d).withColumn("top1_is_gold", (F.col("top1_doc") == F.col("gold")).cast("long")).withColumn("gap", F.col("top1_sim") - F.col("gold_sim"))
    return rounded(r, "gold_sim", "top1_sim", "top_mean", "gap")


@query
def gold_recall_at_k(spark, d):
    return rounded(metrics.recall_at(_ranks(spark, d), [1, 5, 10, 20, 50, 100, 200, 500, 1000]), "gold_recall_at_k")


@query
def gold_rank_histogram(spark, d):
    return rounded(metrics.rank_histogram(_ranks(spark, d)), "fraction")


@query
def gold_summary(spark, d):
    r = _ranks(spark, d)
    long = r.select(F.explode(F.create_map(*(x for n in ("gold_rank", "gold_sim", "top1_sim") for x in (F.lit(n), F.col(n).cast("double"))))).alias("metric", "value"))
    return rounded(stats.summary(long, F.col("value"), ["metric"]), "mean", "median", "std", "min", "p10", "q25", "q75", "p90", "p95", "max")


@query
def gold_gap_summary(spark, d):
    return rounded(metrics.gap_summary(_ranks(spark, d)), "mean", "median", "below_001", "below_005")


def _bins(df, *keys):
    return rounded(df, "bin_left", "bin_right", "bin_mid", "mean_similarity", *LS)


@query
def consistency_bins_doc(spark, d):
    return _bins(metrics.consistency(_doc_shared(spark, d), metrics.bin_edges(), LEVELS))


@query
def consistency_bins_query(spark, d):
    return _bins(metrics.consistency(_query_shared(spark, d), metrics.bin_edges(), LEVELS))


@query
def consistency_outside(spark, d):
    return metrics.outside(_doc_shared(spark, d), metrics.bin_edges(0.3, 0.9))


@query
def prefix_groups(spark, d):
    return sampling.prefix_groups(frames.codes(spark, d), LEVELS).withColumn("level", F.col("level").cast("long"))


@query
def shared_prefix_ratio(spark, d):
    rows = _doc_shared(spark, d)
    return rounded(rows.agg(F.count("*").alias("n_pairs"), *(F.avg((F.col("shared") >= n).cast("int")).alias(f"l{n}") for n in range(1, LEVELS + 1))), *LS)


@query
def group_cap(spark, d):
    size = frames.codes(spark, d).groupBy(F.slice("codes", 1, 1).alias("p")).agg(F.count("*").alias("s"))
    return sampling.group_cap(size.select((F.col("s") * (F.col("s") - 1) / 2).cast("long").alias("n_pairs")), 20_000, 5, 50_000)


@query
def pair_cosine_summary(spark, d):
    """Over all pairs of documents with codes."""
    docs = frames.docs(spark, d).join(frames.codes(spark, d), "doc")
    return rounded(allpairs.cosine_summary(docs, LEVELS), "mean", "median", "std", "q25", "q75", "ci95_low", "ci95_high")


@query
def mann_whitney(spark, d):
    rows = _kept_shared(spark, d).select(F.when(F.col("shared") > 0, "x").otherwise("y").alias("g"), "sim")
    return rounded(stats.mann_whitney(rows, F.col("g"), F.col("sim")), "u1", "u2", "u_min", "z_approx", "cliffs_delta", "cohens_d", "mean_diff")


def _semanticity(spark, d, name):
    from siftmark.plans import analyses  # noqa: PLC0415

    docs = frames.docs(spark, d)
    codes = frames.codes(spark, d).join(docs.select("doc"), "doc", "left_semi")
    n = docs.count()
    return analyses.semanticity(docs, codes, min(100_000, n * (n - 1) // 2))[name]


@query
def same_prefix_summary(spark, d):
    """Cosines of pairs with the same first codes and of random pairs, sampled as the reference does."""
    return rounded(_semanticity(spark, d, "summary"), "mean", "median", "std", "q25", "q75", "ci95_low", "ci95_high")


@query
def same_prefix_tests(spark, d):
    return rounded(_semanticity(spark, d, "significance"), "u1", "u2", "u_min", "z_approx", "cliffs_delta", "cohens_d", "mean_diff")


@query
def similarity_cdf(spark, d):
    return rounded(stats.empirical_cdf(_ranks(spark, d), F.col("top1_sim")), "value", "cdf")


@query
def sampled_pairs(spark, d):
    return sampling.same_prefix_pairs(frames.codes(spark, d), 1, 2_000)


@query
def random_pairs(spark, d):
    return sampling.random_pairs(frames.docs(spark, d), 2_000)


@query
def random_non_gold(spark, d):
    docs = frames.docs(spark, d)
    return sampling.random_docs(frames.queries(spark, d, docs), docs.count(), 3)


def _rqids(spark, d):
    return table(spark, d, "semid_to_rqid").select("doc_id", "rqid")


def _pairs(spark, d):
    """Pairs and documents of the raw rows, and the identifiers of all documents: those of the map, and for
    the raw documents, by their number, those of the code table."""
    pairs = ingest.qa_pairs(table(spark, d, "raw_qa"))
    docs = Scratch(spark, "samples").keep(ingest.with_doc_idx(ingest.first_docs(pairs)), "docs")
    own = docs.join(frames.codes(spark, d).withColumnRenamed("doc", "doc_idx"), "doc_idx").select("doc_id", rqid(F.col("codes")).alias("rqid"))
    return pairs, docs, own.unionByName(_rqids(spark, d).join(own, "doc_id", "left_anti"))


@query
def train_samples(spark, d):
    pairs, docs, ids = _pairs(spark, d)
    return samples.train_samples(pairs, docs, table(spark, d, "pseudo_queries"), ids)


@query
def test_samples(spark, d):
    pairs, _, ids = _pairs(spark, d)
    return samples.test_samples(pairs, ids)


@query
def pseudo_query_samples(spark, d):
    return samples.pseudo_samples(table(spark, d, "pseudo_queries"), _rqids(spark, d))


@query
def skipped_pairs(spark, d):
    pairs, _, ids = _pairs(spark, d)
    return samples.skipped(pairs, ids)


def _test_queries(spark, d):
    t = table(spark, d, "test_samples").where("coalesce(nullif(gt_rqid, ''), output) is not null")
    return readers.test_queries(t)


@query
def test_query_scan(spark, d):
    return _test_queries(spark, d).select("query_idx", "text", "gt_semid", "gt_rqid", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))


@query
def gold_lookup(spark, d):
    known = table(spark, d, "pseudo_queries").where("doc_id is not null").select(F.col("doc_idx").alias("doc"), "doc_id")
    asked = table(spark, d, "test_samples").select("query_idx", F.col("gt_semid")).join(known, F.col("gt_semid") == F.col("doc_id"), "left_semi")
    return readers.gold_docs(asked, known).select("query_idx", "gold")


@query
def gold_code_check(spark, d):
    """Test rows whose identifier is not that of the map: (n_rows, n_mismatches)."""
    t = table(spark, d, "test_samples").select("gt_semid", "gt_rqid").join(_rqids(spark, d).withColumnRenamed("doc_id", "gt_semid"), "gt_semid")
    return t.agg(F.count("*").alias("n_rows"), F.count_if(F.col("gt_rqid") != F.col("rqid")).alias("n_mismatches"))


def _trie(spark, d):
    return trie.edges(_rqids(spark, d).where("rqid is not null").select(rqid_codes(F.col("rqid")).alias("codes")))


def _joined(c):
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


@query
def trie_edges(spark, d):
    return _trie(spark, d).select(_joined("prefix"), F.col("next").cast("long").alias("next"))


@query
def trie_allowed(spark, d):
    codes = frames.codes(spark, d)
    asked = codes.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("codes")), lambda n: F.slice("codes", F.lit(1), n))).alias("prefix"))
    return trie.allowed(asked, _trie(spark, d)).select(_joined("prefix"), F.col("next").cast("long").alias("next"))


def _beams(spark, d):
    q = _test_queries(spark, d).select(F.col("query_idx").alias("query"), "codes")
    score = q.select("query", F.posexplode("codes").alias("level", "g"), F.expr("sequence(0, 255)").alias("c")).select("query", "level", "g", F.explode("c").alias("code"))
    score = score.select("query", "level", "code", F.round(1 / (1 + F.abs(F.col("code") - F.col("g"))), 9).alias("s"))
    return q, trie.beam_search(q, _trie(spark, d), score, LEVELS, 10)


@query
def beam_search(spark, d):
    return _beams(spark, d)[1].select("query", "rank", rqid(F.col("codes")).alias("rqid"), F.round("total", 6).alias("total"))


@query
def hits_at_k(spark, d):
    q, found = _beams(spark, d)
    lists = found.groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", rqid(F.col("codes")).alias("r")))), lambda x: x["r"]).alias("beams"))
    return metrics.hits_at(q.select("query", rqid(F.col("codes")).alias("gold")).join(lists, "query", "left"))


@query
def encode_documents(spark, d):
    return models.encode(table(spark, d, "documents"), "doc_id", "text", models.HashingEncoder()).select("doc_id", F.size("embedding").alias("dim"))


@query
def encoded_documents(spark, d):
    """The vectors themselves."""
    return models.encode(table(spark, d, "documents"), "doc_id", "text", models.HashingEncoder())


@query
def generate_pseudo_queries(spark, d):
    """How many, and the texts, with a bar between them."""
    made = models.pseudo_queries(table(spark, d, "documents"), ["doc_id"], "text", models.SpanGenerator())
    return made.select("doc_id", F.size("pseudo_queries").cast("long").alias("n"), F.array_join("pseudo_queries", "|").alias("queries"))


@query
def generated_queries(spark, d):
    """The queries themselves."""
    return models.pseudo_queries(table(spark, d, "documents"), ["doc_id"], "text", models.SpanGenerator())


@query
def stream_ingest(spark, d):
    raw = spark.readStream.schema(table(spark, d, "raw_qa").schema).parquet(f"{d}/raw_qa.parque[t]")  # a pattern, as a stream may not start from a file
    root = Scratch(spark, "stream").root
    stream.write(stream.documents(raw), f"{root}/docs", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/docs").select("doc_id")
