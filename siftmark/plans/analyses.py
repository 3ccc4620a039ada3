"""The six reports as functions: each takes DataFrames and returns small result tables by name.

Common inputs: docs (doc, v) unit vectors, codes (doc, codes), queries (query, v, gold, codes). All checks
of parameters raise ValueError before any work is done. Similarity tables that several metrics read are
written once to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.operators import knn, metrics, sampling, stats
from siftmark.operators.metrics import k_values
from siftmark.runtime import Scratch

# Default parameters of the reports.
RECALL_KS = (1, 5, 10, 20, 50, 100, 200, 500, 1000)
PREFIX_KS = (10, 50, 100)


def _check_k(k: int, n_docs: int, least: int = 1) -> None:
    if not least <= k < n_docs:
        raise ValueError(f"k must be at least {least} and less than the {n_docs} documents, not {k}")


def _width(codes: DataFrame, levels: int) -> int:
    if levels < 1:
        raise ValueError("levels must be positive")
    widths = [r[0] for r in codes.select(F.size("codes")).distinct().limit(2).collect()]
    if len(widths) != 1:
        raise ValueError("codes must have one width")
    return min(levels, widths[0])


def _gold_width(queries: DataFrame, levels: int) -> int:
    """``levels``, or as many as the shortest gold codes have."""
    least = queries.agg(F.min(F.size("codes"))).first()[0]
    return levels if least is None or least < 1 else min(levels, least)


def _named(df: DataFrame, method: str) -> DataFrame:
    return df.select(F.lit(method).alias("method"), *df.columns)


def _methods(codes: DataFrame, runs: int, seed: int, real: str) -> dict[str, DataFrame]:
    out = {real: codes}
    for i in range(runs):
        out["random_code" if runs == 1 else f"random_code_{i + 1}"] = metrics.shuffled(codes, seed + 2 * i)
    return out


def _contract(ranks: DataFrame, queries: DataFrame) -> DataFrame:
    """The report of single queries under its published column names; gt_semid is null if ``queries`` lacks it."""
    semid = F.col("gt_semid") if "gt_semid" in queries.columns else F.lit(None).cast("string")
    rows = ranks.join(queries.select("query", semid.alias("gt_semid")), "query")
    mean = F.col("random_mean") if "random_mean" in ranks.columns else F.lit(None).cast("double")
    return rows.select(F.col("query").alias("query_index"), "gt_semid", F.col("gold").alias("gt_doc_index"), "gold_rank", F.col("gold_sim").alias("gold_similarity"), F.col("top1_doc").alias("top1_doc_index"), F.col("top1_sim").alias("top1_similarity"), "top1_is_gold", F.col("gap").alias("top1_minus_gold_gap"), F.col("top_mean").alias("top_non_gold_mean_similarity"), mean.alias("random_mean_similarity"))


def gold_rank(queries: DataFrame, docs: DataFrame, recall_ks=RECALL_KS, top_n: int = 10, random_docs: int = 1, seed: int = 42) -> dict[str, DataFrame]:
    """Where the gold documents stand: ranks, recall, histogram, summary, gap."""
    n = docs.count()
    ks = k_values(list(recall_ks))
    if ks[-1] > n:
        raise ValueError(f"K of {ks[-1]} with {n} documents")
    _check_k(top_n, n)
    scratch = Scratch(docs.sparkSession, "gold")
    ranks = knn.gold_ranks(queries, docs, top_n)
    if random_docs > 0:
        from siftmark.functions.vectors import dot
        from siftmark.operators.order import numbered

        at = numbered(docs.select("doc", "v"), [F.col("doc")])
        q = queries.select("query", "v", "gold").join(at.select(F.col("doc").alias("gold"), F.col("n").alias("g")), "gold")
        drawn = sampling.random_docs(q.select("query", F.col("g").alias("gold")), n, random_docs, seed)
        met = drawn.join(at.select(F.col("n").alias("doc"), F.col("v").alias("w")), "doc").join(q.select("query", "v"), "query")
        ranks = ranks.join(met.groupBy("query").agg(F.avg(dot(F.col("v"), F.col("w"))).alias("random_mean")), "query", "left")
    ranks = ranks.withColumn("top1_is_gold", (F.col("top1_doc") == F.col("gold")).cast("int")).withColumn("gap", F.col("top1_sim") - F.col("gold_sim"))
    ranks = scratch.keep(ranks, "ranks")
    values = [c for c in ("gold_rank", "gold_sim", "top1_sim", "top_mean", "random_mean", "gap") if c in ranks.columns]
    long = ranks.select(F.explode(F.create_map(*(x for c in values for x in (F.lit(c), F.col(c).cast("double"))))).alias("metric", "value"))
    return {"per_query": _contract(ranks, queries), "ranks": ranks, "recall": metrics.recall_at(ranks, ks), "histogram": metrics.rank_histogram(ranks), "summary": stats.summary(long, F.col("value"), ["metric"]), "gap": metrics.gap_summary(ranks)}


def _prefix(near: DataFrame, anchors: DataFrame, methods: dict[str, DataFrame], ks, levels: int, anchor_codes: bool) -> dict[str, DataFrame]:
    parts: dict[str, list[DataFrame]] = {"recall": [], "hit": [], "unique_l1": []}
    scratch = Scratch(near.sparkSession, "prefix")
    for name, codes in methods.items():
        a = anchors if anchor_codes else codes.withColumnRenamed("doc", "query")
        rows = scratch.keep(metrics.with_shared(near, a, codes, levels), "shared")
        parts["recall"].append(_named(metrics.prefix_recall(rows, ks, levels), name))
        parts["hit"].append(_named(metrics.prefix_hit(rows, ks, levels), name))
        parts["unique_l1"].append(_named(metrics.unique_first_codes(rows, ks), name))
    return {k: reduce(DataFrame.unionByName, v) for k, v in parts.items()}


def query_prefix(queries: DataFrame, docs: DataFrame, codes: DataFrame, ks=PREFIX_KS, levels: int = 4, exclude_gold: bool = False) -> dict[str, DataFrame]:
    """How the codes of a query's most similar documents begin, against its gold codes."""
    ks, levels = k_values(list(ks)), _gold_width(queries, _width(codes, levels))
    _check_k(ks[-1], docs.count())
    near = Scratch(docs.sparkSession, "near").keep(knn.top_k(queries, docs, ks[-1], "gold" if exclude_gold else None), "near")
    return _prefix(near, queries, {"query": codes}, ks, levels, True)


def neighbour_prefix(docs: DataFrame, codes: DataFrame, ks=PREFIX_KS, levels: int = 4, anchor_docs: int = -1, baselines: int = 1, seed: int = 42) -> dict[str, DataFrame]:
    """The same for documents and their neighbours, with shuffled codes as a baseline."""
    if baselines < 1:
        raise ValueError("at least one baseline")
    ks, levels = k_values(list(ks)), _width(codes, levels)
    _check_k(ks[-1], docs.count())
    own = docs.join(sampling.anchors(docs, anchor_docs, seed), "doc") if anchor_docs > 0 else docs
    asked = own.select(F.col("doc").alias("query"), "v", F.col("doc").alias("self"))
    near = Scratch(docs.sparkSession, "near").keep(knn.top_k(asked, docs, ks[-1], "self"), "near")
    out = _prefix(near, asked, _methods(codes, baselines, seed, "rq"), ks, levels, False)
    return {k: metrics.averaged(v) for k, v in out.items()}


def _consistency(near: DataFrame, anchors: DataFrame | None, methods: dict[str, DataFrame], edges: list[float], levels: int) -> dict[str, DataFrame]:
    scratch = Scratch(near.sparkSession, "consistency")
    parts = []
    for name, codes in methods.items():
        rows = metrics.with_shared(near, anchors if anchors is not None else codes.withColumnRenamed("doc", "query"), codes, levels)
        parts.append(rows.select(F.lit(name).alias("method"), "sim", "shared"))
    rows = scratch.keep(reduce(DataFrame.unionByName, parts), "methods")
    outside = metrics.outside(rows, edges)
    return {"bins": metrics.consistency(rows, edges, levels, ["method"]), "outside": outside}


def document_consistency(docs: DataFrame, codes: DataFrame, k: int = 100, levels: int = 4, anchor_docs: int = -1, baselines: int = 1, bins=(0.0, 1.0, 0.05), seed: int = 42) -> dict[str, DataFrame]:
    """How often similar documents share codes, by similarity. k of 0 gives empty bins."""
    edges, levels = metrics.bin_edges(*bins), _width(codes, levels)
    if baselines < 0:
        raise ValueError("baselines must not be negative")
    own = docs.join(sampling.anchors(docs, anchor_docs, seed), "doc") if anchor_docs > 0 else docs
    asked = own.select(F.col("doc").alias("query"), "v", F.col("doc").alias("self"))
    if k > 0:
        _check_k(k, docs.count())
    near = knn.top_k(asked if k > 0 else asked.limit(0), docs, max(k, 1), "self")
    near = Scratch(docs.sparkSession, "near").keep(near, "near")
    return _consistency(near, None, _methods(codes, baselines, seed, "rq"), edges, levels)


def query_consistency(queries: DataFrame, docs: DataFrame, codes: DataFrame, k: int = 100, levels: int = 4, exclude_gold: bool = False, baselines: int = 1, bins=(0.0, 1.0, 0.05), seed: int = 42) -> dict[str, DataFrame]:
    """The same from queries to documents. A gold document whose codes differ from the query's is an error."""
    edges, levels = metrics.bin_edges(*bins), _gold_width(queries, _width(codes, levels))
    _check_k(k, docs.count())
    wrong = queries.select("gold", F.col("codes").alias("q")).join(codes.select(F.col("doc").alias("gold"), "codes"), "gold").where("q <> codes").count()
    if wrong:
        raise ValueError(f"{wrong} queries have other codes than their gold document")
    near = Scratch(docs.sparkSession, "near").keep(knn.top_k(queries, docs, k, "gold" if exclude_gold else None), "near")
    out = []
    for name, own in _methods(codes, baselines, seed, "rq").items():
        gold = own.select(F.col("doc").alias("gold"), F.col("codes"))
        a = queries.select("query", "gold").join(gold, "gold").select("query", "codes")
        out.append(metrics.with_shared(near, a, own, levels).select(F.lit(name).alias("method"), "sim", "shared"))
    rows = Scratch(docs.sparkSession, "consistency").keep(reduce(DataFrame.unionByName, out), "methods")
    return {"bins": metrics.consistency(rows, edges, levels, ["method"]), "outside": metrics.outside(rows, edges)}


def semanticity(docs: DataFrame, codes: DataFrame, target: int = 100_000, base_cap: int = 500, hard_cap: int = 50_000, levels: int = 4, seed: int = 42) -> dict[str, DataFrame]:
    """Similarities of random pairs and of pairs with the same first codes, and how they differ. A level
    without pairs has a row of nulls in the tests."""
    from siftmark.functions.vectors import dot

    levels = _width(codes, levels)
    scratch = Scratch(docs.sparkSession, "semanticity")
    parts = [sampling.random_pairs(docs, target, seed).withColumn("pair_type", F.lit("random_all"))]
    parts += [sampling.same_prefix_pairs(codes, n, target, base_cap, hard_cap, seed + n).withColumn("pair_type", F.lit(f"same_l{n}")) for n in range(1, levels + 1)]
    pairs = reduce(DataFrame.unionByName, parts)
    a, b = docs.select(F.col("doc").alias("a"), F.col("v").alias("va")), docs.select(F.col("doc").alias("b"), F.col("v").alias("vb"))
    sims = scratch.keep(pairs.join(a, "a").join(b, "b").select("pair_type", dot(F.col("va"), F.col("vb")).alias("sim")), "sims")
    tests = [("same_l1", "random_all")] + [(f"same_l{n}", f"same_l{n - 1}") for n in range(2, levels + 1)]
    rows = []
    for left, right in tests:
        two = sims.where(F.col("pair_type").isin(left, right)).select(F.when(F.col("pair_type") == left, "x").otherwise("y").alias("g"), "sim")
        r = stats.with_p(stats.mann_whitney(two, F.col("g"), F.col("sim")))
        rows.append(r.select(F.lit(left).alias("left"), F.lit(right).alias("right"), *r.columns))
    groups = sampling.prefix_groups(codes, levels)
    return {"summary": stats.summary_ci(sims, F.col("sim"), ["pair_type"]), "significance": reduce(DataFrame.unionByName, rows), "groups": groups}
