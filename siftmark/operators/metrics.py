"""Retrieval and prefix metrics. All are group-bys over long tables; parameter sets such as the K values
are small tables joined in, so several K, levels or methods cost one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.operators.order import numbered

# The rank histogram's buckets.
RANK_BUCKETS = [("1", 1, 1), ("2-5", 2, 5), ("6-10", 6, 10), ("11-20", 11, 20), ("21-50", 21, 50), ("51-100", 51, 100), ("101-500", 101, 500), (">500", 501, None)]


def k_values(ks: list[int]) -> list[int]:
    """Different K values in order; all must be positive."""
    out = sorted({int(k) for k in ks})
    if not out or out[0] < 1:
        raise ValueError("K values must be positive")
    return out


def _k_table(df: DataFrame, ks: list[int]) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame([(k,) for k in k_values(ks)], "k long"))


def shared_prefix(a: Column, b: Column, levels: int) -> Column:
    """How many leading codes two arrays share, at most ``levels``; null if either is null."""
    out: Column = F.lit(0)
    for n in range(levels, 0, -1):
        out = F.when(F.get(a, F.lit(n - 1)) == F.get(b, F.lit(n - 1)), F.lit(1) + out).otherwise(F.lit(0))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(out).cast("int")


def with_shared(near: DataFrame, anchors: DataFrame, codes: DataFrame, levels: int) -> DataFrame:
    """``near`` (query, doc, rank, ...) with ``shared``, the common prefix of the anchor's codes (query,
    codes) and the document's (doc, codes), and c0, the document's first code. Rows without codes on
    either side are left out."""
    a = anchors.select("query", F.col("codes").alias("qc"))
    d = codes.select("doc", F.col("codes").alias("dc"))
    return near.join(a, "query").join(d, "doc").withColumn("shared", shared_prefix(F.col("qc"), F.col("dc"), levels)).withColumn("c0", F.get("dc", F.lit(0))).drop("qc", "dc")


def prefix_recall(near: DataFrame, ks: list[int], levels: int, by: list[str] | None = None) -> DataFrame:
    """(k, l1..lL): part of the results up to rank k that share the first l codes."""
    rows = near.join(_k_table(near, ks), F.col("rank") <= F.col("k"))
    return rows.groupBy(*(by or []), "k").agg(*(F.avg((F.col("shared") >= n).cast("int")).alias(f"l{n}") for n in range(1, levels + 1)))


def prefix_hit(near: DataFrame, ks: list[int], levels: int, by: list[str] | None = None) -> DataFrame:
    """(k, l1..lL): part of the queries with at least one such result up to rank k."""
    rows = near.join(_k_table(near, ks), F.col("rank") <= F.col("k"))
    best = rows.groupBy(*(by or []), "k", "query").agg(F.max("shared").alias("shared"))
    return best.groupBy(*(by or []), "k").agg(*(F.avg((F.col("shared") >= n).cast("int")).alias(f"l{n}") for n in range(1, levels + 1)))


def unique_first_codes(near: DataFrame, ks: list[int], by: list[str] | None = None) -> DataFrame:
    """(k, mean, median, q25, q75) of the number of different first codes up to rank k."""
    rows = near.join(_k_table(near, ks), F.col("rank") <= F.col("k"))
    per = rows.groupBy(*(by or []), "k", "query").agg(F.countDistinct("c0").alias("n"))
    q = F.percentile("n", F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75)))
    return per.groupBy(*(by or []), "k").agg(F.avg("n").alias("mean"), q.alias("q")).select(*(by or []), "k", "mean", F.col("q")[0].alias("median"), F.col("q")[1].alias("q25"), F.col("q")[2].alias("q75"))


def recall_at(ranks: DataFrame, ks: list[int]) -> DataFrame:
    """(k, gold_recall_at_k): part of the gold ranks that are at most k."""
    return ranks.select("gold_rank").join(_k_table(ranks, ks)).groupBy("k").agg(F.avg((F.col("gold_rank") <= F.col("k")).cast("int")).alias("gold_recall_at_k"))


def rank_histogram(ranks: DataFrame) -> DataFrame:
    """(bucket, count, fraction): every bucket, empty ones too; fraction is null without ranks."""
    spark = ranks.sparkSession
    table = F.broadcast(spark.createDataFrame([(i, n, lo, hi) for i, (n, lo, hi) in enumerate(RANK_BUCKETS)], "ord int, bucket string, lo long, hi long"))
    hit = ranks.select("gold_rank").join(table, (F.col("gold_rank") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("gold_rank") <= F.col("hi")))).groupBy("bucket").agg(F.count("*").alias("n"))
    total = F.broadcast(ranks.agg(F.count("*").alias("total")))
    return table.join(hit, "bucket", "left").crossJoin(total).select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("count"), F.when(F.col("total") > 0, F.coalesce("n", F.lit(0)) / F.col("total")).alias("fraction"))


def gap_summary(ranks: DataFrame) -> DataFrame:
    """(mean, median, below_001, below_005) of the top similarity less the gold one."""
    gap = F.col("top1_sim") - F.col("gold_sim")
    return ranks.select(gap.alias("gap")).agg(F.avg("gap").alias("mean"), F.percentile("gap", 0.5).alias("median"), F.avg((F.col("gap") < 0.01).cast("int")).alias("below_001"), F.avg((F.col("gap") < 0.05).cast("int")).alias("below_005"))


def bin_edges(start: float = 0.0, end: float = 1.0, width: float = 0.05) -> list[float]:
    """Edges of right-open bins; the last one is ``end`` and belongs to its bin."""
    if width <= 0 or end <= start:
        raise ValueError("need a positive width and end > start")
    n = -int(-((end - start) / width) // 1)
    return [start + i * width for i in range(n)] + [end]


def _bin_table(df: DataFrame, edges: list[float]) -> DataFrame:
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    return F.broadcast(df.sparkSession.createDataFrame(rows, "bin int, bin_left double, bin_right double"))


def bin_of(sim: Column, edges: list[float]) -> Column:
    """The bin's number, -1 below the first edge and the number of bins above the last. Counts the edges
    that are not above the value, so every value falls as the edges themselves compare."""
    n = len(edges) - 1
    at = F.size(F.filter(F.array(*(F.lit(e) for e in edges[:-1])), lambda e: e <= sim)) - 1
    return F.when(sim.isNull(), F.lit(None)).when(sim > F.lit(edges[-1]), F.lit(n)).otherwise(at).cast("int")


def consistency(pairs: DataFrame, edges: list[float], levels: int, by: list[str] | None = None) -> DataFrame:
    """([by], bin_left, bin_right, bin_mid, n_pairs, mean_similarity, l1..lL): of pairs (sim, shared) in each
    bin of similarity, the part that shares the first l codes. Every bin comes out; empty ones have nulls.
    Pairs outside of the edges are in no bin."""
    keys = by or []
    got = pairs.withColumn("bin", bin_of(F.col("sim"), edges)).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg("sim").alias("mean_similarity"), *(F.avg((F.col("shared") >= n).cast("int")).alias(f"l{n}") for n in range(1, levels + 1)))
    bins = _bin_table(pairs, edges)
    frame = pairs.select(*keys).distinct().crossJoin(bins) if keys else bins
    mid = ((F.col("bin_left") + F.col("bin_right")) / 2).alias("bin_mid")
    return frame.join(got, [*keys, "bin"], "left").select(*keys, "bin_left", "bin_right", mid, F.coalesce("n", F.lit(0)).cast("long").alias("n_pairs"), "mean_similarity", *(f"l{n}" for n in range(1, levels + 1)))


def outside(pairs: DataFrame, edges: list[float]) -> DataFrame:
    """(n_pairs, outside_low, outside_high): how many pairs no bin has."""
    b = bin_of(F.col("sim"), edges)
    return pairs.agg(F.count("*").alias("n_pairs"), F.count_if(b < 0).alias("outside_low"), F.count_if(b >= len(edges) - 1).alias("outside_high"))


def hits_at(beams: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(k, hits): part of the rows (gold, beams) whose gold identifier is among the first k beams, to four
    places; null beams or gold never hit. No rows: null."""
    hit = F.coalesce(F.array_contains(F.slice("beams", F.lit(1), F.col("k").cast("int")), F.col("gold")), F.lit(False))
    return beams.select("gold", "beams").join(_k_table(beams, list(ks))).groupBy("k").agg(F.round(F.avg(hit.cast("int")), 4).alias("hits"))


def shuffled(codes: DataFrame, seed: int, key: str = "doc") -> DataFrame:
    """The same codes dealt to other documents, one to one: two numberings by hash, joined."""
    a = numbered(codes.select(key), [F.xxhash64(key, F.lit(seed)), F.col(key)])
    b = numbered(codes, [F.xxhash64(key, F.lit(seed + 1)), F.col(key)])
    return a.join(b.select("n", "codes"), "n").select(key, "codes")


def averaged(methods: DataFrame, base: str = "random_code", key: str = "k") -> DataFrame:
    """Adds the rows ``{base}_mean``: each metric's mean over the methods ``{base}_1``, ``{base}_2``, ...; with
    fewer than two of them nothing is added."""
    values = [c for c in methods.columns if c not in ("method", key)]
    many = methods.where(F.col("method").rlike(f"^{base}_[0-9]+$"))
    mean = many.groupBy(key).agg(F.countDistinct("method").alias("m"), *(F.avg(c).alias(c) for c in values)).where("m > 1").withColumn("method", F.lit(f"{base}_mean"))
    return methods.unionByName(mean.select(methods.columns))


def dealt(codes: DataFrame, step: int = 1_000_003) -> DataFrame:
    """The same codes, document number i getting those of number (step * i + 1) mod n; one to one if ``step``
    and n are coprime."""
    at = numbered(codes.select("doc", "codes"), [F.col("doc")])
    n = at.count()
    if not n:
        return codes.select("doc", "codes")
    return at.select("doc", F.pmod(F.col("n") * step + 1, F.lit(n)).alias("m")).join(at.select(F.col("n").alias("m"), "codes"), "m").select("doc", "codes")
