"""Samples that do not depend on partitioning: all choices come from hashes of keys and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmark.operators.order import numbered

#: Parts of a group whose documents are numbered.
SALTS = 64


def anchors(docs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` documents (doc) without replacement; all if ``n`` is not between 1 and their number."""
    one = docs.select("doc")
    return one if n <= 0 else one.orderBy(F.xxhash64("doc", F.lit(seed)), "doc").limit(n)


def shuffle(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key)


def random_docs(queries: DataFrame, n_docs: int, per_query: int, seed: int = 42) -> DataFrame:
    """(query, r, doc): positions 0 to ``n_docs`` - 1 drawn with replacement; one that is the query's gold
    position is moved to the next, the last to 0."""
    if n_docs < 2:
        raise ValueError("need at least two documents")
    r = queries.select("query", "gold", F.explode(F.sequence(F.lit(0), F.lit(per_query - 1))).alias("r"))
    d = F.pmod(F.xxhash64("query", "r", F.lit(seed)), F.lit(n_docs))
    return r.withColumn("doc", F.when(d == F.col("gold"), F.pmod(d + 1, F.lit(n_docs))).otherwise(d)).select("query", "r", "doc")


def prefix_groups(codes: DataFrame, levels: int) -> DataFrame:
    """(level, n_groups_total, n_groups_valid, n_pairs) of documents with the same first codes."""
    rows = codes.select(F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level"), "codes")
    size = rows.groupBy("level", F.slice("codes", F.lit(1), F.col("level")).alias("prefix")).agg(F.count("*").alias("s"))
    return size.groupBy("level").agg(F.count("*").alias("n_groups_total"), F.count_if(F.col("s") >= 2).alias("n_groups_valid"), F.sum((F.col("s") * (F.col("s") - 1) / 2).cast("long")).alias("n_pairs"))


def caps(base: int, hard: int) -> list[int]:
    """The caps that are tried: doubled from ``base`` until ``hard`` is reached."""
    cap, top = max(1, base), max(base, hard, 1)
    out = [cap]
    while cap < top:
        cap = min(cap * 2, top)
        out.append(cap)
    return out


def group_cap(groups: DataFrame, target: int, base: int, hard: int) -> DataFrame:
    """(cap, total): the first cap at which the groups' pairs (n_pairs), each cut at it, reach ``target``,
    or the last one. All caps are tried in one pass."""
    tried = caps(base, hard)
    sums = groups.agg(*(F.coalesce(F.sum(F.least(F.col("n_pairs"), F.lit(c))), F.lit(0)).cast("long").alias(f"c{i}") for i, c in enumerate(tried)))
    ok = F.filter(F.array(*(F.struct(F.lit(c).cast("long").alias("cap"), F.col(f"c{i}").alias("total")) for i, c in enumerate(tried))), lambda x: (x["total"] >= target) | (x["cap"] == tried[-1]))
    return sums.select(F.get(ok, F.lit(0)).alias("x")).select("x.cap", "x.total")


def _unranked(n: Column, p: Column) -> tuple[Column, Column]:
    """The p-th pair (i < j) of n items: p in 0 .. n(n-1)/2 - 1, counted by j."""
    j = F.floor((1 + F.sqrt(1 + 8 * p.cast("double"))) / 2).cast("long")
    j = F.when(j * (j - 1) / 2 > p, j - 1).when((j + 1) * j / 2 <= p, j + 1).otherwise(j)
    return p - (j * (j - 1) / 2).cast("long"), j


def _drawn(groups: DataFrame, take: Column, total: Column, seed: int) -> DataFrame:
    """Rows of ``groups`` with p: ``take`` different numbers below ``total``, one from each of ``take`` parts of about
    equal size, by the hash of its place. A group that is taken whole lists all."""
    listed = groups.withColumn("take", take.cast("long")).withColumn("total", total.cast("long")).where("take > 0")
    rows = listed.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("take") - 1)))
    base, more = F.expr("total div take"), F.col("total") % F.col("take")
    size = base + (F.col("r") < more).cast("long")
    first = F.col("r") * base + F.least(F.col("r"), more)
    return rows.withColumn("p", first + F.pmod(F.xxhash64("g", "r", F.lit(seed)), size))


def random_pairs(docs: DataFrame, target: int, seed: int = 42, codes: DataFrame | None = None) -> DataFrame:
    """(a, b): ``target`` different unordered pairs of documents, a before b in the order of hashes. With ``codes``
    (doc, codes) only pairs whose first codes differ.

    Fails if there are fewer pairs. Pair numbers are drawn, then unranked; no list of pairs is made. Where codes
    must differ, more are drawn by as much as pairs have equal ones.
    """
    if codes is not None:
        first = codes.select("doc", F.col("codes")[0].alias("c"))
        all_ = docs.select("doc").join(first, "doc")
        s = all_.groupBy("c").agg(F.count("*").alias("s")).agg(F.sum("s").alias("n"), F.sum(F.expr("s * (s - 1) div 2")).alias("same")).first()
        total = (s.n or 0) * ((s.n or 0) - 1) // 2
        if target > total - (s.same or 0):
            raise ValueError(f"{target} pairs wanted of {total - (s.same or 0)}")
        want = target
        while True:
            want = min(total, int(want * total / max(total - s.same, 1) * 1.2) + 16)
            drawn = random_pairs(all_, want, seed)
            a, b = first.select(F.col("doc").alias("a"), F.col("c").alias("ca")), first.select(F.col("doc").alias("b"), F.col("c").alias("cb"))
            found = drawn.join(a, "a").join(b, "b").where("ca <> cb").select("a", "b").orderBy(F.xxhash64("a", "b", F.lit(seed)), "a", "b").limit(target)
            if want == total or found.count() == target:
                return found
    n = docs.count()
    total = n * (n - 1) // 2
    if target > total:
        raise ValueError(f"{target} pairs wanted of {total}")
    at = numbered(docs.select("doc"), [F.xxhash64("doc", F.lit(seed)), F.col("doc")])
    spark = docs.sparkSession
    g = spark.range(1).select(F.lit(0).alias("g"))
    i, j = _unranked(F.lit(n), F.col("p"))
    drawn = _drawn(g, F.lit(target), F.lit(total), seed).select(i.alias("i"), j.alias("j"))
    a, b = at.select(F.col("n").alias("i"), F.col("doc").alias("a")), at.select(F.col("n").alias("j"), F.col("doc").alias("b"))
    return drawn.join(a, "i").join(b, "j").select("a", "b")


def same_prefix_pairs(codes: DataFrame, level: int, target: int, base_cap: int = 500, hard_cap: int = 50_000, seed: int = 42) -> DataFrame:
    """(a, b): at most ``target`` different pairs of documents with the same first ``level`` codes.

    Each group gives at most as many pairs as ``group_cap`` finds; of all these, ``target`` are taken by
    hash. A group is never paired up: its pair numbers are drawn and unranked.
    """


    rows = codes.select("doc", F.slice("codes", 1, level).alias("g"))
    size = rows.groupBy("g").agg(F.count("*").alias("s")).where("s > 1").withColumn("n_pairs", (F.col("s") * (F.col("s") - 1) / 2).cast("long"))
    cap = group_cap(size, target, base_cap, hard_cap).first()["cap"]
    drawn = _drawn(size, F.least(F.col("n_pairs"), F.lit(cap)), F.col("n_pairs"), seed)
    i, j = _unranked(F.col("s"), F.col("p"))
    pairs = drawn.select("g", i.alias("i"), j.alias("j"))
    # a group's documents are numbered in parts, shifted by the sizes of the parts before
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc", F.lit(seed)), F.lit(SALTS)))
    part = salted.groupBy("g", "salt").agg(F.count("*").alias("c"))
    before = part.select("g", "salt", (F.sum("c").over(Window.partitionBy("g").orderBy("salt")) - F.col("c")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("g", "salt").orderBy("doc")) - 1
    at = salted.withColumn("r", inside).join(before, ["g", "salt"]).withColumn("n", (F.col("before") + F.col("r")).cast("long"))
    a, b = at.select("g", F.col("n").alias("i"), F.col("doc").alias("a")), at.select("g", F.col("n").alias("j"), F.col("doc").alias("b"))
    found = pairs.join(a, ["g", "i"]).join(b, ["g", "j"]).select("a", "b")
    return found.orderBy(F.xxhash64("a", "b", F.lit(seed)), "a", "b").limit(target)
