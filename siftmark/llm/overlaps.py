"""Problem 3: held-out inputs that occur in the training split, exactly or almost.

Method: weighted cosine join over inverted lists. A body is a unit vector with the same weight,
1/sqrt(n), for each of its n different words. Two bodies that share at least the part ``share`` of all
their words have a dot product of at least share/(1+share) * (n+m)/sqrt(n*m), so the threshold of a
pair follows from its two sizes. (Weights by rarity would lose cases: one changed rare word could take
the cosine below any threshold.)

Every vector's terms are ordered by how rare they are in both splits. The inverted lists hold a
vector only under the terms before which the rest can't reach the threshold any more. Vectors that meet in a
list, with their first common term at positions i and j, are pruned by two bounds on their dot product:

- maximum weight: the weights of the first common term, and the rest of the one vector times the other's
  maximum weight, either way;
- residual norms: by Cauchy-Schwarz in each of ``BLOCKS`` blocks of terms, by hash, the sum of the products of
  the two norms. (Over all terms at once, with equal weights, this bound is implied by the first: the root of x * y
  is never below the smaller one. In blocks it isn't, as the vectors' words fall into different ones.)

Lists are kept apart by the size of the training body, so that only sizes that can reach the threshold meet. The
pairs left get exact dot products.

Bodies with the same words are one vector: the join runs over classes of equal bodies, whose members
are joined in at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.functions.text import words
from siftmark.llm.copies import body_of
from siftmark.runtime import Scratch, most_frequent

#: Blocks of terms, each with a byte of a packed number; frequent terms whose counts are broadcast.
BLOCKS, HOT = 8, 4096


def _sets(rows: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, terms): the different words' hashes, in order; texts without words are left out."""
    terms = F.sort_array(F.array_distinct(F.transform(words(text), lambda w: F.xxhash64(w))))
    return rows.select(F.col(id_col).alias("id"), terms.alias("terms")).where(F.size("terms") > 0).withColumn("set", F.xxhash64("terms", F.size("terms")))


def alpha(n: Column, m: Column, share: float) -> Column:
    """How many words two sets of n and m words must have in common to share ``share`` of all."""
    return F.ceil(F.lit(share) / F.lit(1 + share) * (n + m) - 1e-9)


def _maxima(n: Column, i: Column, m: Column, j: Column, share: float) -> Column:
    """The bound by maximum weights, for vectors whose first common term is at positions i and j (from 0)."""
    return 1 + F.least(n - i - 1, m - j - 1) >= alpha(n, m, share)


def _packed(terms: Column) -> Column:
    """How many terms a vector has in each block, its squared norms there times its size: a byte a block; all bits are
    set if it has too many terms for that."""
    block = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), (F.pmod(t, F.lit(BLOCKS)) * 8).cast("int"))
    return F.when(F.size(terms) < 128, F.aggregate(terms, F.lit(0).cast("long"), lambda s, t: s + block(t))).otherwise(F.lit(-1).cast("long"))


def _norms(a: Column, n: Column, b: Column, m: Column, share: float) -> Column:
    """The bound by norms in blocks."""
    part = lambda x, k: F.shiftrightunsigned(x, 8 * k).bitwiseAND(F.lit(255)).cast("double")
    total = sum((F.sqrt(part(a, k) * part(b, k)) for k in range(1, BLOCKS)), F.sqrt(part(a, 0) * part(b, 0)))
    return (a == -1) | (b == -1) | (total >= alpha(n, m, share) - 1e-9)


def met(left: DataFrame, right: DataFrame, share: float) -> DataFrame:
    """(l, n, i, a, r, m, j, b) of ordered vectors (set, n, terms, norms) for each list in which two meet: their names,
    sizes, the term's positions, and packed norms."""
    # A partner has between share * n and n / share words; the shortest leaves the longest prefix.
    least = alpha(F.col("n"), F.ceil(F.col("n") * share - 1e-9), share)
    post = right.select(F.col("set").alias("r"), F.col("n").alias("m"), F.col("norms").alias("b"), F.posexplode(F.slice("terms", F.lit(1), (F.col("n") - least + 1).cast("int"))).alias("j", "t"))
    sizes = F.sequence(F.ceil(F.col("n") * share - 1e-9).cast("int"), F.floor(F.col("n") / share + 1e-9).cast("int"))
    ask = left.select(F.col("set").alias("l"), "n", "terms", F.col("norms").alias("a"), F.explode(sizes).alias("m"))
    ask = ask.select("l", "n", "m", "a", F.posexplode(F.slice("terms", F.lit(1), F.greatest(F.lit(0), F.col("n") - alpha(F.col("n"), F.col("m"), share) + 1).cast("int"))).alias("i", "t"))
    return ask.join(post, ["t", "m"])


def overlapping_sets(left: DataFrame, right: DataFrame, share: float, scratch: Scratch) -> DataFrame:
    """(l, r, dot): the classes of (set, terms) whose sets of words share at least ``share``."""
    # Rarity is counted over the classes of both sides. The counts of the most frequent terms, a bounded number, are
    # broadcast, so that no word's rows gather in one task.
    counted = left.unionByName(right).select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    counted = scratch.keep(counted, "counts")
    hot = F.broadcast(most_frequent(counted, "df", HOT))

    def ordered(side: DataFrame) -> DataFrame:
        n = F.size("terms")
        rows = side.select("set", n.alias("n"), F.explode("terms").alias("t"))
        rows = rows.join(hot, "t").unionByName(rows.join(hot.select("t"), "t", "left_anti").join(counted, "t"))
        whole = rows.groupBy("set", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("o")).select("set", "n", F.transform("o", lambda x: x["t"]).alias("terms"))
        return whole.withColumn("norms", _packed(F.col("terms")))

    lo, ro = scratch.keep(ordered(left), "left"), scratch.keep(ordered(right), "right")
    n, i, m, j = (F.col(c) for c in "nimj")
    pairs = met(lo, ro, share).where(_maxima(n, i, m, j, share) & _norms(F.col("a"), n, F.col("b"), m, share)).select("l", "r").distinct()
    full = pairs.join(lo.select(F.col("set").alias("l"), F.col("terms").alias("a")), "l").join(ro.select(F.col("set").alias("r"), F.col("terms").alias("b")), "r")
    common = F.size(F.array_intersect("a", "b"))
    n, m = F.size("a"), F.size("b")
    found = full.where(common >= alpha(n, m, share))
    return found.select("l", "r", (common / F.sqrt((n * m).cast("double"))).alias("dot"))


def overlaps(heldout: DataFrame, training: DataFrame, share: float = 0.75) -> DataFrame:
    """(query_idx, sample_id): bodies, as sets of words, share at least ``share`` of all words in either.

    Reads query_idx and input, sample_id and input, nothing else. Null, blank and wordless bodies have
    no case. Repeated rows give one row. Equal bodies are compared once, all their rows come out.
    """
    scratch = Scratch(heldout.sparkSession, "overlaps")
    h = scratch.keep(_sets(heldout, "query_idx", body_of(F.col("input"))), "heldout")
    t = scratch.keep(_sets(training, "sample_id", body_of(F.col("input"))), "training")
    one = lambda x: x.groupBy("set").agg(F.first("terms").alias("terms"))
    found = overlapping_sets(one(h), one(t), share, scratch)
    q = h.select(F.col("id").alias("query_idx"), F.col("set").alias("l"))
    s = t.select(F.col("id").alias("sample_id"), F.col("set").alias("r"))
    return found.select("l", "r").join(q, "l").join(s, "r").select("query_idx", "sample_id").distinct()


def overlap_counts(heldout: DataFrame, found: DataFrame) -> DataFrame:
    """(split, source, n_rows, n_pairs): held-out rows with a case and cases, by split and source."""
    per = found.groupBy("query_idx").agg(F.count("*").alias("n"))
    return heldout.select("query_idx", "split", "source").join(per, "query_idx").groupBy("split", "source").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_pairs"))
