"""Problem 5: the k most similar vectors of every vector.

Method: score-aware (anisotropic) quantisation. Vectors are put in cells; a member's residual to the centre
of its cell is coded in ``PARTS`` four-bit codes, fitted with a loss that penalises the part of the error
parallel to the vector, which is what decides large inner products. In each cell, every vector that probes it
scans the members' codes (see ``scan``), and what may be among its ``k`` best goes to an exact reranking in
double precision, from both sides of a pair: all members whose score and ``SURE`` standard errors reach the
threshold and the k-th best lower bound, however many they are.

The standard error of a score follows from the length of the member's coding error; it is what may be lost
(measured recall: README). Of two vectors with a cosine of at least 0.9 one always probes the other's cell
(``vectors.BORDER``). Copies of a vector are one class, of which the search sees one vector; their ids are
joined in at the end.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmark.llm import vectors
from siftmark.runtime import Scratch

PARTS, CODES, TRAIN = 32, 16, 16_384
#: Weight of the parallel error: (d - 1) t^2 / (1 - t^2) for d = 64 and the method's threshold t = 0.2.
ETA = 63 * 0.04 / 0.96
#: Standard errors of a score that are allowed for.
SURE = 4.0
#: Parts of a class of copies.
SALTS = 32


def encode(u: np.ndarray, r: np.ndarray, books: np.ndarray, sweeps: int = 2) -> np.ndarray:
    """Codes (rows x parts) of the residuals ``r`` of unit vectors ``u`` with least anisotropic loss, by
    coordinate descent over the parts."""
    parts, _, width = books.shape
    n = len(u)
    us, rs = u.reshape(n, parts, width), r.reshape(n, parts, width)
    codes = np.zeros((n, parts), np.uint8)
    along = np.zeros((n, parts), np.float32)
    for p in range(parts):
        e = rs[:, p, None, :] - books[p][None]
        codes[:, p] = (e * e).sum(2).argmin(1)
        along[:, p] = ((rs[:, p] - books[p][codes[:, p]]) * us[:, p]).sum(1)
    total = along.sum(1)
    for _ in range(sweeps):
        for p in range(parts):
            e = rs[:, p, None, :] - books[p][None]
            par = (e * us[:, p, None, :]).sum(2)
            rest = total - along[:, p]
            loss = (e * e).sum(2) + (ETA - 1) * (rest[:, None] + par) ** 2
            codes[:, p] = loss.argmin(1)
            along[:, p] = par[np.arange(n), codes[:, p]]
            total = rest + along[:, p]
    return codes


def fit_books(u: np.ndarray, r: np.ndarray, rounds: int = 5, seed: int = 9) -> np.ndarray:
    """Codebooks (parts x codes x width): codes and least-squares codewords of the loss in turn."""
    rng = np.random.default_rng(seed)
    n, width = len(u), u.shape[1] // PARTS
    us, rs = u.reshape(n, PARTS, width), r.reshape(n, PARTS, width)
    books = np.stack([rs[rng.choice(n, CODES, replace=n < CODES), p] for p in range(PARTS)]).astype(np.float32)
    for _ in range(rounds):
        codes = encode(u, r, books, 1)
        err = np.stack([rs[:, p] - books[p][codes[:, p]] for p in range(PARTS)], 1)
        total = (err * us).sum((1, 2))
        for p in range(PARTS):
            rest = total - (err[:, p] * us[:, p]).sum(1)
            x = us[:, p].astype(np.float64)
            a = np.eye(width) + (ETA - 1) * x[:, :, None] * x[:, None, :]
            b = rs[:, p] + (ETA - 1) * x * (rest + (rs[:, p] * x).sum(1))[:, None]
            left, right = np.zeros((CODES, width, width)), np.zeros((CODES, width))
            np.add.at(left, codes[:, p], a)
            np.add.at(right, codes[:, p], b)
            some = np.bincount(codes[:, p], minlength=CODES) > 0
            books[p][some] = np.linalg.solve(left[some], right[some][:, :, None])[:, :, 0]
    return books


def shaped(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals of length one, and their lengths: codebooks fit tight cells as well as wide ones."""
    size = np.sqrt((r * r).sum(1))
    return r / np.maximum(size, 1e-12)[:, None], size


def decoded(codes: np.ndarray, size: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The residuals that the codes stand for, of length ``size``."""
    out = np.concatenate([books[p][codes[:, p]] for p in range(PARTS)], 1)
    return out * size[:, None]


def scan(q: np.ndarray, codes: np.ndarray, size: np.ndarray, books: np.ndarray, base: np.ndarray, back: np.ndarray | None = None) -> np.ndarray:
    """Scores (members x queries): ``base`` (the inner products with the centre) and, times the length of the
    member's residual, one table entry for each of its codes. These sums are the products with the residuals that the codes
    stand for, ``back`` if they are known, and are taken so: there are no four-bit shuffles for the look-ups in numpy."""
    out = (decoded(codes, size, books) if back is None else back) @ q.T
    out += base
    return out


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of every row, or the least if there are fewer."""
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k] if values.shape[1] > k else values.min(1)


def _may(high: np.ndarray, error: np.ndarray, k: int, least: float) -> np.ndarray:
    """Which members (rows) may be among a query's (column's) ``k`` best from ``least``, or the query among the
    member's: upper bounds that reach the threshold and the k-th largest lower bound."""
    ok = high >= least
    low = np.where(ok, high - 2 * error[:, None], -9)
    return ok & ((high >= _kth(low.T, k)[None]) | (high >= _kth(low, k)[:, None]))


def _search(k: int, least: float, books: np.ndarray, centres: np.ndarray):
    def f(g: vectors.Group) -> list[np.ndarray]:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        now = -1
        for cell, members, lo, hi, q in g.blocks(least, 256):
            if cell != now:  # members are coded once a cell
                now, centre = cell, centres[cell]
                r, size = shaped(g.m32[members] - centre)
                codes = encode(g.m32[members], r, books)
                back = decoded(codes, np.ones_like(size), books)
                lost = r - back
                back *= size[:, None]
                errors = SURE * size * np.sqrt((lost * lost).sum(1)) / np.sqrt(r.shape[1])
            m, error = members[lo:hi], errors[lo:hi]
            high = scan(g.q32[q], codes[lo:hi], size[lo:hi], books, (g.q32[q] @ centre)[None], back[lo:hi])
            high += error[:, None]
            some = np.flatnonzero(high.max(1) >= least)
            if not len(some):
                continue
            high, m, error = high[some], m[some], error[some]
            some = np.flatnonzero(high.max(0) >= least)
            high, q = high[:, some], q[some]
            high[g.mi[m][:, None] == g.qi[q][None]] = -9
            may = _may(high, error, k, least)
            rows = np.flatnonzero(may.any(1))
            if not len(rows):  # a query's own row
                continue
            may, exact = may[rows], np.full((len(rows), len(q)), -9.0)
            if may.sum() > may.size / 20:  # one product of the blocks costs less than many single ones
                exact[may] = np.round(g.mu[m[rows]] @ g.qu[q].T, 12)[may]
            else:
                row, col = np.nonzero(may)
                exact[row, col] = np.round(np.einsum("id,id->i", g.mu[m[rows[row]]], g.qu[q[col]]), 12)
            exact[exact < least] = -9
            for top, side in ((exact >= _kth(exact.T, k)[None], 0), (exact >= _kth(exact, k)[:, None], 1)):
                row, col = np.nonzero(top & (exact > -9))
                pair = (g.qi[q[col]], g.mi[m[rows[row]]])
                found.append((pair[side], pair[1 - side], exact[row, col]))
        return list(_first(found, k))

    return f


def _first(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each document among (document, neighbour, cosine)."""
    a, b, cos = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    order = np.lexsort((b, -cos, a))
    a, b, cos = a[order], b[order], cos[order]
    if len(a):  # a pair of two members is found from both sides
        one = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        a, b, cos = a[one], b[one], cos[one]
    start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)]))
    return a[rank < k], b[rank < k], cos[rank < k]


def neighbours(rows: DataFrame, id_col: str, vector_col: str, k: int = 10, least: float = 0.9) -> DataFrame:
    """(doc, neighbour, cos): the ``k`` most similar other documents of every document, of which only
    those with a cosine of at least ``least``; equal cosines (12 decimals): smaller id first.

    Unusable vectors (null, wrong length, not finite, all zero) and null ids neither ask nor are found.
    A doc with several rows counts once, with the least of its vectors. Tables with no usable vector give
    no rows.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "similar")
    schema = "doc long, neighbour long, cos double"
    v, copies, n = vectors.one_each(rows, id_col, vector_col, scratch)
    if not n:
        return spark.createDataFrame([], schema)
    x = vectors.sample(v, n)
    cells = vectors.Cells(vectors.fit_cells(x, vectors.cells_for(n)), n, vectors.border_for(least))
    x = x[np.random.default_rng(3).permutation(len(x))[:TRAIN]]
    books = fit_books(x, shaped(x - cells.centres[vectors.nearest(x, cells.centres)[0]])[0])
    found = vectors.per_region(v, _search(k, least, books, cells.centres), schema, cells, scratch).dropDuplicates(["doc", "neighbour"])
    best = Window.partitionBy("doc").orderBy(F.desc("cos"), "neighbour")
    found = scratch.keep(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"), "found")
    vectors.done(scratch)  # no later step reads vectors
    if copies is None:
        return found
    # the k + 1 smallest ids of each class; a partial limit comes before the shuffle
    small = copies.withColumn("r", F.row_number().over(Window.partitionBy("first").orderBy("doc"))).where(F.col("r") <= k + 1)
    several = scratch.keep(small.groupBy(F.col("first").alias("doc")).agg(F.sort_array(F.collect_list("doc")).alias("ids")), "several")
    # a class's neighbours are its own ids and those of the classes found
    ids = several.select(F.col("doc").alias("neighbour"), "ids")
    wide = found.join(ids, "neighbour", "left").select("doc", F.explode(F.coalesce("ids", F.array("neighbour"))).alias("neighbour"), "cos")
    own = several.select("doc", F.explode("ids").alias("neighbour"), F.lit(1.0).alias("cos"))
    wide = wide.unionByName(own).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
    lists = scratch.keep(wide.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "neighbour", "cos"))), lambda x: F.struct(x["neighbour"].alias("neighbour"), x["cos"].alias("cos"))).alias("list")), "lists")
    member = copies.select("doc", F.col("first").alias("class"), F.pmod(F.xxhash64("doc"), F.lit(SALTS)).alias("salt"))
    parts = member.select("class", "salt").distinct().join(lists.select(F.col("doc").alias("class"), "list"), "class")
    alone = lists.join(several.select("doc"), "doc", "left_anti")
    asked = alone.unionByName(member.join(parts, ["class", "salt"]).select("doc", "list"))
    others = F.slice(F.filter("list", lambda x: x["neighbour"] != F.col("doc")), 1, k)
    return asked.select("doc", F.explode(others).alias("x")).select("doc", "x.neighbour", "x.cos")


def similar_pairs(rows: DataFrame, id_col: str, vector_col: str, k: int = 10, least: float = 0.9) -> DataFrame:
    """(doc_a, doc_b), the smaller id first: at least one is a neighbour of the other."""
    n = neighbours(rows, id_col, vector_col, k, least)
    return n.select(F.least("doc", "neighbour").alias("doc_a"), F.greatest("doc", "neighbour").alias("doc_b")).distinct()
