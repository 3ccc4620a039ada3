"""Exact distributions of the cosines of all pairs of documents, by how many leading codes the two share.

Documents are kept in files of bounded size in the order of their codes, and every file meets every other one once: a task
reads its own file and then, one at a time, half of the others. Pairs are neither written nor shuffled. The first pass gives
counts, moments and a coarse histogram of each group, and so a narrow interval for each quantile; the second one counts what is
below an interval and the different cosines in it, which gives the quantile exactly.

Products are taken in single precision; in double precision only those that may be in an interval, and those of pairs with
the same first code. The work is the square of the documents by definition.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.operators.knn import _codes, _files, _matrix, _nonzero
from siftmark.runtime import Scratch

#: Documents of a file, about.
BLOCK = 8_192
#: Pairs of a product at once.
TILE = 1 << 20
#: Whole numbers in a cosine of one, and cells of the coarse histogram in it.
SCALE, CELLS = 10**9, 1 << 16
#: What a product of unit vectors in single precision may be wrong by: 64 sums and 2 roundings of 2^-24, and a margin.
SINGLE = 5e-6
#: A code that is not there; two of them are equal.
GAP = -(1 << 62)
#: Numbers in a cell of the second count.
FINE = 1000

Moments = dict[int, tuple[int, float, float]]


def _merged(a: tuple[int, float, float], b: tuple[int, float, float]) -> tuple[int, float, float]:
    """(n, mean, sum of squared distances to it) of two sets together."""
    n = a[0] + b[0]
    d = b[1] - a[1]
    return n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n


class _Rows:
    """Vectors and codes of some documents."""

    def __init__(self, v: np.ndarray, codes: np.ndarray):
        self.v, self.codes, self.first = v, codes, codes[:, 0]
        self.v32 = v.astype(np.float32)

    def take(self, at: np.ndarray) -> _Rows:
        return _Rows(self.v[at], self.codes[at])

    def __len__(self) -> int:
        return len(self.v)


def _met(own: _Rows, other: _Rows, apart: Callable, alike: Callable) -> None:
    """Every pair of the two once, of one file with itself those of different rows: ``apart`` gets sets of rows without a
    common first code, ``alike`` sets with the same one, and whether they are one set."""
    itself = own is other
    if not itself and (own.first.max() < other.first.min() or other.first.max() < own.first.min()):
        apart(own, other)
        return
    for c in np.unique(own.first).tolist():
        some = own.take(own.first == c)
        rest = other.take(other.first > c if itself else other.first != c)
        if len(rest):
            apart(some, rest)
        same = some if itself else other.take(other.first == c)
        if len(same):
            alike(some, same, itself)


def _alike(a: _Rows, b: _Rows, itself: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(shared codes, cosine as a whole number) of pairs, in parts."""
    step = max(1, TILE // len(b))
    for s in range(0, len(a), step):
        k = np.rint(a.v[s : s + step] @ b.v.T * SCALE).astype(np.int64)
        same, shared = np.ones(k.shape, bool), np.zeros(k.shape, np.int64)
        for level in range(a.codes.shape[1]):
            same &= a.codes[s : s + step, level, None] == b.codes[None, :, level]
            shared += same
        if itself:
            once = np.arange(s, s + len(k))[:, None] < np.arange(len(b))[None]
            yield shared[once], k[once]
        else:
            yield shared.ravel(), k.ravel()


def _tiles(a: _Rows, b: _Rows) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row of a, row of b, products from there on in single precision), small enough for the cache."""
    for s in range(0, len(b), 4096):
        right = b.v32[s : s + 4096].T
        step = max(16, TILE // right.shape[1])
        for r in range(0, len(a), step):
            yield r, s, a.v32[r : r + step] @ right


class _Coarse:
    """First pass: moments and histograms of each group."""

    def __init__(self) -> None:
        self.moments: Moments = {}
        self.cells: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(2 * CELLS + 2, np.int64))

    def add(self, g: int, n: int, mean: float, m2: float) -> None:
        self.moments[g] = _merged(self.moments[g], (n, mean, m2)) if g in self.moments else (n, mean, m2)

    def apart(self, a: _Rows, b: _Rows) -> None:
        n = len(a) * len(b)
        # sums over all products of two sets follow from the sets' own sums
        mean = float(a.v.sum(0) @ b.v.sum(0)) / n
        square = float(((a.v.T @ a.v) * (b.v.T @ b.v)).sum())
        self.add(0, n, mean, max(0.0, square - n * mean * mean))
        for _, _, sim in _tiles(a, b):
            sim += np.float32(1)
            sim *= np.float32(CELLS)
            self.cells[0] += np.bincount(sim.ravel().astype(np.int64), minlength=2 * CELLS + 2)

    def alike(self, a: _Rows, b: _Rows, itself: bool) -> None:
        for shared, k in _alike(a, b, itself):
            at = (k + SCALE) * CELLS // SCALE
            for g in np.unique(shared).tolist():
                some = shared == g
                x = k[some] / SCALE
                self.add(g, len(x), float(x.mean()), float(((x - x.mean()) ** 2).sum()))
                self.cells[g] += np.bincount(at[some], minlength=2 * CELLS + 2)

    def columns(self) -> Iterator[tuple]:
        for g, (n, mean, m2) in self.moments.items():
            yield [g], [-1], [n], [mean], [m2]
        for g, cells in self.cells.items():
            at = np.flatnonzero(cells)
            yield np.full(len(at), g), at, cells[at], np.zeros(len(at)), np.zeros(len(at))


class _Narrow:
    """Second pass: for each interval (group, least, most), how many cosines are below and which ones are in it."""

    def __init__(self, intervals: list[tuple[int, int, int]]):
        self.intervals, self.below = intervals, [0] * len(intervals)
        self.inside = [np.zeros(most - least + 1, np.int64) for _, least, most in intervals]

    def add(self, i: int, k: np.ndarray) -> None:
        _, least, most = self.intervals[i]
        self.below[i] += int(np.count_nonzero(k < least))
        k = k[(k >= least) & (k <= most)] - least
        if len(k):
            at, n = np.unique(k, return_counts=True)
            self.inside[i][at] += n

    def apart(self, a: _Rows, b: _Rows) -> None:
        asked = [(i, np.float32(least / SCALE - SINGLE), np.float32(most / SCALE + SINGLE)) for i, (g, least, most) in enumerate(self.intervals) if g == 0]
        for r, s, sim in _tiles(a, b):
            for i, low, high in asked:
                under = sim < low
                self.below[i] += int(np.count_nonzero(under))
                row, col = np.divmod(_nonzero((sim <= high) ^ under), sim.shape[1])
                if len(row):
                    self.add(i, np.rint(np.einsum("id,id->i", a.v[r + row], b.v[s + col]) * SCALE).astype(np.int64))

    def alike(self, a: _Rows, b: _Rows, itself: bool) -> None:
        for shared, k in _alike(a, b, itself):
            for g in np.unique(shared).tolist():
                some = k[shared == g]
                for i, x in enumerate(self.intervals):
                    if x[0] == g:
                        self.add(i, some)

    def columns(self) -> Iterator[tuple]:
        for i, (_, least, _) in enumerate(self.intervals):
            yield [i], [-1], [self.below[i]]
            at = np.flatnonzero(self.inside[i])
            yield np.full(len(at), i), at + (least + 2 * SCALE), self.inside[i][at]


def _passed(spark, path: str, levels: int, make: Callable, schema: str) -> DataFrame:
    """``columns`` of what ``make()`` is after it met all pairs of a task's file with itself and half of the others."""
    files = sorted(_files(path))
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    kinds = pa.schema([(x.split()[0], types[x.split()[1]]) for x in schema.split(", ")])

    def read(system: fs.FileSystem, at: int) -> _Rows | None:
        with system.open_input_file(files[at]) as source:
            t = pq.ParquetFile(source).read(columns=["v", "codes"])
        return _Rows(_matrix(t["v"]), _codes(t["codes"], levels, GAP)) if t.num_rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, n = fs.FileSystem.from_uri(path)[0], len(files)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                own, out = read(system, i), make()
                if own is None:
                    continue
                _met(own, own, out.apart, out.alike)
                for d in range(1, n // 2 + 1):
                    if 2 * d == n and i >= d:  # the file opposite meets this one
                        continue
                    if (other := read(system, (i + d) % n)) is not None:
                        _met(own, other, out.apart, out.alike)
                for columns in out.columns():
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c)).cast(k.type) for c, k in zip(columns, kinds)], names)

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(run, schema)


def cosine_summary(docs: DataFrame, levels: int) -> DataFrame:
    """(shared, n_pairs, mean, median, std, q25, q75, ci95_low, ci95_high) of the cosines of all ordered pairs of two
    documents, by how many of their first ``levels`` codes they share; groups without pairs have no row.

    ``docs`` has doc, v and codes: unit vectors of one length. Codes beyond a list's end count as null, and nulls as equal.
    Cosines are rounded to nine places, quantiles are exact and interpolated; mean -+ 1.96 std / sqrt(n).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pairs")
    schema = "shared long, n_pairs long, mean double, median double, std double, q25 double, q75 double, ci95_low double, ci95_high double"
    docs = scratch.keep(docs.select("doc", "v", "codes"), "docs")
    if not (n := docs.count()):
        return spark.createDataFrame([], schema)
    parts = max(-(-n // BLOCK), min(-(-n // 512), 2 * spark.sparkContext.defaultParallelism))  # all cores have work
    laid = scratch.keep(docs.repartitionByRange(parts, "codes", "doc").sortWithinPartitions("codes", "doc"), "laid")
    path = laid._scratch_path
    if _files(path) is None:
        raise ValueError("pairs need a shared folder that the workers can open")
    coarse = scratch.keep(_passed(spark, path, levels, _Coarse, "g int, cell long, n long, mean double, m2 double"), "coarse")
    moments: Moments = {}
    for r in coarse.where("cell < 0").collect():  # at most levels + 1 for each file
        moments[r.g] = _merged(moments[r.g], (r.n, r.mean, r.m2)) if r.g in moments else (r.n, r.mean, r.m2)
    t = coarse.where("cell >= 0").groupBy("g", "cell").agg(F.sum("n").alias("n")).toArrow()  # at most 2 * CELLS for each group
    cells = {g: np.zeros(2 * CELLS + 2, np.int64) for g in moments}
    for g, counts in cells.items():
        own = t.filter(pa.array(t["g"].to_numpy() == g))
        counts[own["cell"].to_numpy()] = own["n"].to_numpy()
    # order statistics of the ordered pairs, in which each cosine is there twice, by their place among the unordered ones
    wanted = {g: {(q, up): min((q * (2 * m[0] - 1) + 3 * up) // 4, 2 * m[0] - 1) // 2 for q in (1, 2, 3) for up in (0, 1)} for g, m in moments.items()}
    spans: dict[int, list[list[int]]] = {}
    slack = int(SINGLE * SCALE)
    for g, at in wanted.items():
        found = np.searchsorted(np.cumsum(cells[g]), sorted(set(at.values())), side="right")
        spans[g] = []
        for cell in sorted(set(found.tolist())):
            least, most = cell * SCALE // CELLS - SCALE - slack, (cell + 1) * SCALE // CELLS - SCALE + slack + 1
            if spans[g] and least <= spans[g][-1][1]:
                spans[g][-1][1] = most
            else:
                spans[g].append([least, most])
    intervals = [(g, least, most) for g, ends in spans.items() for least, most in ends]
    narrow = scratch.keep(_passed(spark, path, levels, lambda: _Narrow(intervals), "i int, k long, n long"), "narrow")
    below = {r.i: r.n for r in narrow.where("k < 0").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    inside = scratch.keep(narrow.where("k >= 0").groupBy("i", (F.col("k") - 2 * SCALE).alias("k")).agg(F.sum("n").alias("n")), "inside")
    counted: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for r in inside.groupBy("i", F.floor(F.col("k") / FINE).alias("p")).agg(F.sum("n").alias("n")).collect():
        counted[r.i].append((r.p, r.n))

    # (group, place) -> the interval's part and the place in it
    look: dict[tuple[int, int], tuple[int, int, int]] = {}
    for i, (g, _, _) in enumerate(intervals):
        total = below.get(i, 0)
        for p, m in sorted(counted[i]):
            look |= {(g, k): (i, p, k - total) for k in wanted[g].values() if total <= k < total + m}
            total += m
    some = sorted({(i, p) for i, p, _ in look.values()})
    met = inside.withColumn("p", F.floor(F.col("k") / FINE)).join(F.broadcast(spark.createDataFrame(some, "i int, p long")), ["i", "p"])
    values: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for r in met.collect():  # at most FINE for each quantile
        values[r.i, r.p].append((r.k, r.n))

    def value(g: int, k: int) -> float:
        i, p, rest = look[g, k]
        for x, m in sorted(values[i, p]):
            if rest < m:
                return x / SCALE
            rest -= m
        raise AssertionError("a quantile outside of its interval")

    out = []
    for g, (m, mean, m2) in sorted(moments.items()):
        both = 2 * m
        std = float(np.sqrt(2 * m2 / (both - 1)))
        at = {}
        for q in (1, 2, 3):
            low, high = (value(g, wanted[g][q, up]) for up in (0, 1))
            at[q] = low + (high - low) * (q * (both - 1) % 4 / 4)
        half = 1.96 * std / both**0.5
        out.append((g, both, mean, at[2], std, at[1], at[3], mean - half, mean + half))
    scratch.drop(docs, laid, coarse, narrow, inside)
    return spark.createDataFrame(out, schema)
