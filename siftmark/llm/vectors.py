"""Cells of vectors, for problems 1 and 5: usable vectors, trained cells, and the blocks in which every
query vector meets every vector of the cells it probes.

The cells' centres are fitted on a bounded sample; all rows are put in cells. As a vector that lies between
many cells probes most of them, cells are sent in regions of about ``BLOCK`` members, a vector once to each
region in which it probes a cell, and meet there cell by cell. A region of any size is cut into member
blocks and query blocks of bounded size, and each pair of blocks is one group: no task gets more than
1.5 * ``BLOCK`` members and four times as many queries, whatever part of all rows one cell holds.

A task holds the members of a unit, about ``BLOCK`` rows of a region, and reads the files of all others (``per_region``): each vector is
written once. Where the workers can't open the shared folder, a vector meets several regions, so groups are sent in waves of about as many rows as there are vectors, and the files of a
wave's shuffle go before the next one: the disk holds the vectors about twice, however many regions each of them probes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.llm.copies import several
from siftmark.operators.knn import _files
from siftmark.runtime import Scratch, _remove, broadcast_if_small, swept

#: Rows of the sample that cells and codebooks are fitted on at most, cells, rows of a block.
SAMPLE, MAX_CELLS, BLOCK = 262_144, 16_384, 16_384
#: Rows of a wave at least; ids that are broadcast at most (8 bytes each).
WAVE, IDS = 1_000_000, 1_000_000
#: Centres that are fitted at once.
DIRECT = 1024
#: A cell is probed if its border is at most this far from the vector: two vectors with a cosine of 0.9 are
#: 0.4472 apart, and as the line between them crosses the border of their cells, one of them is at most half
#: of that from it. So of any such pair at least one vector probes the other's own cell.
BORDER = 0.2**0.5 / 2 + 1e-4


def usable(rows: DataFrame, id_col: str, vector_col: str, dim: int = 64) -> DataFrame:
    """(doc, v): the rows with ``dim`` finite entries that are not all zero, and an id."""
    v, inf = F.col("v"), F.lit(float("inf")).cast("float")
    least, most = F.array_min(v), F.array_max(v)
    # to look for a value in a list with nulls gives null; NaN is the largest number
    ok = (F.size(v) == dim) & (F.array_contains(v, inf) == F.lit(False)) & ~F.isnan(most) & (least > -inf) & ((least != 0) | (most != 0))
    return rows.select(F.col(id_col).cast("long").alias("doc"), F.col(vector_col).cast("array<float>").alias("v")).where("doc is not null and v is not null").where(ok)


def matrix(col: pa.Array | pa.ChunkedArray, dim: int = 64) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten()).reshape(-1, dim)


def unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    return m / np.sqrt((m * m).sum(1))[:, None]


def as_lists(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).ravel()))


def sample(vectors: DataFrame, n: int) -> np.ndarray:
    """Unit vectors of about 64 rows for each cell, at most about ``SAMPLE``, chosen by the hash of the id."""
    want = min(SAMPLE, 64 * cells_for(n))
    part = vectors if n <= want else vectors.where(F.pmod(F.xxhash64("doc", F.lit(7)), F.lit(1 << 30)) < int(want / n * (1 << 30)))
    with swept(vectors.sparkSession):
        t = part.select("v").toArrow()
    return unit(matrix(t["v"])).astype(np.float32) if t.num_rows else np.zeros((0, 64), np.float32)


def fit_cells(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centres of a spherical k-means; a centre without vectors takes one that fits badly. Above ``DIRECT``
    centres they are fitted within the cells of a first, coarse k-means, which costs the root of the time."""
    if k > DIRECT and len(x) > k:
        top = nearest(x, fit_cells(x, int(k**0.5), rounds, seed))[0]
        parts = [x[top == t] for t in np.unique(top)]
        return np.concatenate([fit_cells(p, max(1, round(k * len(p) / len(x))), rounds, seed) for p in parts])
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        best, sim = nearest(x, c)
        total = np.zeros(c.shape, np.float64)
        order = np.argsort(best, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(best[order]) > 0])
        total[best[order][starts]] = np.add.reduceat(x[order].astype(np.float64), starts)
        empty = np.flatnonzero(np.bincount(best, minlength=len(c)) == 0)
        if len(empty):
            total[empty] = x[np.argsort(sim)[: len(empty)]]
        length = np.sqrt((total**2).sum(1))
        c = np.where(length[:, None] > 1e-9, total / np.maximum(length, 1e-9)[:, None], c).astype(np.float32)
    return c


def nearest(x: np.ndarray, c: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    best, sim = np.zeros(len(x), np.int64), np.zeros(len(x), np.float32)
    for s in range(0, len(x), block):
        d = x[s : s + block] @ c.T
        best[s : s + block] = d.argmax(1)
        sim[s : s + block] = d.max(1)
    return best, sim


def probes(x: np.ndarray, c: np.ndarray, border: float = BORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, rank) of the cells each unit vector probes: its own, rank 0, and all whose border is
    at most ``border`` away, rank 1."""
    d = x @ c.T
    own = d.argmax(1)
    near = _within(d[np.arange(len(x)), own], d, own, c, c, border)
    near[np.arange(len(x)), own] = True
    row, cell = np.nonzero(near)
    return row, cell, (cell != own[row]).astype(np.int64)


def probes_among(x: np.ndarray, c: np.ndarray, own: np.ndarray, here: np.ndarray, border: float = BORDER) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in ``here``) of the cells ``here`` that unit vectors probe whose own cells are known."""
    near = _within(np.einsum("id,id->i", x, c[own]), x @ c[here].T, own, c, c[here], border)
    return np.nonzero(near | (own[:, None] == here[None]))


def _within(best: np.ndarray, d: np.ndarray, own: np.ndarray, c: np.ndarray, others: np.ndarray, border: float) -> np.ndarray:
    """Whether the border to each of ``others`` is near enough. Only the own centres' distances are taken, as those of all
    centres are the square of their number."""
    some, at = np.unique(own, return_inverse=True)
    # with what single precision may get wrong, which is more than centres of a tight cluster are apart
    far = c[some] @ others.T
    far *= np.float32(-2)
    far += np.float32(2 + 1e-5)
    far = np.sqrt(np.maximum(far, 0))
    far *= np.float32(border)
    far += np.float32(1e-5)
    far = far[at]
    far += d
    return far >= best[:, None]


def cells_for(n: int) -> int:
    return int(min(MAX_CELLS, max(1, 1.3 * n**0.5)))


class Cells:
    """Centres, how far from a border a vector probes the cell behind it, and the region of each cell."""

    def __init__(self, centres: np.ndarray, n: int, border: float = BORDER):
        self.centres, self.border = centres, border
        self.region = nearest(centres, fit_cells(centres, max(1, min(len(centres), -(-n // BLOCK)))))[0]

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return probes(x, self.centres, self.border)


def border_for(least: float) -> float:
    """``BORDER`` for pairs with a cosine of ``least``."""
    return (2 - 2 * least) ** 0.5 / 2 + 1e-4


def meetings(vectors: DataFrame, cells: Cells, scratch: Scratch) -> list[DataFrame]:
    """(cell, j, i, role, doc, own, v) in waves: one group of (cell, j, i) for every pair of a member block j and a
    query block i of a region, called cell. role 0 is a member, 1 a query, 2 both; own is the vector's cell. Queries are all
    vectors, in the region of their own cell and in those of the cells they probe. Vectors are placed once: a row of
    the kept table has a vector and the list of its regions, its own one first."""
    shared = vectors.sparkSession.sparkContext.broadcast(cells)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        many = int(c.region.max()) + 1
        for b in batches:
            m = matrix(b.column("v"))
            step = max(64, min(2048, 2_000_000 // len(c.centres)))
            for s in range(0, len(m), step):
                part = m[s : s + step]
                row, cell, rank = c.probes(unit(part).astype(np.float32))
                own = cell[rank == 0]
                first = c.region[own]
                key = np.unique(row * many + c.region[cell])
                row, region = key // many, key % many
                order = np.lexsort((region, region != first[row], row))
                ends = np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(region[order].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("doc").slice(s, len(part)), pa.array(own.astype(np.int32)), lists, as_lists(part)], ["doc", "own", "regions", "v"])

    kept = scratch.keep(vectors.mapInArrow(placed, "doc long, own int, regions array<int>, v array<float>"), "placed")
    if "vectors" in scratch.kept:
        scratch.drop(scratch.kept["vectors"])  # the placed ones are read from here on
    at = kept.select("doc", "own", "v", F.posexplode("regions").alias("p", "cell")).withColumn("home", F.col("p") == 0)
    # the sizes of at most MAX_CELLS regions
    counts = at.groupBy("cell").agg(F.sum(F.col("home").cast("int")).alias("home"), F.count("*").alias("all")).collect()
    cuts, sent = [], 0
    for r in sorted(counts, key=lambda r: r.cell):
        nb, nq = max(1, round(r.home / BLOCK)), max(1, round(r.all / (4 * BLOCK)))
        rows = r.all if nb == nq == 1 else r.all + -(-r.home * nq // nb)  # of each member block
        cuts.append((r.cell, nb, nq, sent, rows))
        sent += nb * rows
    size = max(WAVE, sum(r.home for r in counts))
    cols = ("cell", "j", "i", "role", "doc", "own", "v")
    zero, role = F.lit(0), F.when(F.col("home"), F.lit(2)).otherwise(F.lit(1)).alias("role")
    if sent <= size and all(c[1:3] == (1, 1) for c in cuts):
        return [at.select("cell", zero.alias("j"), zero.alias("i"), role, "doc", "own", "v")]
    at = at.join(F.broadcast(vectors.sparkSession.createDataFrame(cuts, "cell int, nb int, nq int, at long, rows long")), "cell")
    wave = F.floor((F.col("at") + F.col("j") * F.col("rows")) / F.lit(size))
    j, i = F.pmod(F.xxhash64("doc", F.lit(11)), F.col("nb")).cast("int"), F.pmod(F.xxhash64("doc", F.lit(13)), F.col("nq")).cast("int")
    small, big = at.where("nb = 1 and nq = 1").withColumn("j", zero), at.where("nb > 1 or nq > 1")
    out = []
    for w in sorted({(a + b * rows) // size for _, nb, _, a, rows in cuts for b in range(nb)}):
        alone = small.where(wave == w).select("cell", "j", zero.alias("i"), role, "doc", "own", "v")
        members = big.where("home").withColumn("j", j).where(wave == w).withColumn("i", F.explode(F.sequence(zero, F.col("nq") - 1))).withColumn("role", zero)
        queries = big.withColumn("j", F.explode(F.sequence(zero, F.col("nb") - 1))).where(wave == w).withColumn("i", i).withColumn("role", F.lit(1))
        out.append(alone.unionByName(members.select(*cols)).unionByName(queries.select(*cols)) if any(c[1:3] != (1, 1) for c in cuts) else alone)
    return out


def _by_unit(vectors: DataFrame, cells: Cells, scratch: Scratch) -> tuple[str, list[tuple[int, int, list[str]]]] | None:
    """Vectors (doc, own, v), each written once, into the files of their unit: about ``BLOCK`` rows of a region. (folder, (region,
    part of it, files) of each unit), or None if the workers can't open the shared folder."""
    spark = vectors.sparkSession
    if _files(scratch.kept["vectors"]._scratch_path if "vectors" in scratch.kept else scratch.root) is None:
        return None
    shared = spark.sparkContext.broadcast(cells)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            own = nearest(unit(matrix(b.column("v"))).astype(np.float32), c.centres, max(64, min(4096, 2_000_000 // len(c.centres))))[0]
            cols = [b.column("doc"), pa.array(own.astype(np.int32)), pa.array(c.region[own].astype(np.int32)), b.column("v")]
            yield pa.RecordBatch.from_arrays(cols, ["doc", "own", "cell", "v"])

    kept = scratch.keep(vectors.mapInArrow(placed, "doc long, own int, cell int, v array<float>"), "placed")
    if "vectors" in scratch.kept:
        scratch.drop(scratch.kept["vectors"])  # the placed ones are read from here on
    cuts, keys = [], []
    for r in sorted(kept.groupBy("cell").count().collect(), key=lambda r: r.cell):  # at most MAX_CELLS regions
        nb = max(1, round(r["count"] / BLOCK))
        cuts.append((r.cell, nb, len(keys)))
        keys += [(r.cell, j) for j in range(nb)]
    at = kept.join(F.broadcast(spark.createDataFrame(cuts, "cell int, nb int, first int")), "cell")
    laid = at.select("doc", "own", "v", (F.col("first") + F.pmod(F.xxhash64("doc", F.lit(11)), F.col("nb"))).cast("int").alias("unit")).repartition(max(1, min(len(keys), 512)), "unit")
    path = f"{scratch.root}/units"
    with swept(spark):
        laid.write.mode("overwrite").option("compression", "none").option("parquet.enable.dictionary", "false").partitionBy("unit").parquet(path)
    scratch.drop(kept)
    system, root = fs.FileSystem.from_uri(path)
    files: list[list[str]] = [[] for _ in keys]
    for x in system.get_file_info(fs.FileSelector(root, recursive=True)):
        if x.path.endswith(".parquet"):
            files[int(x.path.rsplit("unit=", 1)[1].split("/")[0])].append(x.path)
    return path, [(*key, sorted(f)) for key, f in zip(keys, files)]


def per_region(vectors: DataFrame, f: Callable[[Group], list[np.ndarray]], schema: str, cells: Cells, scratch: Scratch) -> DataFrame:
    """``f(group)`` of every group: the columns of ``schema``. A task holds the members of one unit and reads the other units'
    files; those of their vectors that probe one of its cells are its queries, which it meets in groups of bounded size.
    So vectors are neither placed in nor shuffled to the regions they probe. Without a folder that the workers can open,
    groups are shuffled in waves (``meetings``)."""
    if (found := _by_unit(vectors, cells, scratch)) is None:
        return per_meeting(meetings(vectors, cells, scratch), f, schema, cells, scratch)
    path, units = found
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast((cells, units))
    names, types = zip(*(x.split() for x in schema.split(", ")))
    kinds = {"long": (np.int64, pa.int64()), "double": (np.float64, pa.float64())}

    def read(system: fs.FileSystem, files: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for name in files:
            with system.open_input_file(name) as source:
                for b in pq.ParquetFile(source).iter_batches(BLOCK, columns=["doc", "own", "v"]):
                    yield np.asarray(b.column("doc")), np.asarray(b.column("own")), matrix(b.column("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, (c, all_units) = fs.FileSystem.from_uri(path)[0], shared.value
        for u in (u for b in batches for u in b.column(0).to_pylist()):
            region, j, files = all_units[u]
            here = np.flatnonzero(c.region == region)
            members = [np.concatenate(x) for x in zip(*read(system, files))]
            step = max(64, min(8192, 2_000_000 // len(here)))
            part, held = 0, [[x[:0] for x in members]]

            def met() -> pa.RecordBatch:
                doc, own, v = (np.concatenate(x) for x in zip(members, *held))
                # the first time, the members are their own queries too
                role = np.r_[np.full(len(members[0]), 0 if part else 2), np.ones(len(doc) - len(members[0]), np.int64)]
                columns = f(Group((region, j, part), role, doc, own, v, c))
                return pa.RecordBatch.from_arrays([pa.array(x.astype(kinds[k][0]), kinds[k][1]) for x, k in zip(columns, types)], list(names))

            for other, (_, _, more) in enumerate(all_units):
                if other == u:
                    continue
                for doc, own, v in read(system, more):
                    for s in range(0, len(doc), step):
                        x = v[s : s + step]
                        row = np.unique(probes_among(unit(x).astype(np.float32), c.centres, own[s : s + step], here, c.border)[0]) + s
                        if len(row):
                            held.append([doc[row], own[row], v[row]])
                    if sum(len(x[0]) for x in held) >= 4 * BLOCK:
                        yield met()
                        part, held = part + 1, [[x[:0] for x in members]]
            if not part or len(held) > 1:
                yield met()

    return spark.range(0, len(units), 1, len(units)).mapInArrow(run, schema)


def done(scratch: Scratch) -> None:
    """Removes the vectors that ``per_region`` wrote."""
    scratch.drop(scratch.kept["placed"])
    _remove(scratch.spark, f"{scratch.root}/units")


class Group:
    """What meets in one group: members (ids ``mi``, unit vectors ``mu``), queries (``qi``, ``qu``), both with
    single precision copies, and, for each cell with both, its centre's number, its members and the queries
    that probe it. A doc that comes several times is taken once for each role."""

    def __init__(self, key: tuple[int, int, int], role: np.ndarray, doc: np.ndarray, cell_of: np.ndarray, v: np.ndarray, c: Cells):
        self.key = key

        def pick(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at = np.flatnonzero(mask)
            _, one = np.unique(doc[at], return_index=True)
            return doc[at[one]], cell_of[at[one]], unit(v[at[one]])

        self.mi, mc, self.mu = pick(role != 1)
        self.qi, qc, self.qu = pick(role != 0)
        self.m32, self.q32 = self.mu.astype(np.float32), self.qu.astype(np.float32)
        here = np.flatnonzero(c.region == self.key[0])
        own = np.searchsorted(here, mc)
        asked: list[list[np.ndarray]] = [[] for _ in here]
        step = max(64, min(8192, 2_000_000 // len(here)))
        for s in range(0, len(self.qi), step):
            row, at = probes_among(self.q32[s : s + step], c.centres, qc[s : s + step], here, c.border)
            order = np.argsort(at, kind="stable")
            cut = np.searchsorted(at[order], np.arange(len(here) + 1))
            for k in np.unique(at).tolist():
                asked[k].append(row[order[cut[k] : cut[k + 1]]] + s)
        order = np.argsort(own, kind="stable")
        cut = np.searchsorted(own[order], np.arange(len(here) + 1))
        self.cells: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for k in np.flatnonzero(np.diff(cut)).tolist():
            if asked[k]:
                centre = c.centres[here[k]].astype(np.float64)
                centre /= np.sqrt(centre @ centre)
                m, q = order[cut[k] : cut[k + 1]], np.concatenate(asked[k])
                am, aq = (np.arccos(np.clip(x @ centre, -1, 1)) for x in (self.mu[m], self.qu[q]))
                i, j = np.argsort(am, kind="stable"), np.argsort(aq, kind="stable")
                self.cells.append((int(here[k]), m[i], am[i], q[j], aq[j]))

    def blocks(self, least: float, size: int, pairs: int = 8_000_000) -> Iterator[tuple[int, np.ndarray, int, int, np.ndarray]]:
        """(cell, its members, from, to, queries): blocks of queries, and the members that may have a cosine of ``least``
        with one of them: the angles to the cell's centre differ by no more than the angle of ``least``."""
        wide = np.arccos(least) + 1e-6
        for cell, m, am, q, aq in self.cells:
            step = max(16, min(size, pairs // len(m)))
            for s in range(0, len(q), step):
                part = q[s : s + step]
                lo, hi = np.searchsorted(am, [aq[s] - wide, aq[s + len(part) - 1] + wide])
                if lo < hi:
                    yield cell, m, int(lo), int(hi), part


def per_meeting(waves: list[DataFrame], f: Callable[[Group], list[np.ndarray]], schema: str, cells: Cells, scratch: Scratch) -> DataFrame:
    """``f(group)`` of every group: the columns of ``schema``. Of several waves, the results are kept one after the other."""
    names, types = zip(*(x.split() for x in schema.split(", ")))
    shared = scratch.spark.sparkContext.broadcast(cells)
    kinds = {"long": (np.int64, pa.int64()), "double": (np.float64, pa.float64())}

    def group(t: pa.Table) -> Group:
        return Group(tuple(t[x][0].as_py() for x in ("cell", "j", "i")), np.asarray(t["role"]), np.asarray(t["doc"]), np.asarray(t["own"]), matrix(t["v"]), shared.value)

    def run(t: pa.Table) -> pa.Table:
        return pa.table([pa.array(col.astype(kinds[k][0]), kinds[k][1]) for col, k in zip(f(group(t)), types)], names=list(names))

    found = [met.groupBy("cell", "j", "i").applyInArrow(run, schema) for met in waves]
    if len(found) > 1:
        found = [scratch.keep(x, "met") for x in found]
    return reduce(DataFrame.unionByName, found)


def one_each(rows: DataFrame, id_col: str, vector_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame | None, int]:
    """(doc, v), one row for each different usable vector, with its smallest id; (doc, first), the ids of vectors
    that several docs have, and the smallest of them, None without any; and how many different vectors there are.
    A doc with several rows has the least of its vectors. Copies are found by two 64-bit hashes."""
    v = scratch.keep(usable(rows, id_col, vector_col), "vectors")
    again = scratch.keep(v.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc"), "again")
    if not again.isEmpty():
        again = broadcast_if_small(again, IDS)
        v = v.join(again, "doc", "left_anti").unionByName(v.join(again, "doc").groupBy("doc").agg(F.min("v").alias("v")))
    key = F.struct(F.xxhash64("v"), F.xxhash64(F.lit(1), "v"))
    copies = scratch.keep(several(v.select(F.col("doc").alias("id"), key.alias("k")), "k").select(F.col("id").alias("doc"), "first"), "copies")
    with swept(rows.sparkSession):
        n = v.count()
    if copies.isEmpty():
        return v, None, n
    others = copies.where("doc > first").select("doc")
    return v.join(broadcast_if_small(others, IDS), "doc", "left_anti"), copies, n - others.count()
