"""Exact similarity of a query set with all documents, in blocks.

``top_k`` reads the kept documents once for every block of queries in a task, from the shared folder, and holds the best
so far: vectors are neither repeated in a shuffle nor broadcast, and only the ``k`` best of a query leave its task. Products
are taken in single precision; what may be among the best after their error is taken again in double precision.

Where the workers can't open the shared folder, and for ``gold_ranks``, queries and documents are cut into blocks of
bounded size by the hash of their ids, and every pair of blocks is one group. The work is queries times documents by
definition; for an approximate search of all rows against all rows use an index instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmark.functions.vectors import dot
from siftmark.runtime import Scratch

BLOCK = 16_384
#: Queries that a task searches for at once: the candidates of one take up to some 10 kB.
ASKED = 8_192
#: Queries below which they are dealt to all cores, as their table may be a single part.
FEW = 250_000
#: What a product of unit vectors in single precision may be wrong by, with a wide margin.
SINGLE = 1e-5


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    flat = col.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1).astype(np.float64) if len(col) else np.zeros((0, 1))


def _by_blocks(queries: DataFrame, docs: DataFrame, n_queries: int, n_docs: int, f: Callable, schema: str, extra: str | None = None) -> DataFrame:
    """``f(query ids, query vectors, extra column, doc ids, doc vectors) -> columns`` for every pair of blocks."""
    nq, nd = max(1, -(-n_queries // BLOCK)), max(1, -(-n_docs // BLOCK))
    # so many small query blocks that all cores have work
    cores = docs.sparkSession.sparkContext.defaultParallelism
    nq = max(nq, min(-(-n_queries // 256), -(-2 * cores // nd)))
    zero = F.lit(0).cast("long")
    x = F.col(extra).cast("long") if extra else F.lit(None).cast("long")
    q = queries.select(F.lit(0).alias("side"), F.pmod(F.xxhash64("query"), F.lit(nq)).alias("i"), F.explode(F.sequence(zero, F.lit(nd - 1).cast("long"))).alias("j"), F.col("query").alias("id"), "v", x.alias("x"))
    d = docs.select(F.lit(1).alias("side"), F.explode(F.sequence(zero, F.lit(nq - 1).cast("long"))).alias("i"), F.pmod(F.xxhash64("doc"), F.lit(nd)).alias("j"), F.col("doc").alias("id"), "v", F.lit(None).cast("long").alias("x"))
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64()}

    def run(t: pa.Table) -> pa.Table:
        side = t["side"].to_numpy()
        qs, ds = t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1)).sort_by("id")
        if not qs.num_rows or not ds.num_rows:
            return pa.table([pa.array([], kinds[c.split()[1]]) for c in schema.split(", ")], names=names)
        x = qs["x"].to_numpy(zero_copy_only=False)
        out = f(qs["id"].to_numpy(), _matrix(qs["v"]), x, ds["id"].to_numpy(), _matrix(ds["v"]))
        return pa.table([pa.array(c).cast(kinds[k.split()[1]]) for c, k in zip(out, schema.split(", "))], names=names)

    return q.unionByName(d).groupBy("i", "j").applyInArrow(run, schema)


def _files(path: str) -> list[str] | None:
    """The Parquet files of a kept table, or None if pyarrow can't open its folder."""
    try:
        system, at = fs.FileSystem.from_uri(path)
        return [x.path for x in system.get_file_info(fs.FileSelector(at)) if x.path.endswith(".parquet")]
    except (OSError, ValueError, NotImplementedError):
        return None


class _Best:
    """The best documents so far of a block of queries. ``add`` takes candidates with their exact similarities; ``floor``
    is what a candidate of each query must reach."""

    def __init__(self, n: int, k: int, wide: int, digits: int):
        self.n, self.k, self.scale, self.floor = n, k, 10.0**digits, np.full(n, -np.inf)
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, wide), np.int32))]
        self.new = 0

    def add(self, row: np.ndarray, doc: np.ndarray, sim: np.ndarray, codes: np.ndarray) -> None:
        self.held.append((row, doc, sim, codes))
        self.new += len(row)
        if self.new > self.n * self.k:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, doc, sim, codes, rank) of the ``k`` best, equal ones: smaller doc first."""
        row, doc, sim, codes = (np.concatenate(x) for x in zip(*self.held))
        keep = np.flatnonzero(sim >= self.floor[row])
        row, doc, sim, codes = row[keep], doc[keep], sim[keep], codes[keep]
        order = self._order(row, doc, sim)
        start = np.searchsorted(row[order], np.arange(self.n + 1))
        rank = np.arange(len(row)) - np.repeat(start[:-1], np.diff(start))
        order, rank = order[rank < self.k], rank[rank < self.k]
        row, doc, sim, codes = row[order], doc[order], sim[order], codes[order]
        last = np.flatnonzero(rank == self.k - 1)
        self.floor[row[last]] = sim[last]
        self.held, self.new = [(row, doc, sim, codes)], 0
        return row, doc, sim, codes, rank


    def _order(self, row: np.ndarray, doc: np.ndarray, sim: np.ndarray) -> np.ndarray:
        """By row, similarity and doc. Rounded similarities are whole numbers, which sort faster than three keys do."""
        if not len(sim) or np.abs(sim).max() * self.scale >= 1 << 33:
            return np.lexsort((doc, -sim, row))
        key = (row << 34) - np.rint(sim * self.scale).astype(np.int64)
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        tied = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
        some = order[tied]
        order[tied] = some[np.lexsort((doc[some], key[some]))]
        return order


def _codes(col: pa.ChunkedArray | pa.Array, levels: int, gap: int) -> np.ndarray:
    """Lists of codes as a matrix; ``gap`` where there is none."""
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = flat.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = flat.flatten().cast(pa.int64()).fill_null(gap).to_numpy(zero_copy_only=False)
    out = np.full((len(n), levels), gap, np.int64)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    some = place < levels
    out[row[some], place[some]] = values[some]
    return out


def top_k(queries: DataFrame, docs: DataFrame, k: int, excluded: str | None = None, digits: int = 9, levels: list[int] | None = None) -> DataFrame:
    """(query, doc, sim, rank): the ``k`` documents with the highest inner product for every query.

    ``queries`` has query and v, ``docs`` doc and v: unit vectors of one length, ids without nulls.
    ``excluded`` names a column of ``queries`` with a document that is never its result (itself, or the
    gold one); null excludes none. sim is rounded to ``digits``; equal ones: smaller doc first. With
    fewer than ``k`` documents, all come out; without any, none.

    With ``levels``, both tables also have a column of codes for each of its entries, codes0, codes1, ...: lists of which
    that many are compared. The result then has shared0, shared1, ..., how many leading codes the two have in common,
    and c0, the document's first code in codes0; pairs of which either side has null for any codes are left out.
    """
    if k < 1:
        raise ValueError("k must be positive")
    named = [f"codes{i}" for i in range(len(levels or []))]
    if not (path := getattr(docs, "_scratch_path", None)) or set(docs.columns) != {"doc", "v", *named}:
        path = Scratch(docs.sparkSession, "searched").keep(docs.select("doc", "v", *named), "docs")._scratch_path
    files = _files(path)
    if files is None:
        if levels:
            raise ValueError("codes need a shared folder that the workers can open")
        return _top_by_blocks(queries, docs, k, excluded, digits)
    asked = queries.select("query", "v", (F.col(excluded).cast("long") if excluded else F.lit(None).cast("long")).alias("x"), *named)
    if (n := queries.count()) < FEW:
        asked = asked.repartition(max(1, min(-(-n // 256), 2 * docs.sparkSession.sparkContext.defaultParallelism)), "query")
    cuts = np.concatenate([[0], np.cumsum(levels or [])]).astype(int)
    block = BLOCK

    def search(t: pa.Table) -> pa.RecordBatch:
        system = fs.FileSystem.from_uri(path)[0]
        qi, qv, x = t["query"].to_numpy(), _matrix(t["v"]), t["x"].combine_chunks()
        bars, x = x.is_valid().to_numpy(zero_copy_only=False), x.fill_null(0).to_numpy()
        q32, best = qv.astype(np.float32), _Best(len(qi), k, int(cuts[-1]) + len(named), digits)
        for f in files:
            with system.open_input_file(f) as source:
                for b in pq.ParquetFile(source).iter_batches(block, columns=["doc", "v", *named]):
                    if not b.num_rows:
                        continue
                    di, dv = b.column("doc").to_numpy(zero_copy_only=False), _matrix(pa.chunked_array([b.column("v")]))
                    there = [b.column(c).is_valid().to_numpy(zero_copy_only=False).astype(np.int64)[:, None] for c in named]
                    dc = np.hstack([np.zeros((len(di), 0), np.int64), *(_codes(b.column(c), n, -2) for c, n in zip(named, levels or [])), *there]).astype(np.int32)
                    d32 = np.ascontiguousarray(dv.astype(np.float32).T)
                    size = max(1.0, float(np.sqrt((dv * dv).sum(1).max() * (qv * qv).sum(1).max())))
                    slack = SINGLE * size + 10.0**-digits
                    for at in range(0, len(qi), 512):
                        sim = q32[at : at + 512] @ d32
                        floor = best.floor[at : at + 512] - slack
                        first = ~np.isfinite(floor)
                        if first.any() and len(di) > k + 1:  # one more, as one may be excluded
                            kth = np.partition(sim[first], len(di) - k - 1, axis=1)[:, len(di) - k - 1]
                            floor[first] = kth - 2 * slack
                        hit = _nonzero(sim >= floor.astype(np.float32)[:, None] - np.float32(1e-7))
                        row, col = hit // len(di), hit % len(di)
                        row += at
                        ok = ~(bars[row] & (x[row] == di[col]))
                        row, col = row[ok], col[ok]
                        for s in range(0, len(row), 100_000):
                            r, c = row[s : s + 100_000], col[s : s + 100_000]
                            exact = np.round(np.einsum("id,id->i", qv[r], dv[c]), digits)
                            up = np.isfinite(exact) & (exact >= best.floor[r])
                            best.add(r[up], di[c[up]], exact[up], dc[c[up]])
                    if first.any():
                        best.cut()
        row, doc, sim, codes, rank = best.cut()
        cols = [pa.array(qi[row]), pa.array(doc), pa.array(sim), pa.array(rank + 1)]
        if named:
            ok = (codes[:, cuts[-1] :] == 1).all(1)
            for i, c in enumerate(named):
                own = _codes(t[c], levels[i], -1)
                ok &= t[c].combine_chunks().is_valid().to_numpy(zero_copy_only=False)[row]
                cols.append(pa.array(np.cumprod(own[row] == codes[:, cuts[i] : cuts[i + 1]], axis=1).sum(1).astype(np.int32)))
            cols.append(pa.array(codes[:, 0].astype(np.int32), mask=codes[:, 0] == -2))
            cols = [c.filter(pa.array(ok)) for c in cols]
        return pa.RecordBatch.from_arrays(cols, names)

    names = ["query", "doc", "sim", "rank", *(f"shared{i}" for i in range(len(named))), *(["c0"] if named else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= ASKED:
                yield search(pa.Table.from_batches(held))
                held = []
        if sum(x.num_rows for x in held):
            yield search(pa.Table.from_batches(held))

    schema = "query long, doc long, sim double, rank long" + "".join(f", shared{i} int" for i in range(len(named))) + (", c0 int" if named else "")
    return asked.mapInArrow(run, schema)


def _nonzero(mask: np.ndarray) -> np.ndarray:
    """Where a matrix is true, flat; eight entries are looked at at once, as few are."""
    flat = np.ascontiguousarray(mask).ravel()
    whole = len(flat) // 8 * 8
    some = np.flatnonzero(flat[:whole].view(np.uint64))
    at = (some[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])


def _top_by_blocks(queries: DataFrame, docs: DataFrame, k: int, excluded: str | None, digits: int) -> DataFrame:
    """The same in pairs of blocks, whose best meet in a shuffle."""

    def best(qi, qv, x, di, dv):
        a, b, s = [], [], []
        for at in range(0, len(qi), 512):
            sim = qv[at : at + 512] @ dv.T
            if excluded:
                sim[x[at : at + 512, None] == di[None, :]] = -np.inf
            n = min(k, len(di))
            # everything that may reach the n-th value once rounded, so that ties go by id
            floor = np.partition(sim, len(di) - n, axis=1)[:, len(di) - n] - 10.0**-digits
            row, col = np.nonzero((sim >= floor[:, None]) & np.isfinite(sim))
            sim[row, col] = np.round(sim[row, col], digits)
            order = np.lexsort((col, -sim[row, col], row))
            row, col = row[order], col[order]
            start = np.searchsorted(row, np.arange(len(sim)))
            keep = np.arange(len(row)) - start[row] < k
            a.append(qi[at + row[keep]])
            b.append(di[col[keep]])
            s.append(sim[row[keep], col[keep]])
        return [np.concatenate(a), np.concatenate(b), np.concatenate(s)]

    found = _by_blocks(queries, docs, queries.count(), docs.count(), best, "query long, doc long, sim double", excluded)
    order = Window.partitionBy("query").orderBy(F.desc("sim"), "doc")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def gold_ranks(queries: DataFrame, docs: DataFrame, top_n: int = 10, digits: int = 9) -> DataFrame:
    """(query, gold, gold_rank, gold_sim, top1_doc, top1_sim, top_mean): where every query's gold document
    stands among all documents.

    ``queries`` has query, v and gold, ``docs`` doc and v. The rank is one plus the documents with a
    strictly higher similarity, so ties do not hurt; top1 takes the smaller document on ties; top_mean is
    the mean of the ``top_n`` most similar documents other than the gold one, null if there are none. A
    gold document that is not in ``docs`` is an error.
    """
    gold = queries.select("query", "gold", F.col("v").alias("qv")).join(docs.select(F.col("doc").alias("gold"), F.col("v").alias("gv")), "gold", "left")
    checked = F.when(F.col("gv").isNull(), F.raise_error(F.concat(F.lit("gold document without a vector: "), F.coalesce(F.col("gold").cast("string"), F.lit("null")))).cast("double")).otherwise(dot(F.col("qv"), F.col("gv")))
    gold = gold.select("query", "gold", F.round(checked, digits).alias("gold_sim"), "qv")
    scale = 10**digits
    # the gold similarity goes along as an integer, in the column for ids
    asked = gold.select("query", F.col("qv").alias("v"), F.round(F.col("gold_sim") * scale).cast("long").alias("g"))

    def higher(qi, qv, x, di, dv):
        out = [np.zeros(0)] * 3
        parts = []
        for at in range(0, len(qi), 512):
            sim = np.round(qv[at : at + 512] @ dv.T, digits)
            n = (np.rint(sim * scale) > x[at : at + 512, None].astype(np.float64)).sum(1)
            parts.append((qi[at : at + 512], n))
        out = [np.concatenate(c) for c in zip(*parts)]
        return out

    above = _by_blocks(asked, docs, queries.count(), docs.count(), higher, "query long, n long", "g").groupBy("query").agg(F.sum("n").alias("n"))
    near = top_k(queries, docs, top_n + 1).join(gold.select("query", "gold"), "query")
    first = near.groupBy("query").agg(F.max(F.when(F.col("rank") == 1, F.col("doc"))).alias("top1_doc"), F.max(F.when(F.col("rank") == 1, F.col("sim"))).alias("top1_sim"))
    place = Window.partitionBy("query").orderBy("rank")
    other = near.where("doc <> gold").withColumn("p", F.row_number().over(place)).where(F.col("p") <= top_n).groupBy("query").agg(F.avg("sim").alias("top_mean"))
    return gold.drop("qv").join(above, "query").join(first, "query").join(other, "query", "left").select("query", "gold", (F.col("n") + 1).cast("long").alias("gold_rank"), "gold_sim", "top1_doc", "top1_sim", "top_mean")
