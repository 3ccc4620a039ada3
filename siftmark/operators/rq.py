"""Residual quantisation: codebooks, assignment, identifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.functions.text import rqid
from siftmark.runtime import Scratch

#: Codebook entries (levels x codes x dimensions) that are sent to every task.
MAX_ENTRIES = 8_000_000
#: How far, in parts of their length, the centres of a split cluster move.
SPLIT = 1 / 1024


def codebook_arrays(codebooks: DataFrame) -> list[np.ndarray]:
    """One (codes x dimensions) matrix for each level, in order. Its size is checked before it is read."""
    n = codebooks.agg(F.sum(F.size("centroid"))).first()[0] or 0
    if n > MAX_ENTRIES:
        raise ValueError(f"codebooks of {n} entries; at most {MAX_ENTRIES}")
    rows = codebooks.select("level", "code", "centroid").orderBy("level", "code").collect()
    levels = sorted({r.level for r in rows})
    for level in levels:
        found = [r.code for r in rows if r.level == level]
        if found != list(range(len(found))):
            raise ValueError(f"codes of level {level} are not 0, 1, ...: a gap or a code twice")
    return [np.array([r.centroid for r in rows if r.level == level], np.float64) for level in levels]


def assign(docs: DataFrame, codebooks: DataFrame) -> DataFrame:
    """(doc, codes, norms): for every level the code of the nearest centre (squared distance in double
    precision, lowest code on ties) of what the levels before have left, and the length of the rest.

    ``docs`` has doc and v without nulls; codes are 0, 1, ... at each level. Map-only: the codebooks, of a
    checked size, go to every task.
    """
    books = docs.sparkSession.sparkContext.broadcast(codebook_arrays(codebooks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            rest = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)
            codes, norms = np.zeros((n, len(books.value)), np.int32), np.zeros((n, len(books.value)))
            for level, book in enumerate(books.value):
                far = (rest * rest).sum(1)[:, None] - 2 * rest @ book.T + (book * book).sum(1)[None, :]
                # the shortcut rounds; what comes close to the least is computed again in full
                row, col = np.nonzero(far <= far.min(1)[:, None] + 1e-9)
                exact = ((rest[row] - book[col]) ** 2).sum(1)
                order = np.lexsort((col, np.round(exact, 12), row))
                first = order[np.r_[True, np.diff(row[order]) > 0]]
                codes[:, level] = col[first]
                rest = rest - book[codes[:, level]]
                norms[:, level] = np.sqrt((rest * rest).sum(1))
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * len(books.value))
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.ListArray.from_arrays(offsets, pa.array(codes.ravel())), pa.ListArray.from_arrays(offsets, pa.array(norms.ravel()))], ["doc", "codes", "norms"])

    return docs.select(F.col("doc").cast("long").alias("doc"), F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "doc long, codes array<int>, norms array<double>")


def lloyd(points: DataFrame, k: int, rounds: int = 20, seed: int = 42) -> np.ndarray:
    """Centres (k x dimensions) of k-means on ``points`` (doc, v), by distributed Lloyd rounds.

    Each round is one map-side pass with the centres in every task and one small aggregate of k sums. The
    first centres are points chosen by the hash of their id; a centre without points takes half of the largest
    cluster: both centres move a little apart. Fewer than k points give as many centres.
    """
    sc = points.sparkSession.sparkContext
    first = points.orderBy(F.xxhash64("doc", F.lit(seed)), "doc").limit(k).select("v").collect()
    centres = np.array([r.v for r in first], np.float64)
    if not len(centres):
        return centres
    if centres.size > MAX_ENTRIES:
        raise ValueError("too many centres for one task")
    for _ in range(rounds):
        shared = sc.broadcast(centres)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            c = shared.value
            total, n = np.zeros(c.shape), np.zeros(len(c))
            for b in batches:
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
                for s in range(0, len(x), 4096):
                    part = x[s : s + 4096]
                    near = ((c * c).sum(1)[None, :] - 2 * part @ c.T).argmin(1)
                    order = np.argsort(near, kind="stable")
                    first = np.flatnonzero(np.r_[True, np.diff(near[order]) > 0])
                    total[near[order[first]]] += np.add.reduceat(part[order], first, axis=0)
                    n += np.bincount(near, minlength=len(c))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(total[at].tolist(), pa.list_(pa.float64()))], ["c", "n", "s"])

        sums = points.select("v").mapInArrow(run, "c long, n double, s array<double>")
        new = centres.copy()
        rows = sums.select("c", "n", F.posexplode("s").alias("p", "s")).groupBy("c", "p").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toPandas()
        new[rows.c.to_numpy(int), rows.p.to_numpy(int)] = rows.s.to_numpy() / rows.n.to_numpy()
        size = np.zeros(len(new))
        size[rows.c.to_numpy(int)] = rows.n.to_numpy()
        apart = 1 + np.where(np.arange(new.shape[1]) % 2, SPLIT, -SPLIT)
        for c in np.flatnonzero(size == 0):
            j = int(size.argmax())
            if size[j] < 2:
                break
            new[c], new[j] = new[j] * apart, new[j] * (2 - apart)
            size[c] = size[j] = size[j] / 2
        moved = np.abs(new - centres).max()
        centres = new
        if moved < 1e-12:
            break
    return centres


def fit(docs: DataFrame, levels: int = 4, codes: int = 256, rounds: int = 20, seed: int = 42) -> DataFrame:
    """Codebooks (level, code, centroid): k-means of the vectors, then of what is left of them, and so on.
    The residuals of each level are written to the shared folder, so a level never repeats the one before."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "rq")
    rest = docs.select(F.col("doc").cast("long").alias("doc"), F.col("v").cast("array<double>").alias("v"))
    out = []
    for level in range(levels):
        centres = lloyd(rest, codes, rounds, seed + level)
        out += [(level, c, [float(x) for x in v]) for c, v in enumerate(centres)]
        if level + 1 == levels:
            break
        shared = spark.sparkContext.broadcast(centres)

        def subtract(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            c = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                x = x - c[((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)]
                yield pa.RecordBatch.from_arrays([b.column("doc"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], ["doc", "v"])

        rest = scratch.keep(rest.mapInArrow(subtract, "doc long, v array<double>"), f"level{level}")
    return spark.createDataFrame(out, "level int, code int, centroid array<double>")


def docids(assigned: DataFrame) -> DataFrame:
    """(doc, rqid)."""
    return assigned.select("doc", rqid(F.col("codes")).alias("rqid"))


def uniqueness(ids: DataFrame) -> DataFrame:
    """(n_docs, n_rqids, ratio): one row; ratio is null without documents."""
    per = ids.where("rqid is not null").groupBy("rqid").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_docs"), F.count("*").alias("n_rqids"), (F.count("*") / F.sum("n")).alias("ratio"))


def residual_norms(assigned: DataFrame) -> DataFrame:
    """(level, mean_norm): mean length of what is left after each level."""
    return assigned.select(F.posexplode("norms").alias("level", "x")).groupBy("level").agg(F.avg("x").alias("mean_norm"))
