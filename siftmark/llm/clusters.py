"""Problem 1: clusters of mutually similar documents.

Method: power-iteration spectral clustering.

1. Affinities. Every document is joined to the ``NEAREST`` most similar of the documents it is linked to (a
   cosine of at least ``least``), weighted by the cosine, in each cell of vectors it probes.
2. Power iteration. Random vectors are multiplied by the normalised affinities until they are as good as
   constant along every affinity. A row of these vectors, scaled to length one, is a document's place; its
   direction doesn't shrink with the size of a cluster.
3. k-means of the places, with as many centres as there are filled cells of a fine grid, gives the clusters.

Both steps run twice. Within a group of vectors (see ``vectors.per_region``), of bounded size, they run on
the documents. Clusters of different groups that share documents then are the nodes of a second graph, whose
vectors are distributed tables. Nothing but the k-means of the places makes documents one cluster.

Exact checks: in a group, every linked pair in different clusters becomes an affinity, and over all groups
every shared document joins its clusters. While an affinity has its ends in two clusters, the iteration goes
on from where it is. Documents without links between them, directly or not, get the same place by chance only:
within ``GRID`` in ``VECTORS`` dimensions, for a billion clusters below one in a thousand.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmark.llm import vectors
from siftmark.runtime import Scratch

VECTORS, NEAREST, SALTS = 8, 8, 32
#: Width of a cell of the grid of places, and how near to its border a place is taken for both sides.
GRID, BORDER = 1e-3, 1e-5
#: Multiplications between two checks, and the spectral gap that they are made for at first.
STEPS, GAP = 12, 0.2
#: The same for the graph of clusters that share documents, whose paths are short.
FEW, WIDE = 10, 0.4
_X = [f"x{k}" for k in range(VECTORS)]


def steps(gap: float, n: int) -> list[tuple[float, float]]:
    """(p, q) of every step x' = p M x + q x'' of a Chebyshev iteration, where M = ((1 - r) I + W) / r and
    r = 1 - gap: it keeps what is constant along all affinities, and damps everything whose eigenvalue of
    (I + W) / 2 is below r as much as ``n`` multiplications can; the rest is damped less, but always."""
    r = 1 - gap
    mu = (2 - r) / r
    t = [1.0, mu]
    out = [(1 / mu, 0.0)]
    for _ in range(n - 1):
        t.append(2 * mu * t[-1] - t[-2])
        out.append((2 * t[-2] / t[-1], -t[-3] / t[-1]))
    return out


def starts(ids: np.ndarray) -> np.ndarray:
    """Random numbers in [-1, 1) that follow from the ids (rows x ``VECTORS``)."""
    x = ids.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, VECTORS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).view(np.int64) / 2.0**63


def places(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]


def grid_keys(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, own): the grid cells of places, by a hash, and those whose border is nearer than ``BORDER``."""
    g = np.floor(y / GRID).astype(np.int64)
    part = y / GRID - g
    side = np.where(part < BORDER / GRID, -1, np.where(part > 1 - BORDER / GRID, 1, 0))

    def key(cell: np.ndarray) -> np.ndarray:
        h = np.zeros(len(cell), np.uint64)
        for k in range(cell.shape[1]):
            h = (h ^ cell[:, k].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h.view(np.int64)

    rows, keys, own = [np.arange(len(y))], [key(g)], [np.ones(len(y), bool)]
    for i in np.flatnonzero((side != 0).any(1)).tolist():
        at = np.flatnonzero(side[i])
        for on in list(product((0, 1), repeat=len(at)))[1:]:
            c = g[i].copy()
            c[at] += side[i, at] * np.array(on)
            rows.append(np.array([i]))
            keys.append(key(c[None]))
            own.append(np.array([False]))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(own)


def k_means(y: np.ndarray) -> np.ndarray:
    """Labels of places: the centres are the filled cells of the grid; centres on both sides of a border that
    is nearer than ``BORDER`` to a place are one, named by the least key."""
    row, key, own = grid_keys(y)
    ok = own | np.isin(key, key[own])
    label = np.full(len(y), np.iinfo(np.int64).max)
    np.minimum.at(label, row[ok], key[ok])
    return np.unique(label, return_inverse=True)[1]


def spectral(ids: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Cluster numbers of nodes (named by ``ids``) with affinities ``w`` between nodes ``a`` and ``b``."""
    n = len(ids)
    a, b, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
    order = np.argsort(a, kind="stable")
    a, b, w = a[order], b[order], w[order]
    x, gap, many = starts(ids), GAP, STEPS
    label = np.arange(n)
    on = np.ones(n, bool)  # nodes whose cluster isn't settled
    while len(a):
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        node = a[first]
        at = np.zeros(n, np.int64)
        at[node] = np.arange(len(node))
        p = w / np.repeat(np.add.reduceat(w, first), np.diff(np.r_[first, len(a)]))
        to, r = at[b], 1 - gap
        now, last = x[node], np.zeros((len(node), VECTORS))
        for c, d in steps(gap, many):
            now, last = (c / r) * (np.add.reduceat(p[:, None] * now[to], first) + (1 - r) * now) + d * last, now
        x[node] = now / np.maximum(np.abs(now).max(1), 1e-300).mean()
        new = k_means(places(x[node]))
        label[node] = new + n
        cross = label[a] != label[b]
        open_ = np.unique(label[a[cross]])
        on = np.isin(label, open_)
        keep = on[a]
        a, b, w = a[keep], b[keep], w[keep]
        settled = ~on[node]
        label[node[settled]] += n * (1 + int(label.max() // n))  # numbers that no later round gives
        gap, many = max(gap / 4, 1e-9), min(2 * many, 4096)
    return np.unique(label, return_inverse=True)[1]


def _linked(q: np.ndarray, m: np.ndarray, g: vectors.Group, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The queries and the members of the group with links to one another, and their cosines, -2 without a link; doubtful
    ones are taken in double precision. Most have none, and go before anything but the product is done with them."""
    low = np.float32(least - 1e-5)
    cos = g.q32[q] @ g.m32[m].T
    some = np.flatnonzero(cos.max(1) >= low)
    q, cos = q[some], cos[some]
    some = np.flatnonzero(cos.max(0) >= low) if len(q) else np.zeros(0, np.int64)
    m, cos = m[some], cos[:, some]
    link = cos >= least
    close = np.nonzero(np.abs(cos - least) < 1e-5)
    link[close] = np.einsum("id,id->i", g.qu[q[close[0]]], g.mu[m[close[1]]]) >= least
    link[g.qi[q, None] == g.mi[None, m]] = False
    rows, cols = link.any(1), link.any(0)
    return q[rows], m[cols], np.where(link, cos, -2)[rows][:, cols]


def _strongest(label: np.ndarray, at: np.ndarray, to: np.ndarray, cos: np.ndarray) -> np.ndarray:
    """Of links between nodes of different clusters, the strongest for each pair of clusters."""
    x, y = np.minimum(label[at], label[to]), np.maximum(label[at], label[to])
    order = np.lexsort((-cos, y, x))
    x, y = x[order], y[order]
    return order[np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]]


def _local(least: float):
    """(doc, c): the clusters of a group's linked documents; c has the group's numbers in its higher bits."""

    def f(g: vectors.Group) -> list[np.ndarray]:
        ids = np.union1d(g.mi, g.qi)
        mx, qx = np.searchsorted(ids, g.mi), np.searchsorted(ids, g.qi)
        a, b, w, some = [], [], [], []

        def add(q: np.ndarray, m: np.ndarray) -> None:
            a.append(qx[q])
            b.append(mx[m])
            w.append(np.einsum("id,id->i", g.qu[q], g.mu[m]))

        for _, members, lo, hi, q in g.blocks(least, 1024):
            q, m, cos = _linked(q, members[lo:hi], g, least)
            if not len(q):
                continue
            some.append((m, q))
            best = np.argpartition(-cos, NEAREST - 1, axis=1)[:, :NEAREST] if len(m) > NEAREST else np.tile(np.arange(len(m)), (len(q), 1))
            row, col = np.nonzero(np.take_along_axis(cos, best, 1) > -2)
            add(q[row], m[best[row, col]])
        if not a:
            return [np.zeros(0), np.zeros(0)]
        while True:
            x, y = np.concatenate(a), np.concatenate(b)
            one = np.unique(np.minimum(x, y) * len(ids) + np.maximum(x, y), return_index=True)[1]
            nodes, at = np.unique(np.concatenate([x[one], y[one]]), return_inverse=True)
            label = -1 - np.arange(len(ids))  # a member that nobody's nearest are is alone so far
            label[nodes] = spectral(ids[nodes], at[: len(one)], at[len(one) :], np.concatenate(w)[one])
            more = 0
            for m, q in some:  # every link between two clusters is an affinity that was missed
                q, m, cos = _linked(q, m, g, least)
                row, col = np.nonzero((cos > -2) & (label[qx[q]][:, None] != label[mx[m]][None]))
                if len(row):
                    best = _strongest(label, qx[q[row]], mx[m[col]], cos[row, col])
                    add(q[row[best]], m[col[best]])
                    more += len(best)
            if not more:
                break
        cell, j, i = g.key
        if max(j, i) >> 16 or cell >> 14:
            raise ValueError("more groups than cluster numbers have room for")
        return [ids[nodes], (((cell << 16 | j) << 16 | i) << 17) + label[nodes]]

    return f


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        y = places(np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in _X], 1))
        row, key, own = grid_keys(y)
        yield pa.RecordBatch.from_arrays([b.column("c").take(pa.array(row)), pa.array(key), pa.array(own)], ["c", "key", "own"])


def distributed(parts: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(c, label) of the clusters (doc, c) that share documents with others: power iteration and k-means as in
    a group, on vectors that are tables. None if no document is shared."""
    shared = parts.groupBy("doc").agg(F.min("c").alias("a"), F.max("c").alias("z")).where("a < z").select("doc", "a")
    edges = parts.join(shared, "doc").where("c > a").groupBy("a", F.col("c").alias("b")).agg(F.count("*").cast("double").alias("w"))
    both = scratch.keep(edges.union(edges.select("b", "a", "w")), "both")
    if both.isEmpty():
        return None
    start = [(F.xxhash64("a", F.lit(k)) / F.lit(2.0**63)).alias(x) for k, x in enumerate(_X)]
    nodes = scratch.keep(both.groupBy("a").agg(F.sum("w").alias("d")).select(F.col("a").alias("c"), *start, "d"), "nodes")
    p = scratch.keep(both.join(nodes.select(F.col("c").alias("a"), "d"), "a").select("a", "b", (F.col("w") / F.col("d")).alias("p")), "affinities")
    # with a row for each node itself, a step reads the vectors once
    own = F.col("a") == F.col("b")
    sent = scratch.keep(p.union(nodes.select(F.col("c").alias("a"), F.col("c").alias("b"), F.lit(0.0).alias("p"))), "sent")
    x, gap, tries = nodes.drop("d"), WIDE, 0
    old: list[DataFrame] = []
    while True:
        r = 1 - gap
        x = x.withColumns({f"l{k}": F.lit(0.0) for k in _X})
        for u, v in steps(gap, FEW):
            met = sent.join(x.withColumnRenamed("c", "b"), "b")
            kept = lambda k: F.sum(F.when(own, F.col(k)).otherwise(0.0))
            grown = lambda k: F.sum(F.when(own, F.col(k) * (1 - r)).otherwise(F.col("p") * F.col(k)))
            x = met.groupBy(F.col("a").alias("c")).agg(*((grown(k) * (u / r) + kept(f"l{k}") * v).alias(k) for k in _X), *(kept(k).alias(f"l{k}") for k in _X))
        new = scratch.keep(x.select("c", *_X), "x")
        scratch.drop(*old)  # a round needs the last one only
        x = new
        keys = scratch.keep(x.mapInArrow(_keys, "c long, key long, own boolean"), "keys")
        filled = keys.where("own").select("key").distinct()
        label = scratch.keep(keys.join(filled, "key", "left_semi").groupBy("c").agg(F.min("key").alias("label")), "label")
        ends = p.select("a", "b").join(label.select(F.col("c").alias("a"), F.col("label").alias("la")), "a").join(label.select(F.col("c").alias("b"), F.col("label").alias("lb")), "b")
        if ends.where("la <> lb").isEmpty():
            return label
        old = [x, keys, label]
        tries += 1
        gap = WIDE / 4 ** (tries // 2)


def clusters(rows: DataFrame, id_col: str, vector_col: str, least: float = 0.9, size: int = 5) -> DataFrame:
    """(cluster_idx, doc_idx): the documents of every cluster with at least ``size`` members; its smallest
    document is its name.

    Documents are linked by a cosine of at least ``least`` and clustered with all they are linked to,
    directly or not. Unusable vectors (null, wrong length, not finite, all zero) and null ids are in no
    cluster. A doc with several rows counts once, with the least of its vectors. Copies of a vector are one
    node. Tables without links give no rows.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "clusters")
    v, copies, n = vectors.one_each(rows, id_col, vector_col, scratch)
    if not n:
        return spark.createDataFrame([], "cluster_idx long, doc_idx long")
    cells = vectors.Cells(vectors.fit_cells(vectors.sample(v, n), vectors.cells_for(n)), n, vectors.border_for(least))
    parts = scratch.keep(vectors.per_region(v, _local(least), "doc long, c long", cells, scratch), "parts")
    vectors.done(scratch)  # no later step reads vectors
    label = distributed(parts, scratch)
    # a name is its kind and a number: 0, a cluster of one group; 1, of the second graph; 2, copies that nothing else is linked to
    labels = parts.groupBy("doc").agg(F.min("c").alias("c"))
    if label is None:
        labels = labels.select("doc", F.struct(F.lit(0).alias("kind"), F.col("c").alias("n")).alias("c"))
    else:
        labels = labels.join(label, "c", "left").select("doc", F.struct(F.col("label").isNotNull().cast("int").alias("kind"), F.coalesce("label", "c").alias("n")).alias("c"))
    if copies is not None:
        salt = F.pmod(F.xxhash64("doc"), F.lit(SALTS)).alias("salt")
        firsts = copies.select("first", salt).distinct().join(labels.withColumnRenamed("doc", "first"), "first", "left")
        alone = F.struct(F.lit(2).alias("kind"), F.col("first").alias("n"))
        of = copies.select("doc", "first", salt).join(firsts, ["first", "salt"]).select("doc", F.coalesce("c", alone).alias("c"))
        labels = labels.unionByName(of).distinct()
    labels = scratch.keep(labels, "labels")
    # a cluster's members are counted in parts, so that none of them gathers a whole cluster
    salted = labels.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)))
    part = salted.groupBy("c", "salt").agg(F.min("doc").alias("first"), F.count("*").alias("n"))
    whole = part.groupBy("c").agg(F.min("first").alias("cluster_idx"), F.sum("n").alias("n")).where(F.col("n") >= size)
    named = part.select("c", "salt").join(whole.select("c", "cluster_idx"), "c")
    return salted.join(named, ["c", "salt"]).select("cluster_idx", F.col("doc").alias("doc_idx"))


def described(rows: DataFrame, id_col: str, vector_col: str, codes: DataFrame, found: DataFrame, typical: int = 5) -> DataFrame:
    """(cluster_idx, size, typical, codes) of clusters (cluster_idx, doc_idx).

    typical: the ids of the ``typical`` members with the highest internal affinity, the mean cosine to
    all members; equal ones (9 decimals): smaller id first. codes: at each level the commonest code of the members
    that have codes, the smaller one on ties; null without any.
    """
    scratch = Scratch(rows.sparkSession, "described")
    # a document with several rows has the least of its vectors
    v = vectors.usable(rows, id_col, vector_col).select(F.col("doc").alias("doc_idx"), "v")
    one = found.join(v, "doc_idx").groupBy("cluster_idx", "doc_idx").agg(F.min("v").alias("v"))
    one = scratch.keep(one.withColumn("salt", F.pmod(F.xxhash64("doc_idx"), F.lit(SALTS))), "members")

    def total(t: pa.Table) -> pa.Table:
        u = vectors.unit(vectors.matrix(t["v"]))
        return pa.table([t["cluster_idx"][:1], t["salt"][:1], pa.array([len(u)]), vectors.as_lists(u.sum(0)[None])], names=["cluster_idx", "salt", "n", "sum"])

    kind = found.schema["cluster_idx"].dataType.simpleString()
    part = scratch.keep(one.groupBy("cluster_idx", "salt").applyInArrow(total, f"cluster_idx {kind}, salt long, n long, sum array<double>"), "sums")
    size = part.groupBy("cluster_idx").agg(F.sum("n").alias("size"))
    sums = part.select("cluster_idx", F.posexplode("sum").alias("p", "e")).groupBy("cluster_idx", "p").agg(F.sum("e").alias("e"))
    mean = sums.groupBy("cluster_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "e"))), lambda s: s["e"]).alias("sum"))
    # a cluster's sum goes to each of its parts, so that no task gets a whole cluster
    sent = part.select("cluster_idx", "salt").join(mean.join(size, "cluster_idx"), "cluster_idx")

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = (vectors.unit(vectors.matrix(b.column("v"))) * vectors.matrix(b.column("sum"))).sum(1) / b.column("size").to_numpy()
                yield pa.RecordBatch.from_arrays([b.column("cluster_idx"), b.column("doc_idx"), b.column("size"), pa.array(np.round(own, 9))], ["cluster_idx", "doc_idx", "size", "own"])

    ranked = one.join(sent, ["cluster_idx", "salt"]).mapInArrow(ranks, f"cluster_idx {kind}, doc_idx {found.schema['doc_idx'].dataType.simpleString()}, size long, own double")
    order = Window.partitionBy("cluster_idx").orderBy(F.desc("own"), "doc_idx")
    top = ranked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= typical)
    top = top.groupBy("cluster_idx", "size").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "doc_idx"))), lambda s: s["doc_idx"]).alias("typical"))
    c = codes.select("doc_idx", F.posexplode("codes").alias("level", "code")).distinct().join(found, "doc_idx").groupBy("cluster_idx", "level", "code").agg(F.count("*").alias("n"))
    first = c.groupBy("cluster_idx", "level").agg(F.max_by("code", F.struct("n", -F.col("code"))).alias("code"))
    common = first.groupBy("cluster_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("level", "code"))), lambda s: s["code"]).alias("codes"))
    return top.join(common, "cluster_idx", "left").select("cluster_idx", "size", "typical", "codes")
