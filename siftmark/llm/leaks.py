"""Problem 7: evaluation texts inside corpus documents.

Method: pigeonhole edit matching on words. A window of an item's words that occurs in a document with
at most ``budget`` word edits has, if cut into ``budget`` + 1 pieces, one piece that occurs exactly.
All exact piece hits are found by rolling hashes, and each is verified with Myers' bit-parallel
distance between the window and the document's words around the hit.

The items are the query set; they are broadcast in blocks of a bounded number of windows, so any
number of items works. Documents are read once for each block and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.functions.text import words

#: Item words broadcast at once (8 bytes each, and about 32 more for each piece of each window).
BLOCK_WORDS = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive entries; a polynomial modulo 2**64 with an odd base."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        out = out * _BASE + h[i : i + len(out)]
    return out


def myers(pattern: list, text: list) -> int:
    """The least edit distance between ``pattern`` and any substring of ``text``.

    Bit-parallel over the pattern; Python's integers are the bit vectors, so no pattern is too long.
    """
    m = len(pattern)
    if not m:
        return 0
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    vp, vn, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        d0 = ((((eq & vp) + vp) & full) ^ vp) | eq | vn
        hp = vn | (full & ~(d0 | vp))
        hn = d0 & vp
        if hp & top:
            score += 1
        if hn & top:
            score -= 1
        hp, hn = (hp << 1) & full, (hn << 1) & full
        vp = hn | (full & ~(d0 | hp))
        vn = d0 & hp
        best = min(best, score)
    return best


class Pieces:
    """The pieces of every window of the items: by length, sorted hashes and where they stand."""

    def __init__(self, items: list[tuple[int, np.ndarray]], window: int, budget: int):
        self.items, self.budget = items, budget
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = {}
        for k, (_, h) in enumerate(items):
            size = min(window, len(h))
            if not size:
                continue
            errors = min(budget, size - 1)
            cuts = [size * i // (errors + 1) for i in range(errors + 2)]
            starts = np.arange(len(h) - size + 1)
            for a, b in zip(cuts, cuts[1:]):
                r = rolling(h, b - a)[starts + a]
                one = np.full(len(starts), k)
                found.setdefault(b - a, []).append((r, one, starts, np.full(len(starts), a), np.full(len(starts), size)))
        self.by_length = {}
        for n, parts in found.items():
            cols = [np.concatenate(c) for c in zip(*parts)]
            order = np.argsort(cols[0], kind="stable")
            self.by_length[n] = [c[order] for c in cols]

    def search(self, doc: np.ndarray, doc_of: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
        """(document, item) pairs; ``doc`` holds the words of many documents, that of word i is
        ``doc_of[i]`` with the bounds ``lo`` and ``hi``."""
        done: set[tuple[int, int]] = set()
        for n, (hashes, item, start, offset, size) in self.by_length.items():
            r = rolling(doc, n)
            if not len(r):
                continue
            inside = doc_of[: len(r)] == doc_of[n - 1 : n - 1 + len(r)]
            at = np.searchsorted(hashes, r)
            hit = np.flatnonzero(inside & (hashes[np.minimum(at, len(hashes) - 1)] == r))
            # each piece once a document and place in the window, with all items that have it
            _, one = np.unique(doc_of[hit] * len(hashes) + at[hit], return_index=True) if not self.budget else (None, np.arange(len(hit)))
            hit, first = hit[one], at[hit[one]]
            many = np.searchsorted(hashes, r[hit], side="right") - first
            j = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
            p = np.repeat(hit, many)
            for d, k, x, y in zip(doc_of[p].tolist(), item[j].tolist(), p.tolist(), j.tolist()):
                if (d, k) not in done and self._verified(doc, x, y, lo[d], hi[d], item, start, offset, size):
                    done.add((d, k))
        return sorted(done)

    def _verified(self, doc, p, j, lo, hi, item, start, offset, size) -> bool:
        window = self.items[int(item[j])][1][int(start[j]) : int(start[j]) + int(size[j])]
        errors = min(self.budget, len(window) - 1)
        a, b = p - int(offset[j]) - errors, p - int(offset[j]) + len(window) + errors
        return myers(window.tolist(), doc[max(a, lo) : min(b, hi)].tolist()) <= errors


def _hashed(df: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias(name), F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w)).alias("h"))


def _blocks(items: DataFrame, window: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The items, a bounded number of words at a time. A longer item comes in parts, which overlap so that each of its
    windows is whole in one of them."""
    block, n = [], 0
    for row in items.toLocalIterator():
        h = np.array(row.h, np.int64).view(np.uint64)
        for s in range(0, max(1, len(h) - window + 1), BLOCK_WORDS):
            block.append((row.item_id, h[s : s + BLOCK_WORDS + window - 1]))
            n += len(block[-1][1])
            if n >= BLOCK_WORDS:
                yield block
                block, n = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, window: int = 12, budget: int = 0) -> DataFrame:
    """(doc_id, item_id): ``window`` consecutive words of the item, all of them if it has fewer, occur
    in the document as consecutive words with at most ``budget`` word edits.

    Needs columns doc_id and text, item_id and text; others are not read. Null, empty and wordless
    texts have no case, nor have null ids. Repeated rows give one row. Words are compared by 64-bit
    hashes.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long"
    hashed = _hashed(docs, "doc_id", "text", "doc_id").where(F.size("h") > 0).dropna(subset=["doc_id"])
    asked = _hashed(items, "item_id", "text", "item_id").where(F.size("h") > 0).dropna(subset=["item_id"])
    out = spark.createDataFrame([], schema)
    for block in _blocks(asked, window):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pieces = Pieces(shared.value, window, budget)
            for b in batches:
                ids, lists = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("h")
                flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
                starts = np.concatenate([[0], ends[:-1]])
                doc_of = np.repeat(np.arange(len(ids)), ends - starts)
                pairs = pieces.search(flat, doc_of, starts, ends)
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[d]) for d, _ in pairs], pa.int64()), pa.array([pieces.items[k][0] for _, k in pairs], pa.int64())], ["doc_id", "item_id"])

        out = out.unionByName(hashed.mapInArrow(run, schema))
    return out.distinct()
