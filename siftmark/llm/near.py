"""Problem 4: passages that differ by small edits, as pairs of word sets that share at least a given
part of all words in either.

The method named for this problem, segments with one-deletion variants, was measured first and not
kept (see README): on passages of a limited vocabulary the segments without a rare word put a growing
part of all passages in one list, and the candidates grew as the square of the rows. What is used
instead is exact too: variable-length prefix signatures.

- Every set is put in one global order, from rare words to frequent ones. Two sets that share enough
  have their first common word early in both, their second one place later, and so on.
- If the first common word is rare, it is the signature. If it would gather too many sets, the second
  common word is added, and then the third. How many a signature gathers is estimated from the words'
  document frequencies, which all sets know alike, so that no list has to be capped: a pair that has no
  light signature of one word has one of two or three.
- If two sets differ much in size, the smaller one's first common word must be among its very first, and
  so it is hardly ever a frequent word. Such pairs meet by that word alone, the larger set's frequent
  words against the smaller set's few; larger sets never meet each other there, however many they are.
- Sets that meet are compared by a small map of their words, blocks of rows of one signature against each
  other, in order of size so that only sizes that can be a pair meet; then by position, and what passes
  word by word.

The frequencies broadcast are those of the ``COMMON`` most frequent words: 24 bytes each, and 1 MB to find them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.functions.text import word_text
from siftmark.runtime import Scratch, broadcast_if_small, most_frequent

COMMON, LIGHT, DEPTH = 65_536, 8_192, 3
#: Sizes whose ratio is at least this are nearly the same. The kinds of the signatures for other pairs.
ALIKE, LARGE, SMALL = 0.82, 14, 15
_FAR = np.uint64(0x5851F42D4C957F2D)
#: Sets that a task remembers at most; beyond that, it may send a set's signatures again.
SEEN = 500_000
#: Keys of candidates that are broadcast at most (8 bytes each); more of them are joined by shuffle.
ASKED = 250_000
#: Bits of the map of words; rows of one signature that are paired in a task, and rows that it holds at once.
MAP, GROUP, CHUNK = 96, 20_000, 400_000
#: Signatures of at most so many rows are paired together, others in blocks of rows.
SHORT, BLOCK = 32, 64
#: The most words of a set, as an array of longs has at most 2 GB. Rows of words for each different set from which on copies go first.
SIZE, COPIES = 0xFFFFFFF, 1.25
#: With more sets than each of these, signatures are made in one more wave, as all at once would take more disk than the sets allow.
WAVES = (500_000, 16_000_000)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def passages(raw: DataFrame) -> DataFrame:
    """(key, text) of the passages of question rows; key is line_no * 100 + position.

    Null rows, lists and passages give no row.
    """
    p = raw.select(F.col("line_no").cast("long").alias("line"), F.posexplode("passages.passage_text").alias("pos", "text"))
    return p.where(F.col("text").isNotNull() & F.col("line").isNotNull()).select((F.col("line") * 100 + F.col("pos")).alias("key"), "text")


def word_sets(texts: DataFrame) -> DataFrame:
    """(key, id, terms): the different words' hashes, sorted, and a hash of them; texts without words are left out."""
    # texts without words go by a look at the text, as a condition on the terms would compute them twice
    worded = texts.where(F.col("key").isNotNull() & F.col("text").rlike(r"[\p{L}\p{N}]"))
    terms = F.sort_array(F.array_distinct(F.transform(F.split(word_text(F.col("text")), " "), lambda w: F.xxhash64(w))))
    found = worded.select(F.col("key").cast("long").alias("key"), terms.alias("terms"))
    return found.select("key", F.xxhash64("terms").alias("id"), "terms")


def _mixed(w: np.ndarray) -> np.ndarray:
    x = (w ^ (w >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(27))


def _flat(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the row of each."""
    n = col.value_lengths().to_numpy(zero_copy_only=False)
    return col.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(col)), n)


def frequencies(sets: DataFrame) -> DataFrame:
    """(w, df): in how many rows a word occurs, over all rows; each batch is counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, n = np.unique(_flat(b.column("terms"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(n.astype(np.int64))], ["w", "df"])

    return sets.select("terms").mapInArrow(run, "w long, df long").groupBy("w").agg(F.sum("df").alias("df"))


class Order:
    """The global order of words: those not among the ``COMMON`` first, by hash, then by frequency."""

    def __init__(self, words_: np.ndarray, df: np.ndarray, rows: int):
        by = np.argsort(words_)
        self.words, self.df, self.rows = words_[by], df[by], rows
        # what a word that isn't among them may have at most: the least of them, as all more frequent ones are
        self.rest = int(df.min()) if len(df) else 1
        # a word's place in the order, from 1 on
        self.rank = np.empty(len(by), np.int64)
        self.rank[np.lexsort((self.words, self.df))] = np.arange(1, len(by) + 1)
        # where the words with the same upper 17 bits begin; they are hashes, so that there are few
        self.begin = np.searchsorted(self.words >> 47, np.arange(-(1 << 16), (1 << 16) + 1))
        self.most = int(np.diff(self.begin).max())

    def sort(self, w: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words of rows, each row's in ascending order, in the global order, with their rows and frequencies."""
        df, rank = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
        if len(self.words):
            at = self.begin[(w >> 47) + (1 << 16)]
            for _ in range(self.most):
                at += self.words[np.minimum(at, len(self.words) - 1)] < w
            at = np.minimum(at, len(self.words) - 1)
            known = self.words[at] == w
            df, rank = np.where(known, self.df[at], 0), np.where(known, self.rank[at], 0)
        where = len(w).bit_length()
        if int(row[-1] + 1 if len(row) else 1) * (len(self.words) + 1) >> (63 - where):
            by = np.lexsort((w, rank, row))
        else:  # one number for row, rank and place is sorted much faster; unknown words keep their order
            by = np.sort((row * (len(self.words) + 1) + rank) << where | np.arange(len(w))) & ((1 << where) - 1)
        return w[by], row[by], np.maximum(df[by], self.rest)


def needed(n: np.ndarray, m: np.ndarray, share: float) -> np.ndarray:
    """Words in common that sets of n and m words need."""
    return np.ceil(share / (1 + share) * (n + m) - 1e-9).astype(np.int64)


def depth_for(share: float) -> int:
    """The most words a signature may have: any two different sets above the threshold share as many."""
    least = min((int(needed(np.array(n), np.array(m), share)) for n in range(1, 40) for m in range(n, 80) if n >= share * m - 1e-9 and needed(np.array(n), np.array(m), share) <= (n if n < m else n - 1)), default=DEPTH)
    return max(1, min(DEPTH, least))


def signatures(w: np.ndarray, row: np.ndarray, df: np.ndarray, sizes: np.ndarray, rows: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, position of its last word, kind) of every signature of the sets, whose words are in order
    in ``w``. The kind is the number of its words, or ``LARGE`` or ``SMALL``."""
    if not len(w):
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    depth = depth_for(share)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    pos = np.arange(len(w)) - first[row]
    n = sizes[row]
    # the last place of the first common word: with any partner, with one of nearly the same size, and
    # with a partner so much larger that its size is not nearly the same
    last = n - needed(n, np.ceil(share * n - 1e-9), share)
    near = n - needed(n, np.ceil(ALIKE * n - 1e-9), share)
    small = n - needed(n, n / ALIKE, share)
    h = w.view(np.uint64) * _MIX
    light = (df <= LIGHT) | (depth == 1)
    at = np.flatnonzero((pos <= last) & light)
    out = [(h[at], row[at], pos[at], np.full(len(at), 1))]
    for limit, kind in ((last, LARGE), (small, SMALL)) if depth > 1 else ():
        at = np.flatnonzero((pos <= limit) & ~light)
        out.append((h[at] ^ _FAR, row[at], pos[at], np.full(len(at), kind)))
    at = np.flatnonzero((pos <= near) & ~light)
    expect, key, c = df[at].astype(np.float64), h[at], 1
    # at: where the signature's last word stands; key: its hash; expect: how many sets have it by chance
    while len(at) and c < depth:
        parts, d = [], 1
        while True:
            ok = pos[at] + d <= np.minimum(near[at] + c, n[at] - 1)
            if not ok.any():
                break
            a, nxt = at[ok], at[ok] + d
            parts.append((nxt, (key[ok] ^ (key[ok] >> np.uint64(29))) * _MIX + h[nxt], expect[ok] * df[nxt] / max(rows, 1)))
            d += 1
        if not parts:
            break
        at, key, expect = (np.concatenate(x) for x in zip(*parts))
        c += 1
        done = (expect <= LIGHT) | (c == depth)
        out.append((key[done], row[at[done]], pos[at[done]], np.full(done.sum(), c)))
        at, key, expect = at[~done], key[~done], expect[~done]
    return tuple(np.concatenate(x) for x in zip(*out))


def _signature_rows(order, share: float, wave: int = 0, waves: int = 1):
    """(key, id, terms) to (sig, key, bits, place): a row for each signature of the wave of each set that the task
    meets for the first time. sig is the hash (32 bits), 15 less the kind (4 bits) and the number of words, so that
    rows in its order have the kinds ``SMALL``, ``LARGE``, 3, 2, 1 one after the other and in each the smaller sets first.
    place has the position in its lower half; bits and its upper half are a map of ``MAP`` bits, each of which tells whether the words that hash to it are odd in
    number, so that two sets differ in at least as many words as their maps in bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o, seen = order.value, set()
        for b in batches:
            keys, ids = b.column("key").to_numpy(zero_copy_only=False), b.column("id").to_pylist()
            new = np.zeros(len(ids), bool)
            for k, i in enumerate(ids):
                if i not in seen:
                    new[k] = True
                    seen.add(i)
            if len(seen) > SEEN:
                seen.clear()
            b, keys = b.filter(pa.array(new)), keys[new]
            if not len(keys):
                continue
            w, row, df = o.sort(*_flat(b.column("terms")))
            sizes = np.bincount(row, minlength=len(keys))
            starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            bit = (_mixed(w.view(np.uint64)) >> np.uint64(32)) * np.uint64(MAP) >> np.uint64(32)
            low, one = bit < 64, np.uint64(1)
            bits = np.bitwise_xor.reduceat(np.where(low, one << (bit & np.uint64(63)), np.uint64(0)), starts).view(np.int64)
            more = np.bitwise_xor.reduceat(np.where(low, np.uint64(0), one << (bit & np.uint64(31))), starts).view(np.int64) << 32
            sig, r, last, kind = signatures(w, row, df, sizes, o.rows, share)
            by = np.flatnonzero((sig >> np.uint64(32)) % np.uint64(waves) == wave)
            by = by[np.argsort(r[by], kind="stable")]  # a set's rows together, which shuffles in fewer bytes
            sig, r, last, kind = sig[by], r[by], last[by], kind[by]
            sig = (sig >> np.uint64(32) << np.uint64(32)).view(np.int64) | (15 - kind) << 28 | sizes[r]
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(keys[r]), pa.array(bits[r]), pa.array(more[r] | last)], list(ROW))

    return run


def _runs(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the runs of rows of one hash and kind: what they have in common, the first row, the number of rows."""
    run = sig >> 28
    first = np.flatnonzero(np.r_[True, np.diff(run) != 0]) if len(run) else np.zeros(0, np.int64)
    return run[first], first, np.diff(np.r_[first, len(run)])


def _pairs_of(r: dict[str, np.ndarray], share: float) -> tuple[np.ndarray, np.ndarray]:
    """The rows (i, j) of one signature each, in its order, that ``_can`` allows to be a pair."""
    bits, more = r["bits"].view(np.uint64), (r["place"].view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    n, pos, kind = r["sig"] & SIZE, r["place"] & 0xFFFFFFFF, 15 - (r["sig"] >> 28 & 15)
    rate = (1 - share) / (1 + share)
    most = np.minimum(np.ceil(n * rate), 64).astype(np.uint8)  # bits that a row allows of those in ``bits``
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(i: np.ndarray, j: np.ndarray) -> None:
        differ = np.bitwise_count(bits[i] ^ bits[j]) + np.bitwise_count(more[i] ^ more[j])
        ok = differ <= (n[i] + n[j]) * rate + 1e-6
        i, j = i[ok], j[ok]
        c = np.where(kind[i] >= LARGE, 1, kind[i])
        ok = c + np.minimum(n[i] - pos[i], n[j] - pos[j]) - 1 >= needed(n[i], n[j], share)
        a.append(i[ok])
        b.append(j[ok])

    def block(x: int, y: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the rows x to y and lo to hi, those whose first bits allow it."""
        at = np.flatnonzero(np.bitwise_count(bits[x:y, None] ^ bits[None, lo:hi]) <= most[x:y, None] + most[None, lo:hi])
        return x + at // max(hi - lo, 1), lo + at % max(hi - lo, 1)

    def up_to(lo: int, hi: int, words_: float) -> int:
        return lo + int(np.searchsorted(n[lo:hi], words_ + 1e-6, side="right"))

    run, first, rows = _runs(r["sig"])
    own = run & 15 > 15 - LARGE
    short = own & (rows <= SHORT)
    i, end, d = np.flatnonzero(np.repeat(short, rows)), np.repeat(first + rows, rows), 1
    while len(i := i[i + d < end[i]]):
        add(i, i + d)
        d += 1
    for k in np.flatnonzero(own & ~short).tolist():
        lo, hi = int(first[k]), int(first[k] + rows[k])
        # sizes that are less alike meet as large and small, unless the signature is of one word
        least = share if kind[lo] == 1 else min(ALIKE, 1)
        for x in range(lo, hi, BLOCK):
            y = min(x + BLOCK, hi)
            i, j = block(x, y, x, up_to(lo, hi, n[y - 1] / least))
            add(i[i < j], j[i < j])
    for k in np.flatnonzero((run[:-1] & 15 == 15 - SMALL) & (run[1:] == run[:-1] + 1)).tolist():
        lo, mid, hi = int(first[k]), int(first[k + 1]), int(first[k + 1] + rows[k + 1])
        for x in range(lo, mid, BLOCK):
            y = min(x + BLOCK, mid)
            for z in range(up_to(mid, hi, n[x]), to := up_to(mid, hi, n[y - 1] / share), GROUP):
                j, i = block(x, y, z, min(z + GROUP, to))
                add(i[n[i] > n[j]], j[n[i] > n[j]])
    return np.concatenate(a), np.concatenate(b)


ROW = {"sig": np.int64, "key": np.int64, "bits": np.int64, "place": np.int64}


def _meet(share: float, group: int, chunk: int):
    """Rows in order of their signature to (a, b) for every pair that is allowed, or, if more than ``group`` rows of one
    signature and kind would have to be held, to those rows as they came. Rows of the kind ``LARGE`` need not be: they
    meet those of the kind ``SMALL``, which come before them, and are forgotten."""

    def out(rows: dict[str, np.ndarray], deferred: bool) -> pa.RecordBatch:
        if deferred:
            size, pairs, kept = len(rows["sig"]), [None, None], rows
        else:
            i, j = _pairs_of(rows, share)
            x, y = rows["key"][i], rows["key"][j]
            size, pairs, kept = len(i), [np.minimum(x, y), np.maximum(x, y)], None
        cols = [pa.nulls(size, pa.int64()) if p is None else pa.array(p) for p in pairs]
        cols += [pa.array(kept[k]) if kept else pa.nulls(size, pa.from_numpy_dtype(t)) for k, t in ROW.items()]
        return pa.RecordBatch.from_arrays(cols, ["a", "b", *ROW])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        n, over = 0, []
        for b in batches:
            if not b.num_rows:
                continue
            held.append({k: b.column(k).to_numpy(zero_copy_only=False) for k in ROW})
            n += b.num_rows
            if n < chunk:
                continue
            rows = {k: np.concatenate([h[k] for h in held]) for k in ROW}
            last = rows["sig"][-1] >> 32 << 32  # the last signature may go on
            rows, deferred, over = _split(rows, group, over)
            if len(deferred["sig"]):
                yield out(deferred, True)
            cut = int(np.searchsorted(rows["sig"], last))
            yield out({k: v[:cut] for k, v in rows.items()}, False)
            rows = {k: v[cut:] for k, v in rows.items()}
            kind = 15 - (rows["sig"] >> 28 & 15)
            if (kind == LARGE).any():
                yield out({k: v[kind >= LARGE] for k, v in rows.items()}, False)
            held = [{k: v[kind != LARGE] for k, v in rows.items()}]
            n = len(held[0]["sig"])
        if held:
            rows, deferred, _ = _split({k: np.concatenate([h[k] for h in held]) for k in ROW}, group, over)
            if len(deferred["sig"]):
                yield out(deferred, True)
            yield out(rows, False)

    return run


def _split(rows: dict[str, np.ndarray], group: int, over: list[int]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], list[int]]:
    """Rows that can be paired here; those of more than ``group`` rows of one signature and kind, or of what is in ``over``,
    or ``LARGE`` whose ``SMALL`` are too many; and what of that may go on."""
    run, _, size = _runs(rows["sig"])
    small, large = run & 15 == 15 - SMALL, run & 15 == 15 - LARGE
    big = (size > group) & ~large | np.isin(run, over)
    big |= np.isin(run, run[small & big] + 1)
    if len(run):
        over = [run[-1], run[-1] + 1] if big[-1] and small[-1] else [run[-1]] if big[-1] else []
    many = np.repeat(big, size)
    return {k: v[~many] for k, v in rows.items()}, {k: v[many] for k, v in rows.items()}, over


def _can(a: str, b: str, share: float) -> Column:
    """What the rows of two sets with a common signature allow: map of words, position and size, by order of key or as large
    and small. The map comes first, as it rejects almost all, in whole numbers."""
    n, m = (F.col(f"{x}.sig").bitwiseAND(F.lit(SIZE)) for x in (a, b))
    i, j = (F.col(f"{x}.place").bitwiseAND(F.lit(0xFFFFFFFF)) for x in (a, b))
    kind = 15 - F.col(f"{a}.run").bitwiseAND(F.lit(15))
    differ = F.bit_count(F.col(f"{a}.bits").bitwiseXOR(F.col(f"{b}.bits"))) + F.bit_count(F.shiftrightunsigned(F.col(f"{a}.place").bitwiseXOR(F.col(f"{b}.place")), 32))
    few = differ * 1_000_000 <= (n + m) * math.ceil((1 - share) / (1 + share) * 1_000_000)
    need = F.ceil(F.lit(share / (1 + share)) * (n + m) - 1e-9)
    pair = F.when(kind < LARGE, F.col(f"{a}.key") < F.col(f"{b}.key")).otherwise(n > m)
    return few & pair & (F.when(kind < LARGE, kind).otherwise(1) + F.least(n - i - 1, m - j - 1) >= need)


def _met_elsewhere(deferred: DataFrame, share: float) -> DataFrame:
    """(a, b) of rows that were too many for a task: sort-merge joins, whose skewed partitions are split at run time. Large sets
    are joined to small ones only."""
    d = deferred.withColumn("run", F.shiftright("sig", 28))
    kind = 15 - F.col("run").bitwiseAND(F.lit(15))
    own, large, small = d.where(kind < LARGE), d.where(kind == LARGE), d.where(kind == SMALL).withColumn("run", F.col("run") + 1)
    met = [x.alias("a").join(y.alias("b"), (F.col("a.run") == F.col("b.run")) & _can("a", "b", share)).select(F.least("a.key", "b.key").alias("a"), F.greatest("a.key", "b.key").alias("b")) for x, y in ((own, own), (large, small))]
    return met[0].union(met[1])


def near_sets(texts: DataFrame, share: float, group: int = GROUP, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (key, id) of every text with words, and the pairs a < b of ids of different word
    sets that share at least ``share`` of all words in either.

    ``texts`` has key and text; other columns are not read. Null and wordless texts are in neither.
    """
    spark = texts.sparkSession
    scratch = Scratch(spark, "near")
    sets = scratch.keep(word_sets(texts), "sets", dictionary_mb=16)
    rows, ids = sets.agg(F.count("*"), F.approx_count_distinct("id")).first()
    unique = sets
    if rows > COPIES * ids:
        # copies of a set, which tasks would meet again and again, would meet each other in every signature
        one = scratch.keep(sets.groupBy("id").agg(F.min("key").alias("key")).select("key"), "one")
        unique = scratch.keep(sets.join(broadcast_if_small(one, ASKED), "key", "left_semi"), "unique", dictionary_mb=16)
        rows = unique.count()
    top = most_frequent(scratch.keep(frequencies(unique), "frequencies"), "df", COMMON).toPandas()
    order = spark.sparkContext.broadcast(Order(top.w.to_numpy(np.int64), top.df.to_numpy(np.int64), rows))
    waves = 1 + sum(rows > n for n in WAVES)
    parts = math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / waves)
    near = None
    for wave in range(waves):
        sig = unique.mapInArrow(_signature_rows(order, share, wave, waves), "sig long, key long, bits long, place long")
        part = sig.repartition(parts, F.shiftright("sig", 32)).sortWithinPartitions("sig").mapInArrow(_meet(share, group, chunk), "a long, b long, sig long, key long, bits long, place long")
        part = scratch.keep(part, f"near-{wave}")
        near = part if near is None else near.union(part)
    met = near.where("a is not null").select("a", "b")
    deferred = near.where("sig is not null").select(*ROW)
    if not deferred.isEmpty():
        met = met.union(_met_elsewhere(deferred, share))
    met = met.distinct()
    met = scratch.keep(met, "candidates")
    asked = met.select(F.col("a").alias("key")).union(met.select(F.col("b").alias("key"))).distinct()
    terms = sets.join(broadcast_if_small(asked, ASKED), "key").dropDuplicates(["key"])
    x = terms.select(F.col("key").alias("a"), F.col("id").alias("ia"), F.col("terms").alias("x"))
    y = terms.select(F.col("key").alias("b"), F.col("id").alias("ib"), F.col("terms").alias("y"))
    both = met.join(x, "a").join(y, "b").where("ia <> ib")
    common, total = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    pairs = both.where(common >= F.lit(share) * (total - common) - 1e-9)
    return sets.select("key", "id"), pairs.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")).distinct()


def near_pairs(texts: DataFrame, share: float = 0.7, group: int = GROUP, chunk: int = CHUNK) -> DataFrame:
    """(passage_a, passage_b), the smaller key first: all texts whose sets of words share at least
    ``share`` of all words in either, equal sets included. Repeated rows (same key) give one row."""
    members, pairs = near_sets(texts, share, group, chunk)
    m = members.distinct()
    x, y = m.select(F.col("key").alias("ka"), F.col("id").alias("a")), m.select(F.col("key").alias("kb"), F.col("id").alias("b"))
    equal = x.join(y, (F.col("a") == F.col("b")) & (F.col("ka") < F.col("kb"))).select("ka", "kb")
    other = pairs.join(x, "a").join(y, "b").where("ka <> kb").select("ka", "kb")
    return equal.union(other).select(F.least("ka", "kb").alias("passage_a"), F.greatest("ka", "kb").alias("passage_b")).distinct()


def near_groups(texts: DataFrame, share: float = 0.7) -> DataFrame:
    """(key, class_key, n_links): one row for each text with words: the smallest key of its class of equal
    word sets, and to how many other classes that class is linked."""
    members, pairs = near_sets(texts, share)
    links = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("n"))
    classes = members.groupBy("id").agg(F.min("key").alias("class_key"))
    return members.distinct().join(classes, "id").join(links, "id", "left").select("key", "class_key", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))
