"""Problem 8: the subjects of each document, none, one or several.

A document has a subject if at least a quarter of its sentences are about it. Method: classifier chains
over term, source and structure features.

1. Terms. Every word has a weight for each subject, from how much oftener the subject occurs around the
   word than anywhere. The weights start from the labelled examples and are then counted over all
   sentences of all documents: a word counts by what the *other sentences* of its documents are about.
   This finds subject words that no example has, forgets words that stood in one subject's examples by
   chance, and gives nothing to words of sentence patterns, which any subject shares. Words that are not
   clearly a subject's weigh nothing, so a sentence without subject words has no subject.
2. Chains. A document's features are, for each subject, by how many sentences and by what part of them it is
   above or below a quarter, counted and expected; its source's usual subjects; and its structure (sentences,
   lists, markup, questions). One logistic model for each subject also sees the labels of the subjects before
   it, which models what occurs together. The chain is fitted on composed documents alone, whose labels are
   known: subjects are drawn as they occur together in the corpus, sources as these subjects have them there,
   and the part ``LOST`` of all subject sentences looks as if it had no subject word. Where a document's own
   sentences leave a doubt, its other subjects and its source decide.
3. The models' probabilities are calibrated on other composed documents, and the likeliest combination of
   labels is found with beam search along the chain.

Texts are cut into sentences of word hashes once, in the JVM; all later passes read that table in blocks of
numbers. Fitted on bounded data: the examples, ``COMPOSED`` documents composed of them and of corpus sentences
of no subject, and ``SAMPLE`` documents that lend those sentences and their structure. Every word that
stands in at least ``LEAST`` documents has weights, however large the corpus is. Those of the ``VOCABULARY``
most frequent go to every task; those of all others are a table, joined to the texts by word. Likewise the
weights of the ``SOURCES`` largest sources go to every task, those of all others are joined. Counts cover all
documents, and every document is classified whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.functions.text import PY_SPACE
from siftmark.runtime import Scratch, most_frequent

LEAST, SOURCES = 3, 1000
#: Sources that composed documents are given.
LENT = 1000
VOCABULARY, ROUNDS, SAMPLE, COMPOSED, BEAM = 131_072, 3, 4_000, 8_000, 8
PART, SEED = 0.25, 17
#: Mean occurrences added to a word's, by which a ratio must exceed one to count, and its weight.
PRIOR, CLEAR, SLOPE = 4.0, 2.5, 3.0
#: What one example counts, and how sure its context is.
EXAMPLE, SURE = 2.0, 0.6
#: Part of the sentences with subject words that are about none all the same.
NONE = 0.4
#: Part of the subject sentences of composed documents that look like sentences of no subject.
LOST = 0.02
_END, _WIDE = ".!?…。？！؟", "。？！"
_TAG, _WORD = r"<[^<>]*>", r"\p{L}[\p{L}\p{M}]*"
# for Java's engine and Python's, so with the characters themselves
_SENTENCE = f"(?<=[{_END}])[{PY_SPACE}]+|[\n\r\u2028\u2029\u0085]+|(?<=[{_WIDE}])"
_PY = tuple(regex.compile(p) for p in (_TAG, _SENTENCE, _WORD))
FORM = 4


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence, without numbers. Tags end a sentence; what has no two words is none."""
    tag, end, word = _PY
    found = (word.findall(s) for s in end.split(tag.sub("\n", (text or "").lower())))
    return [w for w in found if len(w) > 1]


def structure(text: str | None) -> list[float]:
    t = text or ""
    return [float("<" in t), float("\n-" in t or "\n1." in t or "\n2." in t), float("?" in t), float(len(t) < 300)]


def word_id(word: str) -> int:
    """The 64-bit hash that Spark gives a word."""
    return int(np.uint64(xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)).astype(np.int64))


def cut(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep``, and ``s``, the hashes of the words of each sentence, as in ``sentences``, and ``form``, as in
    ``structure``."""
    text = F.coalesce("text", F.lit(""))
    found = F.transform(F.split(F.regexp_replace(F.lower(text), _TAG, "\n"), _SENTENCE), lambda x: F.regexp_extract_all(x, F.lit(_WORD), F.lit(0)))
    hashed = F.transform(F.filter(found, lambda w: F.size(w) > 1), lambda s: F.transform(s, lambda w: F.xxhash64(w)))
    has = lambda x: F.contains(text, F.lit(x))
    form = [has("<"), has("\n-") | has("\n1.") | has("\n2."), has("?"), F.length(text) < 300]
    return docs.select(*keep, hashed.alias("s"), F.array(*(f.cast("double") for f in form)).alias("form"))


class Text:
    """Documents as numbers: word hashes ``w``, the sentence ``of`` each, the document ``doc`` of each sentence."""

    def __init__(self, w: np.ndarray, of: np.ndarray, doc: np.ndarray, n: int, form: np.ndarray):
        self.w, self.of, self.doc, self.n, self.form = w, of, doc, n, form
        self.count = np.bincount(doc, minlength=n)

    @classmethod
    def of_batch(cls, b: pa.RecordBatch) -> Text:
        s = b.column("s")
        words = s.flatten()
        each = words.value_lengths().to_numpy(zero_copy_only=False)
        per = s.value_lengths().to_numpy(zero_copy_only=False)
        form = b.column("form").flatten().to_numpy(zero_copy_only=False).reshape(-1, FORM)
        return cls(words.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(each)), each), np.repeat(np.arange(b.num_rows), per), b.num_rows, form)

    @classmethod
    def of_sentences(cls, docs: list[list[np.ndarray]], form: np.ndarray) -> Text:
        flat = [s for d in docs for s in d]
        w = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        return cls(w, np.repeat(np.arange(len(flat)), [len(s) for s in flat]), np.repeat(np.arange(len(docs)), [len(d) for d in docs]), len(docs), form)


class Index:
    """Where words stand, by their hashes."""

    def __init__(self, words: np.ndarray):
        self.words = pa.array(words)

    def find(self, w: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 without one."""
        if not len(self.words) or not len(w):
            return np.full(len(w), -1)
        return pc.fill_null(pc.index_in(pa.array(w), value_set=self.words), -1).to_numpy(zero_copy_only=False)

    def __getitem__(self, word: str) -> int:
        at = int(self.find(np.array([word_id(word)]))[0])
        if at < 0:
            raise KeyError(word)
        return at


class Terms:
    """Word weights (words x classes; the last class is none)."""

    def __init__(self, words: np.ndarray, weight: np.ndarray):
        self.words, self.weight = words, weight
        k = weight.shape[1] - 1
        self.prior = np.append(np.full(k, (1 - NONE) / k), NONE)

    @property
    def index(self) -> Index:
        return Index(self.words)

    def __or__(self, rare: dict[int, list[float]]) -> Terms:
        """With the words of ``rare`` after the own ones."""
        if not rare:
            return self
        return Terms(np.append(self.words, np.array(list(rare), np.int64)), np.vstack([self.weight, np.array(list(rare.values()))]))

    def classes(self, t: Text, at: np.ndarray) -> np.ndarray:
        """Class probabilities of sentences, whose words stand at ``at``; those of the same document pull each other
        a little. Without a subject word, a sentence is about none."""
        m = len(t.doc)
        s = np.tile(np.log(self.prior), (m, 1))
        if not m:
            return s
        told = np.append((self.weight > 0).any(1), False)[at]
        of, word = t.of[told], at[told]
        if len(of):
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            s[of[first]] += np.add.reduceat(self.weight[word], first, axis=0)
        blank = np.ones(m, bool)
        blank[of] = False
        none = np.eye(s.shape[1])[-1]
        p = softmax(s)
        p[blank] = none
        own = per_document(t, p)
        around = (own[t.doc] - p + 2 * self.prior) / (t.count[t.doc][:, None] - 1 + 2)
        # none gets no pull: whether a sentence has a subject is its own words' matter
        pull = np.log(around / self.prior)
        pull[:, -1] = 0
        q = softmax(s + 0.5 * np.where(s > np.log(self.prior) + 1e-9, pull, 0))
        q[blank] = none
        return q


def per_document(t: Text, p: np.ndarray) -> np.ndarray:
    out = np.zeros((t.n, p.shape[1]))
    if len(t.doc):
        first = np.flatnonzero(np.r_[True, t.doc[1:] != t.doc[:-1]])
        out[t.doc[first]] = np.add.reduceat(p, first, axis=0)
    return out


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True)) if s.size else s
    return e / e.sum(axis=-1, keepdims=True) if s.size else s


def _weights(counts: np.ndarray, share: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Weights of counts (words x classes); those of none are zero."""
    ratio = (counts + prior * share) / ((counts.sum(1, keepdims=True) + prior) * share)
    out = SLOPE * np.maximum(0.0, np.log(ratio / CLEAR))
    out[:, -1] = 0
    return out


def example_counts(examples: list[tuple[str, list[np.ndarray]]], subjects: list[str], words: np.ndarray) -> np.ndarray:
    """In how many examples of each subject a word stands."""
    counts, index = np.zeros((len(words), len(subjects))), Index(words)
    for subject, s in examples:
        at = index.find(np.unique(np.concatenate(s)))
        counts[at[at >= 0], subjects.index(subject)] += 1
    return counts


def first_terms(own: np.ndarray, words: np.ndarray) -> Terms:
    """Terms of the examples alone."""
    k = own.shape[1]
    weight = np.zeros((len(words), k + 1))
    weight[:, :k] = SLOPE * np.maximum(0.0, np.log((own + 2 / k) / (own.sum(1, keepdims=True) + 2) * k / CLEAR))
    return Terms(words, weight)


def document_counts(texts: DataFrame) -> DataFrame:
    """(w, n): in how many documents each word stands; each batch is counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = Text.of_batch(b)
            if len(t.w):
                words, at = np.unique(t.w, return_inverse=True)
                n = np.bincount(np.unique(t.doc[t.of] * len(words) + at) % len(words), minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n)], ["w", "n"])

    return texts.select("s", "form").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _count(shared, rare: bool):
    """Rows of (w, n): what the words' contexts are about, of each known word once a task, at the end; of others (more
    is true) once a batch; w is null for the sum over all sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: Terms = shared.value
        index, (size, k) = terms.index, terms.weight.shape
        counts, total = np.zeros((k, size)), np.zeros(k)

        def out(words: np.ndarray, n: np.ndarray, more: bool) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * k), pa.array(n.ravel()))
            return pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(np.full(len(n), more)), lists], ["w", "more", "n"])

        for b in batches:
            t = Text.of_batch(b)
            if not len(t.doc):
                continue
            at = index.find(t.w)
            if joined := _rare(b):
                wide = terms | joined
                p = wide.classes(t, wide.index.find(t.w))
            else:
                p = terms.classes(t, at)
            total += p.sum(0)
            others = t.count[t.doc] - 1
            # a sentence's context: the other sentences of its document
            context = (per_document(t, p)[t.doc] - p) / np.maximum(others, 1)[:, None]
            told = others[t.of] > 0
            ok = told & (at >= 0)
            # a context's parts are one in all, so what the subjects leave is about none; most contexts have few of them
            word, of = at[ok], t.of[ok]
            counts[k - 1] += np.bincount(word, minlength=size)
            for c in range(k - 1):
                some = np.flatnonzero((context[:, c] > 0)[of])
                here = np.bincount(word[some], weights=context[of[some], c], minlength=size)
                counts[c] += here
                counts[k - 1] -= here
            ok = told & (at < 0)
            if rare and ok.any():
                words, of = np.unique(t.w[ok], return_inverse=True)
                yield out(words, np.stack([np.bincount(of, weights=context[t.of[ok], c], minlength=len(words)) for c in range(k)], 1), True)
        some = np.flatnonzero(counts.sum(0) > 0)
        yield out(terms.words[some], counts[:, some].T.copy(), False)
        yield out([None], total[None], False)

    return run


def learn(texts: DataFrame, terms: Terms, own: np.ndarray, scratch: Scratch, rare: DataFrame | None, weights: DataFrame | None) -> tuple[Terms, DataFrame | None]:
    """New terms from the counts of all sentences of all documents; the examples' own counts stay in, as
    they set what each class means. ``rare`` has the words (w) beside the terms' own, ``weights`` their weights (w, n)
    so far; their new weights are the second result."""
    k = terms.weight.shape[1]
    counted = with_rare(texts.select("row", "s", "form"), terms, weights).mapInArrow(_count(texts.sparkSession.sparkContext.broadcast(terms), rare is not None), "w long, more boolean, n array<double>")
    if rare is not None:
        counted = scratch.keep(counted, "counts")
    sums = [F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(k)]
    # a row for each word of the vocabulary
    rows = counted.where("not more").groupBy("w").agg(*sums).toArrow()
    n = np.stack([rows[f"n{i}"].to_numpy() for i in range(k)], 1) if rows.num_rows else np.zeros((0, k))
    known = rows["w"].is_valid().to_numpy()
    total = 10.0 + n[~known].sum(0)
    share = total / total.sum()
    counts = np.zeros((len(terms.words), k))
    counts[terms.index.find(rows["w"].drop_null().to_numpy())] = n[known]
    if rare is not None:

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = _weights(np.stack([b.column(f"n{i}").to_numpy() for i in range(k)], 1), share)
                    at = np.flatnonzero((x > 0).any(1))
                    yield pa.RecordBatch.from_arrays([b.column("w").take(pa.array(at)), pa.array(x[at].tolist(), pa.list_(pa.float64()))], ["w", "n"])

        words = counted.where("more").groupBy("w").agg(*sums).join(rare, "w", "left_semi")
        weights = scratch.keep(words.mapInArrow(weigh, "w long, n array<double>"), "weights")
    counts[:, :-1] += EXAMPLE * SURE * own
    counts[:, -1] += EXAMPLE * (1 - SURE) * own.sum(1)
    return Terms(terms.words, _weights(counts, share)), weights


def with_rare(texts: DataFrame, terms: Terms, weights: DataFrame | None) -> DataFrame:
    """``texts`` with ``rare``: their words that are in ``weights`` (w, n), and the weights. ``texts`` has ``row``, a
    number for each row. Only words that the terms lack are shuffled."""
    if weights is None:
        return texts
    shared = texts.sparkSession.sparkContext.broadcast(terms.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for b in batches:
            t = Text.of_batch(b)
            lost = index.find(t.w) < 0
            row, w = t.doc[t.of[lost]], t.w[lost]
            order = np.lexsort((w, row))
            row, w = row[order], w[order]
            one = np.r_[True, (row[1:] != row[:-1]) | (w[1:] != w[:-1])] if len(w) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(row[one])), pa.array(w[one])], ["row", "w"])

    found = texts.select("row", "s", "form").mapInArrow(run, "row long, w long").join(weights, "w").groupBy("row").agg(F.collect_list(F.struct("w", "n")).alias("rare"))
    return texts.join(found, "row", "left")


def _rare(batch: pa.RecordBatch) -> dict[int, list[float]]:
    """The weights that came with the rows."""
    if "rare" not in batch.schema.names:
        return {}
    return {x["w"]: x["n"] for r in batch.column("rare").to_pylist() for x in r or []}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 40) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.eye(x.shape[1]) * ridge
    keep[-1, -1] = 1e-3
    loss = lambda w: np.logaddexp(0, np.where(y > 0.5, -1, 1) * (x @ w)).sum() + 0.5 * w @ keep @ w
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + keep @ w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + keep
        d = np.linalg.solve(h, g)
        while (new := loss(w - d)) > now and np.abs(d).max() > 1e-7:  # a step too long
            d = d / 2
        w, now = w - d, new
        if np.abs(d).max() < 1e-6:
            break
    return w


class Chain:
    """Logistic models in an order of subjects, each with the labels before it as features."""

    def __init__(self, order: list[int], source: bool = True, together: bool = True):
        """Without ``source`` or ``together`` these features are left out, to see what they do."""
        self.order, self.uses, self.together, self.models, self.scale = order, source, together, [], []

    def own(self, f: dict[str, np.ndarray], k: int) -> np.ndarray:
        need = np.ceil(PART * f["count"] - 1e-9)  # in whole sentences
        # sentences and parts above or below what is needed; half a sentence is the middle between too few and enough
        above = [np.clip(f[x][:, k] * f["count"] - need + 0.5, -3, 3) for x in ("hard", "soft")]
        part = [4 * np.clip(f[x][:, k] - PART, -PART, PART) for x in ("hard", "soft")]
        return np.stack([*above, *part, f["source"][:, k] * self.uses], 1)

    def before(self, y: np.ndarray, at: int) -> np.ndarray:
        return y[..., self.order[:at]] * self.together

    def fit(self, f: dict[str, np.ndarray], y: np.ndarray, g: dict[str, np.ndarray], z: np.ndarray) -> None:
        """Fit on f and y, calibrate on g and z."""
        for at, k in enumerate(self.order):
            m = logistic(np.hstack([self.own(f, k), f["form"], self.before(y, at)]), y[:, k])
            self.models.append(m)
            s = np.hstack([self.own(g, k), g["form"], self.before(z, at), np.ones((len(z), 1))]) @ m
            self.scale.append(logistic(s[:, None], z[:, k]))

    def decode(self, f: dict[str, np.ndarray]) -> np.ndarray:
        """The likeliest labels of each row by beam search: at each subject the ``BEAM`` best beginnings."""
        n, k = f["hard"].shape
        beams, score = np.zeros((n, 1, k)), np.zeros((n, 1))
        for at, s in enumerate(self.order):
            m, (slope, shift) = self.models[at], self.scale[at]
            x = np.hstack([self.own(f, s), f["form"]])
            d = x.shape[1]
            raw = (x @ m[:d] + m[-1])[:, None] + self.before(beams, at) @ m[d : d + at]
            v = np.clip(raw * slope + shift, -30, 30)
            yes = beams.copy()
            yes[:, :, s] = 1
            both, total = np.concatenate([yes, beams], 1), np.concatenate([score - np.log1p(np.exp(-v)), score - np.log1p(np.exp(v))], 1)
            best = np.argsort(-total, axis=1, kind="stable")[:, :BEAM]
            beams, score = np.take_along_axis(both, best[:, :, None], 1), np.take_along_axis(total, best, 1)
        return beams[:, 0].astype(bool)


def features(terms: Terms, t: Text, source: np.ndarray) -> dict[str, np.ndarray]:
    k = terms.weight.shape[1] - 1
    p = terms.classes(t, terms.index.find(t.w))
    hard = np.zeros((t.n, k + 1))
    if len(t.doc):
        hard = np.bincount(t.doc * (k + 1) + p.argmax(1), minlength=t.n * (k + 1)).reshape(t.n, k + 1)
    per = np.maximum(t.count, 1)[:, None]
    return {"soft": per_document(t, p)[:, :k] / per, "hard": hard[:, :k] / per, "count": t.count.astype(float), "source": source, "form": np.hstack([np.log1p(t.count)[:, None], t.form])}


class Model:
    def __init__(self, subjects: list[str], terms: Terms, chain: Chain, sources: dict[str | None, np.ndarray]):
        self.subjects, self.terms, self.chain, self.sources = subjects, terms, chain, sources

    def source(self, names: list[str | None], joined: list[list[float] | None] | None = None) -> np.ndarray:
        """Weights of sources; ``joined`` has those of sources that the model itself doesn't hold."""
        none = np.zeros(len(self.subjects))
        own = [self.sources.get(s, none) for s in names]
        return np.array([o if j is None else j for o, j in zip(own, joined or [None] * len(own))]).reshape(len(names), len(none))

    def labels(self, t: Text, names: list[str | None], rare: dict[int, list[float]] | None = None, joined: list[list[float] | None] | None = None) -> np.ndarray:
        f = features(self.terms | (rare or {}), t, self.source(names, joined))
        found = self.chain.decode(f) if t.n else np.zeros((0, len(self.subjects)), bool)
        return found & (f["hard"] + f["soft"] > 0)

    def classify(self, texts: list[str | None], names: list[str | None]) -> np.ndarray:
        """Labels of texts by words that the model holds."""
        docs = [[np.array([word_id(w) for w in s], np.int64) for s in sentences(t)] for t in texts]
        return self.labels(Text.of_sentences(docs, np.array([structure(t) for t in texts]).reshape(-1, FORM)), names)


class Corpus:
    """What composed documents are drawn by: which subjects stand together, how many a document has, the sources with
    their sizes and weights."""

    def __init__(self, together: np.ndarray, many: np.ndarray, names: list[str | None], size: np.ndarray, weight: np.ndarray):
        self.together, self.many, self.names, self.size, self.weight = together, many, names, size, weight


def composed(examples: list[tuple[str, list[np.ndarray]]], subjects: list[str], none: list[np.ndarray], form: np.ndarray, corpus: Corpus, n: int, seed: int) -> tuple[Text, np.ndarray, np.ndarray]:
    """Documents of example sentences and sentences of no subject, their labels, and the weights of their sources."""
    rng = np.random.default_rng(seed)
    k = len(subjects)
    pool: list[list[np.ndarray]] = [[] for _ in subjects]
    for s, x in examples:
        pool[subjects.index(s)] += x
    docs, labels, weights = [], np.zeros((n, k)), np.zeros((n, k))
    pair = corpus.together + 0.1
    alone = corpus.together.diagonal() + 1.0
    for i in range(n):
        own: list[int] = []
        for _ in range(int(rng.choice(len(corpus.many), p=corpus.many))):
            row = (alone if not own else pair[own].prod(0) ** (1 / len(own))).copy()
            row[own] = 0
            if row.sum() > 0:
                own.append(int(rng.choice(k, p=row / row.sum())))
        size = int(rng.integers(1, 13)) if rng.random() < 0.7 else int(rng.integers(13, 41))
        of = rng.choice([*own, -1], size, p=[*[0.75 / len(own)] * len(own), 0.25]) if own and none else rng.choice(own, size) if own else np.full(size, -1)
        lost = rng.random(size) < LOST
        said = [none[int(rng.integers(len(none)))] if (o < 0 or gone) and none else pool[o][int(rng.integers(len(pool[o])))] if o >= 0 and pool[o] else np.zeros(2, np.int64) for o, gone in zip(of.tolist(), lost)]
        for o in set(of.tolist()) - {-1}:
            labels[i, o] = float((of == o).mean() >= PART - 1e-9)
        if len(corpus.names):
            chance = np.log(corpus.size) + corpus.weight @ labels[i]
            weights[i] = corpus.weight[rng.choice(len(chance), p=softmax(chance[None])[0])]
        docs.append(said)
    at = rng.integers(max(len(form), 1), size=n)
    return Text.of_sentences(docs, form[at] if len(form) else np.zeros((n, FORM))), labels, weights


def with_sources(docs: DataFrame, weights: DataFrame | None) -> DataFrame:
    """``docs`` with ``joined``: the weights of its source, if they are in ``weights`` (src, joined)."""
    return docs if weights is None else docs.join(weights, F.col("source").eqNullSafe(F.col("src")), "left").drop("src")


def _label(shared, k: int):
    """Rows of (source, s, j, many, n): how many documents (s = -1) of a source, with each subject (j = -1), and with two
    subjects together, by how many they have. By the part of sentences alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = Text.of_batch(b)
            on = features(shared.value | _rare(b), t, np.zeros((t.n, k)))["hard"] >= PART - 1e-9
            source = pa.array(b.column("source")).dictionary_encode()
            code = pc.fill_null(source.indices, len(source.dictionary)).to_numpy(zero_copy_only=False)
            names = [*source.dictionary.to_pylist(), None]
            by = np.stack([np.bincount(code, minlength=len(names)), *(np.bincount(code[on[:, s]], minlength=len(names)) for s in range(k))])
            s, c = np.nonzero(by)
            out = [[names[i] for i in c], (s - 1).tolist(), [-1] * len(s), [0] * len(s), by[s, c].tolist()]
            many = on.sum(1)
            for size in np.unique(many).tolist():
                h = on[many == size].astype(np.int64)
                both = h.T @ h
                i, j = np.nonzero(both)
                for x, y in zip(out, ([None] * (len(i) + 1), [*i.tolist(), -1], [*j.tolist(), -1], [max(size, 1)] * len(i) + [size + 1], [*both[i, j].tolist(), len(h)])):
                    x += y
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *(pa.array(x, pa.int64()) for x in out[1:])], ["source", "s", "j", "many", "n"])

    return run


def fit(docs: DataFrame, examples: list[tuple[str, str]]) -> Model:
    """A model for (text, source) of ``docs`` from the labelled ``examples`` (subject, text)."""
    return fit_all(docs, examples)[0]


def fit_all(docs: DataFrame, examples: list[tuple[str, str]], **chain: bool) -> tuple[Model, DataFrame | None, DataFrame | None, DataFrame]:
    """A model; tables of the weights it doesn't hold, of rare words (w, n) and of small sources (src, joined), None if
    it holds all; and the cut texts of ``docs``, with all its other columns. ``chain``: see ``Chain``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "subjects")
    subjects = sorted({s for s, _ in examples})
    cases = [(s, [np.array([word_id(w) for w in x], np.int64) for x in sentences(t)]) for s, t in examples]
    cases = [(s, x) for s, x in cases if x]
    k = len(subjects)
    texts = scratch.keep(cut(docs, *(c for c in docs.columns if c != "text"), F.monotonically_increasing_id().alias("row")), "texts", dictionary_mb=4)
    known = scratch.keep(document_counts(texts).where(F.col("n") >= LEAST), "words")
    frequent = np.array([r.w for r in most_frequent(known, "n", VOCABULARY).select("w").collect()], np.int64)
    told = np.unique(np.concatenate([s for _, x in cases for s in x])) if cases else frequent[:0]
    words = np.union1d(frequent, told)
    rare = rare_weights = None
    if known.count() > len(frequent):
        rare = scratch.keep(known.select("w").join(F.broadcast(spark.createDataFrame([(int(w),) for w in words], "w long")), "w", "left_anti"), "rare")
    own = example_counts(cases, subjects, words)
    terms = first_terms(own, words)
    for _ in range(ROUNDS):
        terms, rare_weights = learn(texts, terms, own, scratch, rare, rare_weights)

    # source and co-occurrence statistics of all documents
    labelled = with_rare(texts.select("row", "source", "s", "form"), terms, rare_weights).mapInArrow(_label(spark.sparkContext.broadcast(terms), k), "source string, s long, j long, many long, n long")
    stats = scratch.keep(labelled.groupBy("source", "s", "j", "many").agg(F.sum("n").alias("n")), "stats")
    together, many = np.zeros((k, k)), np.full(k + 1, 0.0)
    for r in stats.where("many > 0").orderBy("many", "s", "j").collect():
        if r.s < 0:
            many[r.many - 1] += r.n
        else:
            together[r.s, r.j] += r.n / r.many
    sums = {r.s: r.n for r in stats.where("many = 0").groupBy("s").agg(F.sum("n").alias("n")).collect()}
    rate = np.array([(sums.get(i, 0) + 1) / (sums.get(-1, 0) + 20) for i in range(k)])
    seen = lambda i: F.try_element_at("m", F.lit(i).cast("long"))
    weight = [F.coalesce(F.log((seen(i) + F.lit(20 * float(rate[i]))) / ((F.col("all") + 20) * F.lit(float(rate[i])))), F.lit(0.0)) for i in range(k)]
    by_source = stats.where("many = 0").groupBy(F.col("source").alias("src")).agg(F.max(F.when(F.col("s") == -1, F.col("n"))).alias("all"), F.map_from_entries(F.collect_list(F.struct("s", "n"))).alias("m"))
    by_source = scratch.keep(by_source.select("src", "all", F.array(*weight).alias("joined")), "sources")
    lent = by_source.orderBy(F.desc("all"), "src").limit(max(SOURCES, LENT)).collect()
    large = lent[:SOURCES]
    sources: dict[str | None, np.ndarray] = {r.src: np.array(r.joined) for r in large}
    small_sources = None
    if by_source.count() > SOURCES:
        gone = F.broadcast(spark.createDataFrame([(r.src,) for r in large], "gone string"))
        small_sources = scratch.keep(by_source.select("src", "joined").join(gone, F.col("src").eqNullSafe(F.col("gone")), "left_anti"), "small")

    # sentences without a subject and the structure of texts, from a sample by hash
    known_rare: set[int] = set()
    chosen = texts.where(F.size("s") > 0).orderBy(F.xxhash64("s", F.lit(SEED)), "row").limit(SAMPLE).select("row", "s", "form")
    if rare_weights is not None:
        chosen = scratch.keep(chosen, "sample")
    part = with_rare(chosen, terms, rare_weights).orderBy(F.xxhash64("s", F.lit(SEED)), "row").toArrow().combine_chunks()
    held = terms
    for b in part.to_batches():
        held = held | {w: x for w, x in _rare(b).items() if w not in known_rare}
        known_rare |= _rare(b).keys()
    none: list[np.ndarray] = []
    form = np.zeros((0, FORM))
    for b in part.to_batches():
        t = Text.of_batch(b)
        clear = held.classes(t, held.index.find(t.w))[:, k] > 0.98
        ends = np.searchsorted(t.of, np.arange(len(t.doc) + 1))
        none += [t.w[ends[i] : ends[i + 1]] for i in np.flatnonzero(clear)]
        form = np.vstack([form, t.form])
    corpus = Corpus(together, (many + 1) / (many + 1).sum() if many.sum() else np.append(np.zeros(1), np.ones(k)) / k, [r.src for r in lent[:LENT]], np.array([float(r["all"]) for r in lent[:LENT]]), np.array([r.joined for r in lent[:LENT]]).reshape(-1, k))
    corpus.many = corpus.many[:4] / corpus.many[:4].sum()  # four subjects can't each have a quarter and more but in equal parts
    made, y, source = composed(cases, subjects, none, form, corpus, COMPOSED, SEED)
    f = features(held, made, source)
    half = COMPOSED // 2
    model = Model(subjects, terms, Chain(np.argsort(-together.diagonal(), kind="stable").tolist(), **chain), sources)
    model.chain.fit({c: x[:half] for c, x in f.items()}, y[:half], {c: x[half:] for c, x in f.items()}, y[half:])
    return model, rare_weights, small_sources, texts


def subjects_of(docs: DataFrame, examples: DataFrame, **chain: bool) -> DataFrame:
    """(doc_id, subject): one row for each subject that at least a quarter of the document's sentences are
    about.

    Reads doc_id, text and source of ``docs``, subject and text of ``examples``; other columns are not
    read. Null, empty and wordless texts have no subject; a null or unknown source weighs nothing. Rows
    repeated give one row. Without examples, or without documents, there are no rows. The examples are
    labelled by hand and so few: they are read to the driver.
    """
    spark = docs.sparkSession
    labelled = [(r.subject, r.text) for r in examples.select("subject", "text").dropna().orderBy("subject", "text").collect()]
    d = docs.select("doc_id", F.col("text"), F.col("source").cast("string").alias("source"))
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, subject string"
    if not labelled or d.isEmpty():
        return spark.createDataFrame([], schema)
    fitted, rare_weights, small_sources, texts = fit_all(d, labelled, **chain)
    model = spark.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for b in batches:
            joined = b.column("joined").to_pylist() if "joined" in b.schema.names else None
            row, s = np.nonzero(m.labels(Text.of_batch(b), b.column("source").to_pylist(), _rare(b), joined))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array([m.subjects[i] for i in s], pa.string())], ["doc_id", "subject"])

    return with_sources(with_rare(texts, fitted.terms, rare_weights), small_sources).mapInArrow(run, schema).distinct()
