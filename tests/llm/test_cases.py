"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftmark.llm import clusters, copies, leaks, near, overlaps, similar, subjects, tokenise
from tests.llm import brute


def pairs(df):
    return {tuple(r) for r in df.collect()}


# names that the operators use inside
CLASH = ["id", "h", "key", "word", "n", "set", "terms", "sig", "cell", "v", "doc", "w", "pos", "salt", "k1", "first", "mark", "fields"]


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


def test_encoding(spark):
    long = "word " * 40_000 + "x" * 20_000
    data = [(1, None), (2, ""), (3, "  \n\n  a"), (4, "It's <|endoftext|> 12,345… 日本語 é​!"), (5, long), (3, "  \n\n  a"), (6, "\x1c\x1d \x85")]
    got = {r.doc_id: list(r.ids) for r in tokenise.encode(clashing(spark.createDataFrame(data, "doc_id long, text string")), "doc_id", "text").collect()}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokenise.tokenizer_dir()}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    assert got == {i: t.encode(x, add_special_tokens=False).ids if x else [] for i, x in data}
    assert not tokenise.encode(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").collect()


def test_decoding(spark):
    coded = spark.createDataFrame([(1, []), (2, None), (3, [15496, 995]), (4, [99999])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in tokenise.decode(coded).collect()} == {1: "", 2: "", 3: "Hello world", 4: ""}


def test_input_copies(spark):
    data = [(9, "query: A b"), (2, " QUERY :a  B!"), (3, "document: a b"), (4, "a b"), (5, "query: b a"), (6, "query: x|y;z"), (7, "query: Z\ny ; ; X"), (8, "query: x|x|y|z"), (10, "query: ..."), (11, "query: ?"), (12, None), (13, ""), (2, " QUERY :a  B!"), (14, "query: x y|z")]
    got = pairs(copies.input_copies(clashing(spark.createDataFrame(data, "sample_id long, input string"))))
    assert got == brute.p2_inputs(data) == {(2, 9), (6, 7)}
    assert not pairs(copies.input_copies(spark.createDataFrame([], "sample_id long, input string")))


def test_list_copies(spark):
    data = [(1, ["a b", None, " "]), (2, ["A-B"]), (3, ["a b", "a b"]), (4, None), (5, []), (6, [None]), (7, ["c", "a b"]), (8, ["a b", "C!"])]
    t = spark.createDataFrame(data, "doc_idx long, pseudo_queries array<string>")
    found = copies.list_copies(t)
    assert pairs(found) == brute.p2_lists(data) == {(1, 2), (7, 8)}
    assert pairs(copies.kept(t, "doc_idx", found)) == {(1, 2), (3, 1), (4, 1), (5, 1), (6, 1), (7, 2)}


def test_one_hot_class(spark):
    """A third of all rows are copies of one record."""
    t = spark.range(3000).select(F.col("id").alias("sample_id"), F.when(F.col("id") % 3 == 0, "query: Hot one").otherwise(F.concat(F.lit("query: q"), F.col("id").cast("string"))).alias("input"))
    got = pairs(copies.input_copies(t))
    assert got == {(0, i) for i in range(3, 3000, 3)}


WORDS = st.lists(st.sampled_from("abcdefghij"), max_size=7).map(" ".join)


@settings(max_examples=4, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=25), st.lists(WORDS, min_size=1, max_size=25))
def test_overlaps_match_brute_force(spark, left, right):
    a, b = list(enumerate(left)), list(enumerate(right))
    got = pairs(overlaps.overlaps(spark.createDataFrame(a, "query_idx long, input string"), spark.createDataFrame(b, "sample_id long, input string")))
    assert got == brute.jaccard_pairs(a, b, 0.75)


def test_overlap_edges(spark):
    h = [(1, "query: one two three four"), (2, None), (3, "query: "), (1, "query: one two three four"), (4, "document:one TWO three, four")]
    t = [(7, "ONE two. three"), (8, None), (9, "one two"), (7, "ONE two. three")]
    q = clashing(spark.createDataFrame(h, "query_idx long, input string"))
    s = clashing(spark.createDataFrame(t, "sample_id long, input string"))
    assert pairs(overlaps.overlaps(q, s)) == {(1, 7), (4, 7)}
    assert not pairs(overlaps.overlaps(q.limit(0), s))


@settings(max_examples=4, deadline=None)
@given(st.lists(WORDS, min_size=2, max_size=40))
def test_near_matches_brute_force(spark, texts):
    data = list(enumerate(texts))
    got = pairs(near.near_pairs(spark.createDataFrame(data, "key long, text string")))
    assert got == brute.jaccard_pairs(data, None, 0.7)


@pytest.mark.parametrize("light", [1, 4])
def test_near_with_heavy_words(light):
    """Signatures of two and three words: with a low limit, every pair above the threshold still has a common one."""
    rng = np.random.default_rng(light)
    sets = [np.unique(rng.choice(60, rng.integers(3, 40))).astype(np.int64) for _ in range(150)]
    sets += [np.unique(np.append(np.delete(s, rng.integers(len(s), size=len(s) // 8)), rng.choice(60, 1))) for s in sets]
    words, df = np.unique(np.concatenate(sets), return_counts=True)
    order, old = near.Order(words, df, len(sets)), near.LIGHT
    near.LIGHT = light
    try:
        w, row, d = order.sort(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
        sizes = np.array([len(s) for s in sets])
        sig, r, _, kind = near.signatures(w, row, d, sizes, len(sets), 0.7)
    finally:
        near.LIGHT = old
    have = [{} for _ in sets]
    for s, i, k in zip(sig.tolist(), r.tolist(), kind.tolist()):
        have[i].setdefault(k, set()).add(s)
    n = 0
    for i in range(len(sets)):
        for j in range(len(sets)):
            common = len(np.intersect1d(sets[i], sets[j]))
            total = len(sets[i]) + len(sets[j]) - common
            if i != j and len(sets[i]) >= len(sets[j]) and common >= 0.7 * total - 1e-9 and common < total:
                n += 1
                plain = any(have[i].get(k, set()) & have[j].get(k, set()) for k in (1, 2, 3))
                assert plain or have[i].get(near.LARGE, set()) & have[j].get(near.SMALL, set())
    assert n > 20


def test_near_edges(spark):
    data = [(1, "a b c"), (2, "C, b; A"), (3, None), (4, ""), (5, "..."), (6, "a b c d"), (1, "a b c"), (7, "z" * 100_000)]
    t = clashing(spark.createDataFrame(data, "key long, text string"))
    assert pairs(near.near_pairs(t)) == {(1, 2), (1, 6), (2, 6)}
    assert pairs(near.near_groups(t)) == {(1, 1, 1), (2, 1, 1), (6, 6, 1), (7, 7, 0)}
    assert not pairs(near.near_pairs(t.limit(0)))


@pytest.mark.parametrize("group,chunk", [(3, 5), (3, 400_000), (20_000, 7)])
def test_signatures_of_many_sets(spark, group, chunk):
    """Large signatures are joined elsewhere, and parts of one that come in several chunks are put together."""
    rng = np.random.default_rng(7)
    data = [(i, " ".join(rng.choice(list("abcdefghijklm"), rng.integers(1, 12)))) for i in range(120)]
    got = pairs(near.near_pairs(spark.createDataFrame(data, "key long, text string"), 0.7, group, chunk))
    assert got == brute.jaccard_pairs(data, None, 0.7)


def test_large_sets_of_a_frequent_word(monkeypatch):
    """They meet the few small sets of that word while they pass, in batches of any size; none is kept to be joined to the others."""
    monkeypatch.setattr(near, "LIGHT", 4)
    rng = np.random.default_rng(3)
    base = [rng.choice(150, 45, replace=False).astype(np.int64) for _ in range(300)]
    sets = base + [s[:35] for s in base[:20]] + [s[:-3] for s in base[20:40]]
    words, df = np.unique(np.concatenate(sets), return_counts=True)
    order = type("Sent", (), {"value": near.Order(words, df, len(sets))})
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(sets))), pa.array(range(len(sets))), pa.array(sets, pa.list_(pa.int64()))], ["key", "id", "terms"])
    rows = pa.Table.from_batches(near._signature_rows(order, 0.7)([rows])).sort_by("sig").combine_chunks()
    out = pa.concat_tables(pa.Table.from_batches([b]) for b in near._meet(0.7, 90, 64)(iter(rows.to_batches(max_chunksize=50))))
    assert out["sig"].null_count == len(out)
    got = set(zip(out["a"].to_pylist(), out["b"].to_pylist()))
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if (c := len(np.intersect1d(sets[i], sets[j]))) >= 0.7 * (len(sets[i]) + len(sets[j]) - c) - 1e-9}
    assert len(want) >= 40 and want <= got


def test_copies_and_waves(spark, monkeypatch):
    """Copies of one text meet others once, and sets whose signatures are made in several waves give the same pairs."""
    monkeypatch.setattr(near, "WAVES", (5, 10))
    rng = np.random.default_rng(11)
    some = [" ".join(rng.choice(list("abcdefghijklm"), rng.integers(1, 12))) for _ in range(30)]
    data = list(enumerate(some * 4))
    assert pairs(near.near_pairs(spark.createDataFrame(data, "key long, text string"))) == brute.jaccard_pairs(data, None, 0.7)


def test_passages(spark):
    raw = spark.createDataFrame([(1, (["a", None, "b"],)), (2, (None,)), (3, None), (None, (["x"],))], "line_no long, passages struct<passage_text: array<string>>")
    assert pairs(near.passages(raw)) == {(100, "a"), (102, "b")}


def vectors(spark, rows):
    return clashing(spark.createDataFrame(rows, "doc_idx long, embedding array<float>"))


def noisy(centre, n, noise, seed):
    rng = np.random.default_rng(seed)
    return [(centre + noise * rng.standard_normal(64)).astype(np.float32) for _ in range(n)]


def made_vectors():
    rng = np.random.default_rng(1)
    out = []
    for k in range(12):
        out += noisy(3 * rng.standard_normal(64), 3 + k, 0.5, k)
    a, b = rng.standard_normal(64), rng.standard_normal(64)
    out += [np.cos(t) * a / np.linalg.norm(a) + np.sin(t) * b / np.linalg.norm(b) for t in np.arange(0, 2.4, 0.3)]  # a chain
    out += [out[0], out[0] * 2, out[0] * 0.25]  # ties
    rows = [(int(i) * 7 % 1000, [float(np.float32(x)) for x in v]) for i, v in enumerate(out)]
    bad = [(2001, None), (2002, [1.0] * 63), (2003, [0.0] * 64), (2004, [float("nan")] + [1.0] * 63), (2005, [None] + [1.0] * 63), (2006, [float("inf")] * 64), (None, rows[0][1])]
    return rows, rows + bad + rows[:5]


def test_clusters(spark):
    rows, all_rows = made_vectors()
    assert pairs(clusters.clusters(vectors(spark, all_rows), "doc_idx", "embedding")) == brute.p1(rows)
    assert not pairs(clusters.clusters(vectors(spark, all_rows).limit(0), "doc_idx", "embedding"))


def test_cluster_description(spark):
    rows, all_rows = made_vectors()
    found = clusters.clusters(vectors(spark, all_rows), "doc_idx", "embedding")
    codes = spark.createDataFrame([(r[0], [r[0] % 2, 5]) for r in rows] + [(rows[0][0], None)], "doc_idx long, codes array<int>")
    got = {r.cluster_idx: r for r in clusters.described(vectors(spark, all_rows), "doc_idx", "embedding", codes, found).collect()}
    size = {}
    for c, d in brute.p1(rows):
        size.setdefault(c, []).append(d)
    assert {c: r["size"] for c, r in got.items()} == {c: len(d) for c, d in size.items()}
    assert all(set(r.typical) <= set(size[c]) and len(r.typical) == 5 and r.codes[1] == 5 for c, r in got.items())


def test_neighbours(spark):
    rows, all_rows = made_vectors()
    assert pairs(similar.similar_pairs(vectors(spark, all_rows), "doc_idx", "embedding")) == brute.p5(rows)
    assert not pairs(similar.similar_pairs(vectors(spark, [(1, None)]), "doc_idx", "embedding"))


def test_blocks_of_a_large_cell(spark, monkeypatch):
    """A cell above the block size is cut, and its pairs of blocks find the same."""
    from siftmark.llm import vectors as v

    monkeypatch.setattr(v, "BLOCK", 16)
    rows, all_rows = made_vectors()
    assert pairs(similar.similar_pairs(vectors(spark, all_rows), "doc_idx", "embedding")) == brute.p5(rows)
    assert pairs(clusters.clusters(vectors(spark, all_rows), "doc_idx", "embedding")) == brute.p1(rows)


def test_table_scan_is_the_sum_of_tables():
    rng = np.random.default_rng(0)
    u = rng.standard_normal((300, 64)).astype(np.float32)
    u /= np.linalg.norm(u, axis=1)[:, None]
    books = similar.fit_books(u, u)
    codes = similar.encode(u, u, books)
    back = np.concatenate([books[p][codes[:, p]] for p in range(similar.PARTS)], 1)
    got = similar.scan(u[:7], codes, np.full(300, 2, np.float32), books, np.ones((1, 7), np.float32))
    assert np.allclose(got, 2 * back @ u[:7].T + 1, atol=1e-4)


def test_anisotropic_codes_keep_inner_products():
    """Against codes of the nearest codeword, the parallel error is less."""
    rng = np.random.default_rng(2)
    u = rng.standard_normal((2000, 64)).astype(np.float32)
    u /= np.linalg.norm(u, axis=1)[:, None]
    books = similar.fit_books(u, u)
    near_codes, aware = similar.encode(u, u, books, 0), similar.encode(u, u, books, 2)
    back = lambda c: np.concatenate([books[p][c[:, p]] for p in range(similar.PARTS)], 1)
    along = lambda c: float((((u - back(c)) * u).sum(1) ** 2).mean())
    assert along(aware) < 0.5 * along(near_codes)


def test_leaks(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = [(1, "x " + item.upper().replace(" ", ", ")), (2, " ".join(item.split()[4:16])), (3, " ".join(item.split()[4:15])), (4, None), (5, ""), (6, "Short one!"), (1, "x " + item), (7, "pad " * 50_000 + item)]
    items = [(10, item), (11, "short ONE"), (12, None), (13, "..."), (14, "")]
    d = clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    i = clashing(spark.createDataFrame(items, "item_id long, text string"))
    assert pairs(leaks.find_leaks(d, i)) == {(1, 10), (2, 10), (6, 11), (7, 10)}
    assert not pairs(leaks.find_leaks(d.limit(0), i)) and not pairs(leaks.find_leaks(d, i.limit(0)))


def test_leaks_with_edits(spark):
    """Three pieces of a window with up to two word edits."""
    rng = np.random.default_rng(4)
    item = [f"w{i}" for i in rng.permutation(40)]
    docs = []
    for k in range(60):
        w = item[10:22]
        for _ in range(int(rng.integers(0, 5))):
            p = int(rng.integers(len(w)))
            w = [w[:p] + w[p + 1 :], w[:p] + ["new"] + w[p:], w[:p] + ["new"] + w[p + 1 :]][int(rng.integers(3))]
        docs.append((k, " ".join(["a", "b", *w, "c"])))

    def least(pattern, text):
        d = list(range(len(pattern) + 1))
        best = d[-1]
        for c in text:
            prev, d[0] = d[0], 0
            for i, x in enumerate(pattern):
                prev, d[i + 1] = d[i + 1], min(prev + (x != c), d[i] + 1, d[i + 1] + 1)
            best = min(best, d[-1])
        return best

    want = {(k, 1) for k, t in docs if min(least(item[s : s + 12], t.split()) for s in range(len(item) - 11)) <= 2}
    got = pairs(leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"), budget=2))
    assert got == want and 0 < len(want) < len(docs)
    assert all(leaks.myers(p, t) == least(p, t) for p, t in [(item[:12], docs[k][1].split()) for k in range(20)])


def test_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 3)
    docs = spark.createDataFrame([(1, "alpha beta gamma delta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, "beta gamma"), (4, "delta alpha")], "item_id long, text string")
    assert pairs(leaks.find_leaks(docs, items)) == {(1, 1), (1, 2), (1, 3)}
    # an item of more words than a block, of which the last two stand in the text
    long = spark.createDataFrame([(1, "a b c d e f g h gamma delta"), (2, "a b c d")], "item_id long, text string")
    for budget, want in ((0, {(1, 1)}), (1, {(1, 1)})):
        assert pairs(leaks.find_leaks(docs, long, window=2, budget=budget)) >= want


def test_window_of_many_items(spark):
    """A window that 400 items share, in a text that repeats it."""
    text = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([(i, f"x{i} {text}") for i in range(400)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{text} and " * 30), (2, "other words")], "doc_id long, text string")
    assert pairs(leaks.find_leaks(docs, items)) == {(1, i) for i in range(400)}


def test_deletion_variants_of_segments():
    """The method named for problem 4, as a measured prototype: words as bits, cut by hash into half as many segments as
    two sets may differ in words, plus one; a segment and its variants with one word left out are signatures. It finds
    every pair, but candidates grow as the square of the rows where words are few and frequent, which is why
    ``near`` has other signatures; these find fewer candidates on the same sets."""

    def candidates(sets, share=0.7):
        by = {}
        for i, s in enumerate(sets):
            for m in range(int(len(s) * share), int(len(s) / share) + 2):
                differ = int((1 - share) / (1 + share) * (len(s) + m) + 1e-9)
                cuts = differ // 2 + 1
                for k in range(cuts):
                    part = frozenset(w for w in s if w * 2654435761 % 97 % cuts == k)
                    for variant in [part, *(part - {w} for w in part)]:
                        by.setdefault((min(len(s), m), max(len(s), m), k, variant), set()).add(i)
        out = set()
        for members in by.values():
            m = sorted(members)
            out.update((a, b) for x, a in enumerate(m) for b in m[x + 1 :])
        return out

    counts = []
    for n in (150, 600):
        rng = np.random.default_rng(n)
        chance = 1 / np.arange(1, 121)
        sets = [set(rng.choice(120, rng.integers(8, 20), replace=False, p=chance / chance.sum()).tolist()) for _ in range(n)]
        sets += [set(sorted(s)[1:]) for s in sets[: n // 10]]
        got = candidates(sets)
        want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b]) - 1e-9}
        assert want <= got  # exact: two sets above the threshold have a segment that differs in one word at most
        counts.append((len(got), len(want), len(sets) * (len(sets) - 1) // 2))
    print(counts)
    assert counts[1][0] > 8 * counts[0][0]  # four times the rows: a steady part of all pairs
    assert counts[1][0] > 20 * counts[1][1]


def test_subjects_edges(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "s"), (3, "123 ...", None), (1, None, None)], "doc_id long, text string, source string")
    examples = spark.createDataFrame([("law", "The judge heard the lawsuit."), ("food", "The onion was in the soup."), (None, "x y"), ("law", None)], "subject string, text string")
    assert not pairs(subjects.subjects_of(clashing(docs), clashing(examples)))
    assert not pairs(subjects.subjects_of(docs.limit(0), examples)) and not pairs(subjects.subjects_of(docs, examples.limit(0)))


def test_sentences():
    text = "One two. Three 4.5 four?\n<p>Five six</p><p>seven eight</p>\n1. nine ten\n2. x"
    assert subjects.sentences(text) == [["one", "two"], ["three", "four"], ["five", "six"], ["seven", "eight"], ["nine", "ten"]]
    assert subjects.sentences(None) == []


def test_subject_word_of_few_documents(spark):
    """A word in three of 5,000 documents is weighed, and a long one too."""
    long = "q" * 50
    told = [f"The comet passed. A zyxan rose {k}. The {long} rose." for k in range(3)]
    rows = [(i, told[i] if i < 3 else f"Plain words stand here {i}. Others stand there.", "s") for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    model = subjects.fit(docs.drop("doc_id"), [("sky", "The comet passed."), ("sea", "The whale swam.")])
    for w in ("zyxan", long):
        assert model.terms.weight[model.terms.index[w], 1] > 0


def test_joined_weights_are_as_good_as_held_ones(spark, sf, monkeypatch):
    docs, examples = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/subject_examples.parquet").where("example_id % 9 = 0")
    docs = clashing(docs)
    held = pairs(subjects.subjects_of(docs, clashing(examples)))
    monkeypatch.setattr(subjects, "VOCABULARY", 30)
    monkeypatch.setattr(subjects, "SOURCES", 1)
    model, rare, small, _ = subjects.fit_all(docs.select("text", "source"), [(r.subject, r.text) for r in examples.orderBy("subject", "text").collect()])
    assert rare.count() and small.count()
    assert held and pairs(subjects.subjects_of(docs, clashing(examples))) == held


def test_neighbours_among_many_copies(spark):
    """500 copies of one vector, of which the ten smallest ids are everyone's neighbours, and 300 near ones."""
    rng = np.random.default_rng(4)
    c = rng.normal(size=64)
    ids = rng.permutation(800).tolist()
    rows = [(ids[i], [float(x) for x in np.float32(c if i < 500 else c + 1e-4 * rng.normal(size=64))]) for i in range(800)]
    assert pairs(similar.similar_pairs(vectors(spark, rows), "doc_idx", "embedding")) == brute.p5(rows)


def test_every_link_is_probed():
    """Any two vectors with a cosine of 0.9 or more: one probes the other's cell, also in a loose region that
    holds most centres."""
    from siftmark.llm import vectors as v

    rng = np.random.default_rng(5)
    x = v.unit(rng.normal(size=64) * 0.5 + rng.normal(size=(3000, 64)))
    side = rng.normal(size=x.shape)
    side = v.unit(side - (side * x).sum(1)[:, None] * x)
    y = 0.9 * x + (1 - 0.81) ** 0.5 * side
    c = v.fit_cells(x.astype(np.float32), 400)

    def probed(z):
        out = np.zeros((len(z), len(c)), bool)
        row, cell, _ = v.probes(z.astype(np.float32), c)
        out[row, cell] = True
        return out

    a, b = v.nearest(x.astype(np.float32), c)[0], v.nearest(y.astype(np.float32), c)[0]
    at = np.arange(len(x))
    assert (probed(x)[at, b] | probed(y)[at, a]).all()


def components(n, a, b):
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        if (new == label).all():
            return label
        label = new


def graph(seed):
    """Cliques, chains, stars and pairs, whose nodes are mixed up."""
    rng = np.random.default_rng(seed)
    a, b, n = [], [], 0
    for size in (300, 40, 7, 2, 2, 3, 25):
        i, j = np.triu_indices(size, 1)
        a, b, n = [*a, *(i + n)], [*b, *(j + n)], n + size
    for size in (60, 200):  # chains
        a, b, n = [*a, *(np.arange(size - 1) + n)], [*b, *(np.arange(1, size) + n)], n + size
    for size in (50, 9):  # stars
        a, b, n = [*a, *([n] * (size - 1))], [*b, *(np.arange(1, size) + n)], n + size
    mixed = rng.permutation(n)
    return n, mixed[np.array(a)], mixed[np.array(b)], rng.uniform(0.9, 1, len(a))


@pytest.mark.parametrize("seed", range(5))
def test_spectral_clusters_are_the_linked_sets(seed):
    n, a, b, w = graph(seed)
    got = clusters.spectral(np.arange(n) * 7 + seed, a, b, w)
    want = components(n, a, b)
    assert len(np.unique(got)) == len(np.unique(want)) == len(set(zip(got.tolist(), want.tolist())))


def test_without_power_iteration_nothing_is_clustered():
    """The places of the random vectors alone put every node in a cluster of its own, those after the
    iteration put linked ones together: it is the iteration that decides."""
    n, a, b, w = graph(1)
    alone = clusters.k_means(clusters.places(clusters.starts(np.arange(n))))
    assert len(np.unique(alone)) == n
    assert not (alone[a] == alone[b]).any()


def test_places_do_not_shrink_with_size():
    """Two cliques of 3,000 nodes, each joined by a star of stars: means of random starts are small, places are not."""
    m = 3000
    a = np.concatenate([np.arange(1, m), np.arange(m + 1, 2 * m)])
    b = np.concatenate([np.arange(1, m) // 9, m + np.arange(1, m) // 9])
    got = clusters.spectral(np.arange(2 * m), a, b, np.ones(len(a)))
    assert len(set(got[:m].tolist())) == len(set(got[m:].tolist())) == 1 and got[0] != got[m]


def test_clusters_across_groups(spark, monkeypatch):
    """Groups of few vectors, so that clusters lie in several of them and are joined in the second graph."""
    from siftmark.llm import vectors as v

    monkeypatch.setattr(v, "BLOCK", 8)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(c + 0.33 * rng.normal(size=64))]) for i, c in enumerate(np.repeat(rng.normal(size=(6, 64)), 40, axis=0))]
    rows += [(1000 + k, rows[5][1]) for k in range(30)]  # copies of one, and copies that are linked to nothing else
    rows += [(2000 + k, [float(k == 2000)] * 63 + [1.0]) for k in range(6)]
    assert pairs(clusters.clusters(vectors(spark, rows), "doc_idx", "embedding")) == brute.p1(rows)


def test_neighbours_in_tight_clusters(spark):
    """Clusters far tighter than the code error, of more members than k, beside loose ones: recall against brute force."""
    rng = np.random.default_rng(6)
    rows = []
    for c, (noise, size) in enumerate([(1e-5, 300), (1e-3, 200), (0.1, 150), (0.25, 150)]):
        centre = rng.normal(size=64)
        rows += [(1000 * c + k, [float(x) for x in np.float32(centre + noise * rng.normal(size=64))]) for k in range(size)]
    want = brute.p5(rows)
    got = pairs(similar.similar_pairs(vectors(spark, rows), "doc_idx", "embedding"))
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_cut_matches_plain_sentences(spark):
    texts = [None, "", "One two. Three 4.5 four?\n<p>Five six</p><p>Seven eight</p>\n1. nine ten\n2. x", "Ärger über Öl.\u2028Zwei drei。四五 六七！八 九", "<" + "x" * 500 + ">a b<c d", "a b. " * 3000]
    got = subjects.cut(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "i").orderBy("i").collect()
    for r, t in zip(got, texts):
        assert r.s == [[subjects.word_id(w) for w in x] for x in subjects.sentences(t)]
        assert r.form == subjects.structure(t)


def noisy_corpus(seed, n=1500):
    """(text, source, labels): of four subjects, a and b stand together, c has its own sources; many subject sentences
    have no subject word."""
    rng = np.random.default_rng(seed)
    own = {s: [f"{s}noun{chr(97 + i)}" for i in range(12)] for s in "abcd"}
    plain = [f"plain{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(6)]
    out = []
    for _ in range(n):
        subjects_ = [["a", "b"], ["c"], ["d"], []][int(rng.choice(4, p=[0.4, 0.25, 0.2, 0.15]))]
        source = "cs" if (rng.random() < 0.9 if "c" in subjects_ else rng.random() < 0.03) else f"s{rng.integers(4)}"
        size = int(rng.integers(4, 12))
        of = rng.choice([*subjects_, ""], size, p=[*[0.75 / len(subjects_)] * len(subjects_), 0.25]) if subjects_ else [""] * size
        said = []
        for o in of:
            words = [str(x) for x in rng.choice(plain, 5)]
            if o and rng.random() > 0.3:
                words[2] = str(rng.choice(own[o]))
            said.append(" ".join(words) + ".")
        labels = {s for s in subjects_ if (np.array(of) == s).mean() >= 0.25}
        out.append((" ".join(said), source, labels))
    examples = [(s, f"plainaa {w} plainba. plainca {own[s][(i + 1) % 12]}.") for s in own for i, w in enumerate(own[s])]
    return out, examples


def test_chain_uses_sources_and_cooccurrence(spark, monkeypatch):
    """On a corpus with lost subject words, the chain finds more right labels than the plain quarter of the sentences
    seen, and less without sources or without the other labels."""
    monkeypatch.setattr(subjects, "LOST", 0.3)
    made, examples = noisy_corpus(11)
    docs = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(made)], "doc_id long, text string, source string")
    cases = spark.createDataFrame(examples, "subject string, text string")
    want = {(i, s) for i, (_, _, labels) in enumerate(made) for s in labels}

    def f1(got):
        return 2 * len(got & want) / (len(got) + len(want))

    full = f1(pairs(subjects.subjects_of(docs, cases)))
    no_source = f1(pairs(subjects.subjects_of(docs, cases, source=False)))
    no_labels = f1(pairs(subjects.subjects_of(docs, cases, together=False)))
    model = subjects.fit(docs.drop("doc_id"), examples)
    t = subjects.Text.of_sentences([[np.array([subjects.word_id(w) for w in s], np.int64) for s in subjects.sentences(x)] for x, _, _ in made], np.zeros((len(made), subjects.FORM)))
    hard = subjects.features(model.terms, t, np.zeros((t.n, 4)))["hard"]
    plain = f1({(int(i), model.subjects[k]) for i, k in zip(*np.nonzero(hard >= 0.25))})
    print(full, no_source, no_labels, plain)
    assert full > plain + 0.03
    assert full > no_source and full > no_labels


def test_labels_do_not_depend_on_the_size_of_the_table(spark, sf):
    """The same documents and the same terms give the same labels in any table."""
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("text", "source").limit(60).collect()]
    examples = [(r.subject, r.text) for r in spark.read.parquet(f"{sf}/subject_examples.parquet").collect()]
    model = subjects.fit(spark.createDataFrame(docs), examples)
    whole = model.classify([r.text for r in docs], [r.source for r in docs])
    assert all((model.classify([r.text], [r.source]) == whole[i]).all() for i, r in enumerate(docs[:20]))


def test_each_bound_prunes(spark):
    """Pairs that meet in a list and aren't above the threshold: each bound rejects some that the other lets pass, and
    none rejects a pair above it."""
    rng = np.random.default_rng(8)
    base = [set(rng.choice(80, rng.integers(6, 22), replace=False).tolist()) for _ in range(120)]
    near_ = [set(rng.permutation(sorted(s))[1:].tolist()) | {int(rng.integers(80))} for s in base]
    df = {t: sum(t in s for s in base + near_) for t in range(80)}

    def frame(sets):
        rows = [(i, len(s), sorted((int(np.int64(t * 7919)) for t in s), key=lambda x: (df[x // 7919], x))) for i, s in enumerate(sets)]
        return spark.createDataFrame(rows, "set long, n int, terms array<long>").withColumn("norms", overlaps._packed(F.col("terms")))

    n, i, m, j = (F.col(c) for c in "nimj")
    got = overlaps.met(frame(base), frame(near_), 0.75).select("l", "r", overlaps._maxima(n, i, m, j, 0.75).alias("x"), overlaps._norms(F.col("a"), n, F.col("b"), m, 0.75).alias("y")).collect()
    assert sum(not r.x and r.y for r in got) > 20 and sum(r.x and not r.y for r in got) > 20
    passed = {(r.l, r.r) for r in got if r.x and r.y}
    want = {(a, b) for a, s in enumerate(base) for b, t in enumerate(near_) if len(s & t) >= 0.75 * len(s | t)}
    assert want and want <= passed


def shuffle_files(spark):
    from pathlib import Path

    return {p for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for p in Path(d).rglob("shuffle_*.data")}


def test_kept_tables_leave_no_shuffle_files(spark):
    from siftmark.runtime import Scratch

    scratch, rows, before = Scratch(spark, "swept"), spark.range(5000).repartition(3, "id"), shuffle_files(spark)
    kept = scratch.keep(rows, "rows")
    assert not shuffle_files(spark) - before
    assert kept.count() == 5000


def test_waves_are_bounded_and_find_the_same(spark, monkeypatch):
    """Vectors that probe many regions are sent in waves of about as many rows as there are vectors, each pair of blocks once."""
    from siftmark.llm import vectors as v
    from siftmark.runtime import Scratch

    monkeypatch.setattr(v, "BLOCK", 16)
    monkeypatch.setattr(v, "WAVE", 1)
    rows, all_rows = made_vectors()
    assert pairs(similar.similar_pairs(vectors(spark, all_rows), "doc_idx", "embedding")) == brute.p5(rows)
    assert pairs(clusters.clusters(vectors(spark, all_rows), "doc_idx", "embedding")) == brute.p1(rows)
    scratch = Scratch(spark, "waves")
    unique, _, n = v.one_each(vectors(spark, all_rows), "doc_idx", "embedding", scratch)
    cells = v.Cells(v.fit_cells(v.sample(unique, n), v.cells_for(n)), n)
    waves = v.meetings(unique, cells, scratch)
    sizes = [w.count() for w in waves]
    per_block = max(max(r["count"] for r in w.groupBy("cell", "j").count().collect()) for w in waves)
    assert len(waves) > 1 and sum(sizes) > n and max(sizes) <= n + per_block
    groups = [(r.cell, r.j, r.i) for w in waves for r in w.select("cell", "j", "i").distinct().collect()]
    assert len(groups) == len(set(groups))


def test_probes_take_few_distances(monkeypatch):
    """The distances between centres are those of the own centres only, not the square of all centres."""
    from siftmark.llm import vectors as v

    c = v.unit(np.random.default_rng(2).normal(size=(4000, 64))).astype(np.float32)
    seen, sqrt = [], np.sqrt
    monkeypatch.setattr(v.np, "sqrt", lambda x: (seen.append(np.size(x)), sqrt(x))[1])
    row, cell, rank = v.probes(c[:20], c)
    assert sorted(row[rank == 0]) == list(range(20)) and sorted(cell[rank == 0]) == list(range(20))
    assert max(seen) <= 20 * 4000


def test_vectors_are_not_shuffled_to_the_regions_they_probe(spark, monkeypatch):
    """Tasks read the others' files; what they find is what the shuffled groups give."""
    from siftmark.llm import clusters, vectors as v
    from siftmark.runtime import Scratch

    rng = np.random.default_rng(12)
    x = rng.normal(size=(30, 64)).repeat(6, 0) + 0.12 * rng.normal(size=(180, 64))
    rows = [(i, y.tolist()) for i, y in enumerate(np.r_[x, rng.normal(size=(120, 64))])]
    monkeypatch.setattr(v, "BLOCK", 16)
    got = []
    for way in ("region", "meeting"):
        scratch = Scratch(spark, "way")
        unique, _, n = v.one_each(vectors(spark, rows), "doc_idx", "embedding", scratch)
        cells = v.Cells(v.fit_cells(v.sample(unique, n), v.cells_for(n)), n, v.border_for(0.9))
        args = (similar._search(10, 0.9, similar.fit_books(*[v.unit(x).astype(np.float32)] * 2), cells.centres), "doc long, neighbour long, cos double", cells, scratch)
        if way == "region":
            found = v.per_region(unique, *args)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "MapInArrow" in plan and "Exchange" not in plan and "array<float>" not in plan
        else:
            found = v.per_meeting(v.meetings(unique, cells, scratch), *args)
        got.append({(min(r.doc, r.neighbour), max(r.doc, r.neighbour)) for r in found.collect()})
    assert got[0] == got[1] == brute.p5(rows)
    assert {(r.cluster_idx, r.doc_idx) for r in clusters.clusters(vectors(spark, rows), "doc_idx", "embedding").collect()} == set(brute.p1(rows))


def test_scores_take_no_look_ups_for_each_query(monkeypatch):
    """A scan is one matrix product."""
    rng = np.random.default_rng(3)
    q, codes = rng.standard_normal((5, 64)).astype(np.float32), rng.integers(0, 16, (40, similar.PARTS)).astype(np.uint8)
    books = rng.standard_normal((similar.PARTS, 16, 2)).astype(np.float32)
    monkeypatch.setattr(similar.np, "take", None)
    assert similar.scan(q, codes, np.ones(40, np.float32), books, np.zeros((1, 5), np.float32)).shape == (40, 5)
