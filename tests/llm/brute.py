"""Plain versions of the problems' definitions, for small inputs."""

from collections import Counter, defaultdict

import numpy as np
import regex

WORD = regex.compile(r"[\p{L}\p{N}]+")
MARK = regex.compile(r"^\s*(query|document)\s*:", regex.I)


def words(t):
    return [w.lower() for w in WORD.findall(t or "")]


def mark_body(t):
    m = MARK.match(t or "")
    return (m[1].lower(), t[m.end() :]) if m else ("", t or "")


def p2_inputs(rows):
    classes = defaultdict(set)
    for i, t in rows:
        mark, body = mark_body(t)
        fields = [tuple(words(f)) for f in regex.split(r"[|;\n\r]", body)]
        fields = tuple(sorted(f for f in fields if f))
        if fields:
            classes[mark, fields].add(i)
    return {(min(c), i) for c in classes.values() for i in c if i != min(c)}


def p2_lists(rows):
    classes = defaultdict(set)
    for i, qs in rows:
        key = tuple(sorted(tuple(words(q)) for q in qs or [] if words(q)))
        if key:
            classes[key].add(i)
    return {(min(c), i) for c in classes.values() for i in c if i != min(c)}


def jaccard_pairs(left, right, share):
    """Pairs of ids whose word sets share at least ``share``; right None: within left, smaller first."""
    a = [(i, set(words(t))) for i, t in left]
    b = a if right is None else [(i, set(words(t))) for i, t in right]
    lists = defaultdict(list)
    for k, (_, s) in enumerate(b):
        for w in s:
            lists[w].append(k)
    out = set()
    for i, s in a:
        for k, n in Counter(k for w in s for k in lists[w]).items():
            j, r = b[k]
            if n >= share * (len(s) + len(r) - n) - 1e-9 and (right is not None or i < j):
                out.add((i, j))
    return out


def p7(docs, items, window=12):
    grams = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams[n, tuple(w[k : k + n])].add(i)
    sizes = {n for n, _ in grams}
    return {(d, i) for d, t in docs for w in [words(t)] for n in sizes for k in range(len(w) - n + 1) for i in grams.get((n, tuple(w[k : k + n])), ())}


def usable(rows):
    """ids and double-precision unit vectors of the usable rows, one per id."""
    found = {}
    for i, e in rows:
        if e is not None and len(e) == 64 and all(x is not None for x in e):
            v = np.array(e, np.float64)
            if np.isfinite(v).all() and v.any():
                found[i] = v / np.linalg.norm(v)
    ids = np.array(sorted(found))
    return ids, np.array([found[i] for i in ids]).reshape(len(ids), 64)


def p1(rows, least=0.9, size=5):
    ids, m = usable(rows)
    sims, left, out = m @ m.T, set(range(len(ids))), set()
    while left:
        seen, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            seen.add(x)
            near = {int(y) for y in np.flatnonzero(sims[x] >= least)} & left
            left -= near
            todo += near
        if len(seen) >= size:
            first = min(ids[x] for x in seen)
            out |= {(int(first), int(ids[x])) for x in seen}
    return out


def p5(rows, k=10, least=0.9):
    ids, m = usable(rows)
    out = set()
    for a in range(len(ids)):
        s = np.round(m @ m[a], 12)
        s[a] = -2
        for b in np.lexsort((ids, -s))[:k]:
            if s[b] >= least:
                out.add((int(min(ids[a], ids[b])), int(max(ids[a], ids[b]))))
    return out
