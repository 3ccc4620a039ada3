"""From JSON line files to samples and back."""

import json

import numpy as np

from siftmark.functions.text import rqid_codes
from siftmark.plans import pipeline


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows), encoding="utf-8")
    return str(path)


def test_files_to_samples(spark, tmp_path):
    def qa(i):
        return {"query": f" what is {i} ", "passages": {"passage_text": [f"text {i} é", "other", ""], "is_selected": [1, 0, 1], "url": [f"u{i}", None]}}

    paths = {
        "train": lines(tmp_path / "a.jsonl", [qa(i) for i in range(30)]),
        "valid": lines(tmp_path / "b.jsonl", [{"operation": "indexing", "doc_id": "x", "text": "operation text"}, {"operation": "query", "doc_id": "x", "text": "asked"}, {"operation": "query", "doc_id": "gone", "text": "lost"}]),
        "test": lines(tmp_path / "c.jsonl", [qa(i) for i in range(25, 35)]),
    }
    out = pipeline.run(spark, paths, f"file://{tmp_path}/out", pipeline.Settings(levels=2, codes=4, rounds=5, queries=2))
    docs = {r.doc_id: r for r in out["docs"].collect()}
    assert len(docs) == 36 and sorted(r.doc_idx for r in docs.values()) == list(range(36)) and docs["x"].doc_idx == 30
    ids = {r.doc_id: r.rqid for r in out["semid_to_rqid"].collect()}
    assert set(ids) == set(docs)
    train = [tuple(r) for r in out["train"].collect()]
    # queries of train and valid, documents, pseudo-queries
    assert len(train) == 31 + 36 + 2 * 36 and ("query: asked", ids["x"]) in train and ("document: operation text", ids["x"]) in train
    test = out["test"].collect()
    assert len(test) == 10 and all(r.output == r.gt_rqid == ids[r.gt_semid] for r in test)
    # codes are those of the nearest centres, level by level
    books = {(r.level, r.code): np.array(r.centroid) for r in out["codebooks"].collect()}
    v = {r.doc_idx: np.array(r.embedding, float) for r in out["embeddings"].collect()}
    for r in out["semid_to_rqid"].select("doc_id", rqid_codes(out["semid_to_rqid"].rqid).alias("c")).collect():
        rest = v[docs[r.doc_id].doc_idx]
        for level, c in enumerate(r.c):
            far = {k: ((rest - b) ** 2).sum() for (n, k), b in books.items() if n == level}
            assert far[c] <= min(far.values()) + 1e-9
            rest = rest - books[level, c]


def test_files_without_rows(spark, tmp_path):
    out = pipeline.run(spark, {"train": lines(tmp_path / "a.jsonl", [{"other": 1}])}, f"file://{tmp_path}/out", pipeline.Settings(levels=1, codes=2, rounds=1))
    assert all(not t.collect() for t in out.values())
