import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from emberlog.llm import nearcopies


def _jaccard(a, b):
    x, y = ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_stage_drops_near_copies(spark, monkeypatch):
    """All pairs from 0.8 on link, far above the bits that the trie affords; others stay."""
    monkeypatch.setattr(nearcopies, "COLUMNS", 64)
    r = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    texts = {}
    for i in range(12):
        base = r.choices(words, k=r.choice([40, 150, 400]))
        texts[i] = " ".join(base)
        for n, share in ((100, 0.01), (200, 0.03), (300, 0.06)):
            texts[i + n] = " ".join(r.choice(words) if r.random() < share else w for w in base)
    near = [(a, b) for a in texts for b in texts if a < b and _jaccard(texts[a], texts[b]) >= 0.8]
    group = {d: d for d in texts}

    def find(d):
        while group[d] != d:
            d = group[d]
        return d

    for a, b in near:
        x, y = sorted((find(a), find(b)))
        group[y] = x
    rows = [(i, t) for i, t in texts.items()] + [(900, texts[7]), (None, "no id"), (None, "no id"), (901, ""), (902, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(x.doc_id if x.doc_id is not None else -1 for x in corpus_pipeline.near_copies(spark, docs, "").collect())
    assert got == sorted([-1, 901] + [d for d in texts if find(d) == d])


def test_overlaps_and_chains():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 300, r.integers(1, 200)).astype(np.uint64)) for _ in range(30)]
    assert [[int(x) for x in row] for row in nearcopies.overlaps(sets)] == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    # 4 of 5 hashes shared is 0.8 exactly
    near = [np.arange(4, dtype=np.uint64), np.arange(5, dtype=np.uint64), np.arange(6, dtype=np.uint64), np.array([9], np.uint64)]
    table = pa.table({"hashes": [x.tobytes() for x in near], "node": [30, 20, 10, 40]})
    assert nearcopies._links(0.8)(None, table).to_pylist() == [{"a": 10, "b": 20}, {"a": 20, "b": 30}]
