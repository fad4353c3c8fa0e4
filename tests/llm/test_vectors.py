import math

import numpy as np
import pyarrow as pa

from emberlog.llm import graphindex, vectordedup

SCHEMA = "vec_id long, embedding array<float>, label int, rep string"


def table(spark, n=400, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[50:90] = x[0] + 0.05 * rng.normal(size=(40, dim))  # a group of near copies
    x[100:130] = x[7]  # exact copies
    x[140] = 3 * x[9]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[141] *= 2.5
    x = x.astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], int(i % 3 > 0) if i > 139 else 1, "clash") for i in range(n)]
    rows += [(n, None, 1, ""), (n + 1, [0.0] * dim, 1, ""), (n + 2, [math.nan] + [1.0] * (dim - 1), 1, ""), (n + 3, [None] + [1.0] * (dim - 1), 1, ""), (n + 4, rows[0][1], None, ""), (n + 5, [math.inf] * dim, 1, ""), (None, rows[0][1], 1, ""), (n + 6, [1.0, 2.0], 1, ""), (n + 7, [2.0, 4.0], 1, "")]
    return spark.createDataFrame(rows, SCHEMA), rows


def good(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)


def test_near_duplicates_equal_brute_force(spark):
    df, rows = table(spark)
    links, n = {}, len(rows)
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if good(v) and k is not None and i is not None else None for i, v, k, _ in rows]
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93 - 1e-12:
                links[i] = links.get(i, 0) + 1
                links[j] = links.get(j, 0) + 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = sorted(((r[0], links.get(i, 0), rows[find(i)][0] if unit[i] is not None else r[0]) for i, r in enumerate(rows)), key=str)
    for pivots, block in ((None, 2048), (None, 16), (1, 64)):
        got = vectordedup.near_duplicates(df, pivots=pivots, block=block).collect()
        assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want
        assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def test_near_duplicates_large_lists(spark):
    rng = np.random.default_rng(3)
    x = (np.ones(16) + 0.1 * rng.normal(size=(150, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = ((u @ u.T) >= 0.93).sum(axis=1) - 1
    for block in (40, 4096):
        got = {r.vec_id: r.n_links for r in vectordedup.near_duplicates(df, block=block).collect()}
        assert [got[i] for i in range(150)] == want.tolist()


def test_recall_of_planted_links(spark):
    """Pairs at cosines of 0.93 to 0.95 in 64 dimensions, with some 1000 pivots."""
    rng = np.random.default_rng(6)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.normal(size=(50_000, 64)))
    c = rng.uniform(0.9301, 0.95, (1500, 1))
    away = rng.normal(size=(1500, 64))
    away = unit(away - (away * x[:1500]).sum(axis=1, keepdims=True) * x[:1500])
    x = np.concatenate([x, c * x[:1500] + np.sqrt(1 - c * c) * away]).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": x.tolist(), "label": np.zeros(len(x), np.int32)}))
    got = {r.vec_id: r.n_links for r in vectordedup.near_duplicates(df).where("n_links > 0").collect()}
    assert set(got.values()) == {1} and all(i < 1500 or i >= 50_000 for i in got)
    assert np.mean([i in got for i in range(1500)]) >= 0.97


def test_lists_meet_where_both_permutations_have_them():
    rng = np.random.default_rng(7)
    for pivots in (1, 2, 5, 40, 3000):
        shape = vectordedup.Shape(pivots)
        a, b = (np.array([rng.permutation(pivots)[: shape.length] for _ in range(300)]) for _ in range(2))
        count, least = shape.meets(a, b)
        la, lb = shape.lists(a), shape.lists(b)
        for k in range(300):
            assert count[k] == len(set(a[k]) & set(b[k]))
            assert least[k] == min(set(la[k]) & set(lb[k]), default=-1)


def test_empty_vectors(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert vectordedup.near_duplicates(df).count() == 0
    assert graphindex.nearest(df).count() == 0


def brute(rows, every, k):
    out = {}
    use = {(i, tuple(v)) for i, v, _, _ in rows if good(v) and i is not None}
    for q, v in sorted(use):
        if q % every == 0 and q not in out:
            a = np.array(v, float)
            out[q] = sorted((-float(np.dot(np.array(w, float), a)), i) for i, w in use if i != q and len(w) == len(v))[:k]
    return out


def test_nearest_equals_brute_force_on_small_tables(spark):
    df, rows = table(spark, n=300)
    for tasks, shard in ((8, 100), (1, 1000)):
        check_nearest(graphindex.nearest(df, every=20, k=20, beam=320, tasks=tasks, shard=shard).collect(), rows)


def check_nearest(got, rows):
    want = brute(rows, 20, 20)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {q for q, w in want.items() if w}
    for q, w in want.items():
        mine = sorted(by.get(q, []), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(w) + 1))
        assert [r.vec_id for r in mine] == [i for _, i in w]
        np.testing.assert_allclose([r.score for r in mine], [-s for s, _ in w], rtol=1e-12)


def test_nearest_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in graphindex.nearest(df, every=60).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    s = x[::60].astype(float) @ x.T.astype(float)
    s[np.arange(50), np.arange(50) * 60] = -np.inf
    want = np.argsort(-s, axis=1)[:, :20]
    assert np.mean([len(got[i * 60] & set(w.tolist())) / 20 for i, w in enumerate(want)]) >= 0.9
