import random

import numpy as np
import xxhash

from emberlog.llm import simhash

DOC = "doc_id long, text string, source string, fp string"


def brute(rows):
    fps = []
    for _, t in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).translate({i: " " for i in (32, 9, 10, 11, 12, 13)}).split(" ")
        words = [w for w in words if w]
        sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 90])))) for i in range(120)]
    rows += [(200 + i, rows[i % 7 + 2][1] + (" tail" if i % 2 else "")) for i in range(40)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "ÄÖ ẞ İ  x"), (None, "w1"), (None, rows[0][1]), (5, rows[5][1]), (304, "x" * 100_000), (305, "la " * 70_000)]
    df = spark.createDataFrame([(d, t, "s", "clash") for d, t in rows], DOC)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(df).collect()), key=str)
    assert got == brute(rows)
    kept = simhash.keep_representatives(df).collect()
    comps = {c for _, _, c in got if c is not None}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(comps)
    assert kept[0].asDict().keys() == {"doc_id", "text", "source", "fp"}


def test_trie_pairs_equal_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64))
    fps = np.unique(np.r_[base, near, near ^ np.uint64(3)])
    want = {(i, j) for j in range(len(fps)) for i in range(j) if int(fps[i] ^ fps[j]).bit_count() <= 2}
    got = set()
    for i, j in simhash.trie_pairs(fps, 2, block=50):
        got |= set(zip(i.tolist(), j.tolist(), strict=True))
    assert got == want


def test_buckets_equal_one_bucket(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    fps = np.unique(np.r_[base, base ^ (np.uint64(1) << np.uint64(63)), base ^ (np.uint64(3) << np.uint64(61))]).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    from emberlog.llm.common import connected_components

    one = {tuple(r) for r in connected_components(simhash.near_links(df)).collect()}
    many = {tuple(r) for r in connected_components(simhash.near_links(df, bucket=40)).collect()}
    assert one == many and one


def test_crowded_nodes_are_cut_deeper(spark):
    rng = np.random.default_rng(3)
    crowd = (np.uint64(0x5A5) << np.uint64(52)) | rng.integers(0, 2**52, 1500, dtype=np.uint64)
    near = crowd[:400] ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64))
    fps = np.unique(np.r_[crowd, near, near[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)), rng.integers(0, 2**63, 300, dtype=np.uint64)])
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    nodes = simhash.cut(df, 100)
    held = [sum(int(f) >> (64 - d) == p for f in fps) for d, p in nodes]
    assert sum(held) == len(fps) and max(held) <= 100 and max(d for d, _ in nodes) > 13
    from emberlog.llm.common import connected_components

    one = {tuple(r) for r in connected_components(simhash.near_links(df)).collect()}
    many = {tuple(r) for r in connected_components(simhash.near_links(df, bucket=100)).collect()}
    assert one == many and one


def test_empty_table(spark):
    assert simhash.simhash_components(spark.createDataFrame([], DOC)).count() == 0
    assert simhash.keep_representatives(spark.createDataFrame([], DOC)).count() == 0
