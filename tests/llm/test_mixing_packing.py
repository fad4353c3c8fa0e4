import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import mixing, packing

DOC = "doc_id long, text string, lang string, source string, n_chars long, size string"


def docs(spark, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        s = rng.choice(["a", "a", "a", "a", "b", "Z", "é", "c", "d", None])
        rows.append((i, " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.choice([0, 1, 5, 50, 400]))), "en", s, 3, "clash"))
    rows += [(900, None, None, "a", None, ""), (901, "x " * 30_000, None, "b", None, ""), (None, "one two", None, "a", None, ""), (7, rows[7][1], "en", rows[7][3], 3, ""), (7, rows[7][1], "en", rows[7][3], 3, "")]
    return spark.createDataFrame(rows, DOC), rows


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def want_targets(sizes, share=Fraction(3, 2), cap=2):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = Fraction(left) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = Fraction(cap * sizes[s])
            left -= cap * sizes[s]
        free -= over
    return out


@pytest.mark.parametrize("shard", [2_000_000, 3_000])
def test_mix(spark, shard):
    df, rows = docs(spark)
    got = mixing.mix(df, shard=shard).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    targets, taken = want_targets(sizes), {}
    for r in got:
        assert abs(r.target - float(targets[r.source])) < 1e-6 and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((r[0] is None, r[0] or 0, len(words(r[1]))) for r in rows)
    for s, t in targets.items():
        assert abs(taken[s] - float(t)) <= mixing.BLOCK * (2 + sizes[s] // shard)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3), shard=shard).collect()))


def test_tiny_sources_come_near_their_targets(spark):
    rows = [(i, "w " * n, None, s, None, "") for i, (s, n) in enumerate((("a", 3), ("b", 2), ("c", 1), ("d", 4000)))]
    for part in (rows, rows[:1], rows[:3]):
        got = mixing.mix(spark.createDataFrame(part, DOC)).collect()
        for r in got:
            assert abs(r.taken - r.target) <= 1 and r.taken <= 2 * r.size, r


def test_selection_equals_a_walk_over_all_words(spark):
    """The words of a source stand in a ring; the mix takes whole rounds and a run from a seeded start."""
    df, rows = docs(spark, 5)
    plan = mixing.mix(df).collect()
    h = F.xxhash64
    keyed = df.select("doc_id", "source", F.length("text").alias("n"), F.xxhash64("text").alias("t"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("z")).fillna(0, ["z"])
    keyed = keyed.select("*", h(F.lit(11), "doc_id", "z", "t").alias("k"), h(F.lit(13), "source", F.lit(0)).alias("s")).collect()
    for source in {r.source for r in keyed}:
        ring, n = [], 0
        mine = sorted((r for r in keyed if r.source == source), key=lambda r: (r.k, r.doc_id is None, r.doc_id or 0, r.z, r.t is None, r.t or 0))
        for r in mine:
            ring += [(r.doc_id, r.z)] * r.z
        n, want = len(ring), {}
        take = sum(r.taken for r in plan if r.source == source)
        start = (mine[0].s % max(1, -(-n // 32))) * 32
        for i in range(take % n if n else 0):
            want[ring[(start + i) % n]] = want.get(ring[(start + i) % n], 0) + 1
        for w in ring:
            want[w] = want.get(w, 0) + take // n
        got = {}
        for r in plan:
            if r.source == source and r.taken:
                got[r.doc_id, r.size] = got.get((r.doc_id, r.size), 0) + r.taken
        assert got == {k: v for k, v in want.items() if v}


def test_columns_of_any_name_go_along(spark):
    df, _ = docs(spark, 4)
    plain = mixing.apply_mix(df)
    names = ("_row", "_plan", "_plans", "_k", "_text", "_text_", "taken", "shard", "_s", "a.b")
    for i, name in enumerate(names):
        df = df.withColumn(name, F.lit(i))
    got = mixing.apply_mix(df)
    assert got.columns == df.columns
    assert [tuple(r)[-len(names) :] for r in got.distinct().limit(3).collect()] == [tuple(range(len(names)))] * 3
    assert sorted(map(str, got.drop(*names).collect())) == sorted(map(str, plain.collect()))


def test_apply_mix_takes_those_words(spark):
    df, rows = docs(spark, 3)
    plan, out = mixing.mix(df).collect(), mixing.apply_mix(df)
    assert out.columns == df.columns
    got, want = {}, {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words(r.text))
        assert r.n_chars == len(r.text)
    for r in plan:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert got == {k: v for k, v in want.items() if v}


def test_sainte_lague(spark):
    rng = random.Random(1)
    for parties, seats in ((1, 5), (7, 40), (100, 40), (60, 1000), (5, 0)):
        votes = [rng.choice([1, 1, 3, 10, 500]) for _ in range(parties - 1)] + [5000]
        df = spark.createDataFrame([("g", f"p{i:03}", float(v), seats) for i, v in enumerate(votes)] + [("h", "p0", 0.0, 3)], "g string, p string, v double, s long")
        got = {r.p: r.quota for r in mixing.apportion(df, ["g", "p"], "v", "s", ["g"]).where("g = 'g'").collect()}
        want = {f"p{i:03}": 0 for i in range(parties)}
        for _ in range(seats):
            best = min(want, key=lambda p: (-votes[int(p[1:])] / (2 * want[p] + 1), p))
            want[best] += 1
        assert got == want


def test_mix_empty(spark):
    df, _ = docs(spark)
    assert mixing.mix(df.limit(0)).count() == mixing.apply_mix(df.limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(df.where("doc_id = 900")).collect()] == [0]


def test_pack_documents(spark):
    df, rows = docs(spark)
    for shard in (8_000_000, 5_000):
        got = packing.pack_documents(df, capacities=(64, 256, 1024), shard=shard).collect()
        by_doc, by_bin = {}, {}
        for r in got:
            by_doc.setdefault(r.doc_id, []).append((r.part, r.start, r.length))
            if r.bin_id is not None:
                by_bin.setdefault((r.bin_id, r.bin_length), []).append((r.bin_offset, r.length))
            else:
                assert r.length == 0
        sizes = {}
        for r in rows:
            sizes[r[0]] = sizes.get(r[0], 0) + len(words(r[1]))
        assert {d: sum(n for *_, n in p) for d, p in by_doc.items()} == sizes
        assert len({b for b, _ in by_bin}) == len(by_bin)
        for (_, cap), items in by_bin.items():
            end = 0
            for off, n in sorted(items):
                assert off == end
                end += n
            assert end <= cap and cap == min(c for c in (64, 256, 1024) if c >= end)
        if shard > 10_000:
            # several lengths waste no more than the longest alone
            single = sum(r.bin_length for r in packing.pack_documents(df, capacities=(1024,)).where("bin_offset = 0").collect())
            assert sum(sizes.values()) <= sum(c for _, c in by_bin) <= single
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_best_fit_picks_the_tightest_bin():
    sizes = np.array([700, 600, 400, 320, 300])
    b, off, length = packing.pack(sizes, (512, 1024))
    assert b.tolist() == [0, 1, 1, 0, 2] and off.tolist() == [0, 0, 600, 700, 0] and length.tolist() == [1024, 1024, 512]


def test_best_fit_equals_a_scan_of_all_bins():
    rng = np.random.default_rng(2)
    for caps, overhead in (((64, 256, 1024), 16.0), ((100,), 0.0), ((10, 20, 40, 80), 3.0)):
        sizes = np.sort(rng.integers(1, caps[-1] + 1, 400))[::-1]
        room, used = [], []
        for i, s in enumerate(sizes.tolist()):
            open_ = [j for j in range(len(room)) if room[j] >= s]
            if open_:
                j = min(open_, key=lambda j: room[j])
            else:
                rest = int(sizes[i + 1 :].sum())
                best = min((c for c in caps if c >= s), key=lambda c: ((c + overhead) / min(c, s + rest), c))
                j = len(room)
                room.append(best)
                used.append(0)
            room[j] -= s
            used[j] += s
        b, off, length = packing.pack(sizes, caps, overhead)
        assert sorted(np.bincount(b, sizes).astype(int).tolist()) == sorted(used)
        assert sorted(length.tolist()) == sorted(min(c for c in caps if c >= u) for u in used)
        for k in range(len(length)):
            mine = np.flatnonzero(b == k)
            assert off[mine].tolist() == np.r_[0, np.cumsum(sizes[mine])[:-1]].tolist()


def test_repeated_rows_spread_over_all_shards(spark):
    df = spark.createDataFrame([(None, "w " * 40, None, None, None, "")] * 300, DOC)
    got = packing.pack_documents(df, capacities=(128,), shard=1000).collect()
    assert len(got) == 300 and sum(r.length for r in got) == 12_000
    assert len({r.bin_id.split("-")[0] for r in got}) > 6
