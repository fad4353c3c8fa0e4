import hashlib
import math

import numpy as np
import pytest

from emberlog.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<float>, label int, codes string"


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Plain Python: every distance, integer sums, floor division."""
    kept = sorted((r for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dim]
    ints = [[math.floor(float(np.float32(c)) * scale) for c in r[1]] for r in kept]
    width = dim // parts
    cut = [[v[p * width : (p + 1) * width] for v in ints] for p in range(parts)]
    books = [[list(v) for v in c[:entries]] for c in cut]

    def near(v, book):
        return min((sum((x - y) ** 2 for x, y in zip(v, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for v in cut[p]:
                of.setdefault(near(v, books[p])[1], []).append(v)
            for i, vs in of.items():
                books[p][i] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [[near(c[n], b) for c, b in zip(cut, books)] for n in range(len(kept))]
    errors = [sum(d for d, _ in f) for f in found]
    by = {}
    for r, e in zip(kept, errors):
        by[r[2]] = by.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{i:02x}" for _, i in f), e, by[r[2]], digest) for r, f, e in zip(kept, found, errors)), key=str)


def rows_of(n, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[5] = x[3]
    rows = [(i * 2, [float(c) for c in v], [None, 1, 2][i % 3], "clash") for i, v in enumerate(x)]
    rows += [rows[4], (1, None, 1, ""), (3, [math.nan] + [0.0] * (dim - 1), 1, ""), (5, [None] * dim, 1, ""), (7, [], 1, ""), (9, [math.inf] * dim, None, ""), (None, rows[2][1], 2, "")]
    return rows


@pytest.mark.parametrize(("n", "entries"), [(60, 12), (9, 256)])
def test_codes_equal_brute_force(spark, n, entries):
    rows = rows_of(n)
    got = vectorcodes.compress(spark.createDataFrame(rows, SCHEMA).repartition(5), entries=entries).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got), key=str) == brute(rows, entries=entries)


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None, 1, ""), (2, [math.nan], 1, "")], SCHEMA)
    assert vectorcodes.compress(df).collect() == []
    assert vectorcodes.compress(df.limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256", "label"]


def test_other_lengths_large_numbers_and_uneven_parts(spark):
    rows = [(0, [1.0] * 6, 1, ""), (1, [1e30] * 6, 1, ""), (2, [1.0, 2.0], 1, ""), (3, [-1e30] * 6, None, "")]
    got = {r.vec_id: r for r in vectorcodes.compress(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {0, 1, 3} and all(r.error == 0 for r in got.values())
    assert [got[i].code for i in (0, 1, 3)] == ["00000000", "01010100", "02020200"]  # the fourth part is empty


def test_decoded_vectors_are_near(spark):
    rng = np.random.default_rng(0)
    x = (rng.integers(0, 3, size=(300, 1)) + 0.01 * rng.normal(size=(300, 8))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0, "") for i, v in enumerate(x)], SCHEMA)
    books = vectorcodes.fit(df, entries=16)
    back = vectorcodes.decode(vectorcodes.encode(df, books), books).collect()
    assert max(np.abs(np.array(r.embedding) - x[r.vec_id]).max() for r in back) < 0.1
    assert all(r.error == sum((math.floor(float(a) * 1024) - round(b * 1024)) ** 2 for a, b in zip(x[r.vec_id], r.embedding)) for r in back)


def test_wide_sums_use_64_bits():
    book = np.array([[2**28, -(2**28)], [0, 0]])
    code, error = vectorcodes.nearest(np.array([[0, 2**28], [1, -(2**28)]]), book)
    assert code.tolist() == [1, 0] and error.tolist() == [1, 0]
