import numpy as np
import pytest

from emberlog.operators import semantic


@pytest.mark.parametrize("threshold", [0.12, 0.92, 1.0])
def test_edges_equal_all_pairs(spark, threshold):
    """Cells lose no pair: groups of near vectors, copies, a zero vector and odd ones."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 5))
    x = np.concatenate([centres[rng.integers(0, 6, 60)] + 0.25 * rng.normal(size=(60, 5)), centres, centres, np.zeros((1, 5))])
    rows = [(f"k{i:03}", v.tolist()) for i, v in enumerate(x)]
    odd = [("n1", [1.0, None, 0.0, 0.0, 0.0]), ("n2", [float("nan")] * 5), ("n3", None), ("short", x[0][:3].tolist())]
    got = {(r.a, r.b): r.similarity for r in semantic.merge_edges(spark.createDataFrame(rows + odd, "fingerprint string, embedding array<double>"), threshold).collect()}
    unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    cos = unit @ unit.T
    sure = {(f"k{i:03}", f"k{j:03}") for i in range(len(x)) for j in range(i + 1, len(x)) if cos[i, j] >= threshold + 1e-9}
    maybe = {(f"k{i:03}", f"k{j:03}") for i in range(len(x)) for j in range(i + 1, len(x)) if cos[i, j] >= threshold - 1e-9}
    assert sure <= set(got) <= maybe and all(abs(got[p] - cos[int(p[0][1:]), int(p[1][1:])]) < 1e-9 for p in got)


def test_edges_of_nothing(spark):
    assert semantic.merge_edges(spark.createDataFrame([], "fingerprint string, embedding array<float>")).count() == 0
