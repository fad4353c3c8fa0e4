"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyarrow import fs
from pyarrow.dataset import dataset
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components  # noqa: F401  for the operators here
from ..session import shared_dir, stored  # noqa: F401

#: A word of the corpus contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_batches(path: str, columns: list[str], where=None, rows: int = 20_000):
    """In a task: the rows of a table that was stored in the shared folder, batch by batch."""
    uri = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
    found, at = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    yield from dataset(at, filesystem=found, format="parquet").to_batches(columns=columns, filter=where, batch_size=rows)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, longer where a column has one already."""
    out = []
    for n in names:
        while n in columns:
            n += "_"
        out.append(n)
    return out


def word_count(text: Column) -> Column:
    """Number of words (WORD) of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null for a null id."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % F.lit(mod)).cast("int")


def one_per_bucket(ids: DataFrame, groups: list[str], id_col: str, buckets: int) -> DataFrame:
    """At most `buckets` ids of each group: the one of smallest hash in each hash bucket.

    A deterministic sample of documented size, taken with a map-side combined minimum,
    so a group that holds most rows needs no more memory than any other.
    Returns groups + (id_col, bucket).
    """
    h = F.xxhash64(F.col(id_col), F.lit(17))
    return (
        ids.where(F.col(id_col).isNotNull())
        .select(*groups, id_col, F.pmod(h, F.lit(buckets)).alias("bucket"), F.pmod(F.shiftright(h, 16), F.lit(1 << 40)).alias("_h"))
        .groupBy(*groups, "bucket")
        .agg(F.min(F.struct("_h", id_col)).alias("_m"))
        .select(*groups, F.col(f"_m.{id_col}").alias(id_col), "bucket")
    )


def skew_safe_join(big: DataFrame, small: DataFrame, key: str, counts: DataFrame, how: str = "left", share: int = 256) -> DataFrame:
    """Join big to small (one row for a key) although some keys hold much of big.

    counts(key, n) tells how often a key occurs in big. Keys that hold over 1/share of all
    rows number under `share`; those are joined by broadcast of at most that many rows,
    all others by shuffle.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in counts.where(F.col("n") > max(total / share, 1000)).select(key).limit(share + 1).collect()]
    if not hot:
        return big.join(small, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return big.where(~is_hot).join(small.where(~is_hot), key, how).unionByName(big.where(is_hot).join(F.broadcast(small.where(is_hot)), key, how))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the pairs (a, b) from each of n local indices."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1e-2, rounds: int = 50, even: float = 0.0) -> np.ndarray:
    """Weights (bias last) of a logistic model, drawn towards prior; Newton steps.

    `even` is how far the labels' weights in sum come together: 0 as many as there are of each, 1 the same for both.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    w = prior.astype(float).copy()
    if not len(y):
        return w
    share = y.mean()
    each = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share)) ** even if 0 < share < 1 else np.ones(len(y))
    ridge = np.full(len(w), strength * max(1.0, len(y) / 100))
    ridge[-1] *= 1e-2
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (each * (p - y)) + ridge * (w - prior)
        hess = (x * (each * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5 / max(1e-12, np.abs(step).max()))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
