"""Merging clusters whose templates mean the same, by cosine of their vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_trigger
from .cluster import change_ratio, importance, rank, severity
from .graph import min_label_components


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; a vector of norm zero counts as of norm one."""
    norm = lambda v: F.sqrt(dot(v, v))
    n = lambda v: F.when(norm(v) == 0, F.lit(1.0)).otherwise(norm(v))
    return dot(a, b) / (n(a) * n(b))


def with_unit(vectors: DataFrame, column: str, name: str = "_unit") -> DataFrame:
    """Add the vector over its norm, computed once a row and not once a pair."""
    norm = F.sqrt(dot(F.col(column), F.col(column)))
    t = vectors.withColumn("_norm", F.when(norm == 0, F.lit(1.0)).otherwise(norm))
    return t.withColumn(name, F.transform(column, lambda x: x.cast("double") / F.col("_norm"))).drop("_norm")


#: A block of vectors: no fewer than this many where there are more, and no more bytes than these.
BLOCK, BLOCK_BYTES = 4096, 64 << 20


def _block_edges(threshold: float):
    """For rows in the order of (dim, i, j, side): pairs of a row of side 0 and one of side 1 of the same tile.

    A task holds one block and meets the other batch by batch. Products in single precision find
    candidates, with more room than their rounding needs; products in double precision decide.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, left = None, [], None

        def units(keys: pa.Array, v: np.ndarray) -> tuple[pa.Array, np.ndarray]:
            with np.errstate(all="ignore"):
                norm = np.sqrt(np.einsum("ij,ij->i", v, v))
                x = v / np.where(norm == 0, 1.0, norm)[:, None]
            good = ~np.isnan(x).any(axis=1)
            return keys.filter(pa.array(good)), x[good]

        def pairs(keys: pa.Array, x: np.ndarray):
            low = np.float32(threshold - 1e-5 - 2e-7 * x.shape[1])
            x32 = x.astype(np.float32)
            for at in range(0, len(left[1]), 1024):
                i, j = np.nonzero(left[2][at : at + 1024] @ x32.T >= low)
                for of in range(0, len(i), 100_000):
                    a, b = i[of : of + 100_000] + at, j[of : of + 100_000]
                    s = np.einsum("ij,ij->i", left[1][a], x[b])
                    ok = s >= threshold
                    if ok.any():
                        yield pa.RecordBatch.from_arrays([left[0].take(pa.array(a[ok])), keys.take(pa.array(b[ok])), pa.array(s[ok]), pa.array(np.full(int(ok.sum()), tile[1] == tile[2]))], names=["x", "y", "similarity", "inner"])

        for batch in batches:
            heads = np.stack([batch.column(c).to_numpy() for c in ("dim", "i", "j", "side")])
            cuts = [0, *(np.flatnonzero((heads[:, 1:] != heads[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                dim, i, j, side = heads[:, start].tolist()
                if (dim, i, j) != tile:
                    tile, held, left = (dim, i, j), [], None
                part = batch.slice(start, end - start)
                keys, x = units(part.column("k"), part.column("v").flatten().to_numpy().reshape(end - start, dim))
                if side == 0:
                    held.append((keys, x))
                    continue
                if left is None and held:
                    x64 = np.concatenate([v for _, v in held])
                    left, held = (pa.concat_arrays([k for k, _ in held]), x64, x64.astype(np.float32)), []
                if left is not None:
                    yield from pairs(keys, x)

    return run


def merge_edges(vectors: DataFrame, threshold: float = 0.92, key: str = "fingerprint") -> DataFrame:
    """Pairs (a, b, similarity) of a < b whose vectors have cosine >= threshold; all of them.

    Vectors are dealt to blocks by their keys, and each two blocks meet in one tile, as a product of
    matrices. So the work grows with the square of the table, evenly over the tasks; what is
    shuffled is the table once for each block. Vectors with null or NaN components link with
    nothing, nor do those of different dimensions.
    """
    u = vectors.select(F.col(key).alias("k"), F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("dim")).where(F.col("k").isNotNull() & ~F.exists("v", lambda x: F.isnull(x) | F.isnan(x)))
    of = u.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    blocks = max(1, -(-of.n // max(1, min(max(BLOCK, of.n // 24), BLOCK_BYTES // (8 * max(1, of.dim or 1))))))
    b, o = F.col("b"), F.col("o")
    dealt = u.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumn("side", F.explode(F.when(b == o, F.array(F.lit(0), F.lit(1))).when(b < o, F.array(F.lit(0))).otherwise(F.array(F.lit(1)))))
    tiles = dealt.select("dim", F.least(b, o).alias("i"), F.greatest(b, o).alias("j"), "side", "k", "v").repartition(min(blocks * (blocks + 1) // 2, 1000), "dim", "i", "j").sortWithinPartitions("dim", "i", "j", "side")
    kind = u.schema["k"].dataType.simpleString()
    met = tiles.mapInArrow(_block_edges(threshold), f"x {kind}, y {kind}, similarity double, inner boolean").where("not inner or x < y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def _sum_maps(members: DataFrame, column: str) -> DataFrame:
    one = members.select("component", F.explode(column).alias("k", "n")).groupBy("component", "k").agg(F.sum("n").alias("n"))
    return one.groupBy("component").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias(column))


def merge_clusters(ranked: DataFrame, vectors: DataFrame, threshold: float = 0.92, min_count: int = 1, top: int | None = None) -> DataFrame:
    """Ranked clusters with those merged that links of cosine >= threshold connect.

    ranked and vectors(fingerprint, embedding) are read several times, so they should be stored. Only clusters of at least `min_count` entries with a
    message and a vector that is not zero merge. Of a merged group the most important one
    (then the largest, then of smallest fingerprint) gives fingerprint and message; counts and
    histograms add up; the group is a trigger if one of its clusters is or its message says so; the
    score is computed anew.
    """
    eligible = ranked.where((F.col("count") >= min_count) & (F.trim(F.coalesce("representative_message", F.lit(""))) != "")).join(vectors.where(F.exists("embedding", lambda x: x != 0)), "fingerprint")
    parts = min_label_components(ranked.select(F.col("fingerprint").alias("node")), merge_edges(eligible.select("fingerprint", "embedding"), threshold)).withColumnRenamed("node", "fingerprint")
    members = ranked.join(parts, "fingerprint")
    best = F.struct(F.col("importance_score"), F.col("count"))
    canon = members.groupBy("component").agg(
        F.min(F.struct((-best["importance_score"]).alias("s"), (-best["count"]).alias("c"), "fingerprint", "representative_message")).alias("_c"),
        F.sum("count").alias("count"), F.sum("baseline_count").alias("baseline_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.max("is_trigger").alias("is_trigger"), F.count("*").alias("_n"), F.max("importance_score").alias("_kept"), F.max("change_ratio").alias("_ratio"),
        F.array_sort(F.flatten(F.collect_list("log_entry_ids"))).alias("log_entry_ids"), F.array_sort(F.collect_list("fingerprint")).alias("_all"),
    )
    t = canon.join(_sum_maps(members, "services"), "component", "left").join(_sum_maps(members, "levels"), "component", "left")
    empty = F.create_map().cast("map<string,bigint>")
    t = t.select(
        F.col("_c.fingerprint").alias("fingerprint"), F.col("_c.representative_message").alias("representative_message"), "count", F.coalesce("services", empty).alias("services"), F.coalesce("levels", empty).alias("levels"),
        "first_seen", "last_seen", "baseline_count", "is_trigger", "log_entry_ids", "_n", "_kept", F.when(F.col("_n") > 1, F.array_remove("_all", F.col("_c.fingerprint"))).otherwise(F.array().cast("array<string>")).alias("merged_fingerprints"),
    )
    t = t.withColumn("is_trigger", F.col("is_trigger") | ((F.col("_n") > 1) & is_trigger(F.col("representative_message"))))
    t = t.withColumn("change_ratio", change_ratio(F.col("count"), F.col("baseline_count")))
    anew = importance(severity(F.col("levels")), F.col("count"), F.col("change_ratio"), F.size("services"), F.col("is_trigger"))
    t = t.withColumn("importance_score", F.when(F.col("_n") > 1, anew).otherwise(F.col("_kept"))).drop("_n", "_kept")
    return rank(t.select(ranked.columns), top)
