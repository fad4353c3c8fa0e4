"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its nearest reference points (pivots), the nearest first. Its id stands in
an inverted list for each two of them whose places are near the front, so that a list of a pair
is where the lists of two pivots meet. In a list, those that share enough pivots in all are
candidates; only then vectors are fetched, and cosines decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forest, shared_dir, skew_safe_join, stored

#: Fewest and most pivots of an index; between, four times the root of the number of vectors.
FEWEST, MOST = 64, 16_384
#: By number of pivots: how many describe a vector, and the sum that the places (from 0) of two
#: may have for a list of theirs. Recall at a cosine of 0.93, simulated in 64 dimensions: 0.99
#: with 900 pivots, 0.97 with 16,384.
SHAPES = [(2048, 10, 8), (MOST, 12, 10)]
#: Pivots that candidates share at least.
SHARED = 3
#: Rows of a list that are compared at once; longer lists go to verification in blocks.
BLOCK = 4096
#: Groups up to this size are compared pair by pair, larger ones as matrices.
SMALL = 48


def usable(vector: Column) -> Column:
    """A vector that is not null or zero and has only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    """Double-precision rows of a list column without nulls."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither over- nor underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def pick_pivots(vectors: DataFrame, n: int, apart: float) -> np.ndarray:
    """Up to n reference points, no two with cosine over `apart`.

    Drawn from a bounded sample (4 n hash buckets, of each the vector of smallest hash). Points
    in the same group of near copies would order its members at random, so one stands for all.
    """
    h = F.xxhash64("embedding", F.lit(29))
    sample = vectors.groupBy(F.pmod(h, F.lit(4 * n)).alias("bucket")).agg(F.min_by("embedding", F.xxhash64("embedding", F.lit(31))).alias("e")).orderBy("bucket").toArrow()
    if not sample.num_rows:
        return np.zeros((0, 1))
    points = _unit(_matrix(sample.column("e")))
    kept, size = np.empty((n, points.shape[1])), 0
    for v in points:
        if size < n and (not size or (kept[:size] @ v).max() <= apart):
            kept[size] = v
            size += 1
    return kept[:size]


class Shape:
    """The lists of a permutation: pairs of its places, and what two permutations share."""

    def __init__(self, pivots: int):
        self.pivots = pivots
        length, reach = next((x[1:] for x in SHAPES if pivots <= x[0]), SHAPES[-1][1:])
        self.length = min(length, pivots)
        self.pairs = [p for p in combinations(range(self.length), 2) if sum(p) <= reach] or [(0, 0)]
        self.reach, self.shared = reach, min(SHARED, self.length)

    def lists(self, near: np.ndarray) -> np.ndarray:
        """The lists of each permutation, one column for each pair of places."""
        first, second = (near[:, [p[k] for p in self.pairs]].astype(np.int64) for k in (0, 1))
        return np.minimum(first, second) * self.pivots + np.maximum(first, second)

    def meets(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many pivots each two permutations share, and the smallest list that holds both (-1: none)."""
        count, least = np.zeros(len(a), np.int64), np.full(len(a), -1)
        for at in range(0, len(a), 100_000):
            x, y = a[at : at + 100_000], b[at : at + 100_000]
            same = x[:, :, None] == y[:, None, :]
            there = same.any(axis=2)
            place = np.where(there, same.argmax(axis=2), 1 << 20)
            count[at : at + 100_000] = there.sum(axis=1)
            first, second = (place[:, [p[k] for p in self.pairs]] for k in (0, 1))
            both = (first + second <= self.reach) & (first < 1 << 20) & (second < 1 << 20)
            keys = np.where(both, self.lists(x), np.iinfo(np.int64).max).min(axis=1)
            least[at : at + 100_000] = np.where(both.any(axis=1), keys, -1)
        return count, least


def _packed(near: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(near, np.uint16)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * near.shape[1]), len(near), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def _unpacked(column: pa.ChunkedArray, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, length)


def postings(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Inverted lists of vectors(rep, label, embedding): label, list, rep, near, least.

    near holds the permutation, two bytes for each pivot; least is the smallest list of the vector.
    """
    shape = Shape(len(pivots))
    shared = vectors.sparkSession.sparkContext.broadcast(pivots.astype(np.float32))
    step = max(1, min(2048, 8_000_000 // max(1, len(pivots))))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                close = _unit(_matrix(part.column(2))).astype(np.float32) @ shared.value.T
                near = np.argpartition(-close, shape.length - 1, axis=1)[:, : shape.length]
                near = np.take_along_axis(near, np.argsort(-np.take_along_axis(close, near, 1), axis=1, kind="stable"), 1)
                lists, times = shape.lists(near), len(shape.pairs)
                rows = pa.array(np.repeat(np.arange(part.num_rows), times))
                cols = [part.column(1).take(rows), pa.array(lists.ravel()), part.column(0).take(rows), _packed(near).take(rows), pa.array(np.repeat(lists.min(axis=1), times))]
                yield pa.RecordBatch.from_arrays(cols, names=["label", "list", "rep", "near", "least"])

    return vectors.select("rep", "label", "embedding").mapInArrow(run, "label int, list long, rep long, near binary, least long")


def _pairs(starts: np.ndarray, ends: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j of the rows of each group, in arrays of bounded length."""
    size = ends - starts
    small = size <= SMALL
    for d in range(1, int(size[small].max(initial=0))):
        for_d = small & (size > d)
        reach = size[for_d] - d
        i = np.repeat(starts[for_d], reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
        for at in range(0, len(i), most):
            yield i[at : at + most], i[at : at + most] + d
    for s, e in zip(starts[~small], ends[~small], strict=True):
        step = max(1, most // (e - s))
        for lo in range(s, e, step):
            i, j = np.meshgrid(np.arange(lo, min(e, lo + step)), np.arange(lo, e), indexing="ij")
            yield i[i < j], j[i < j]


def _groups(table: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    columns = [table.column(c).to_numpy() for c in keys]
    starts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)])
    return starts, np.r_[starts[1:], table.num_rows]


def candidates(lists: DataFrame, shape: Shape, block: int = BLOCK) -> DataFrame:
    """Rows of the lists whose vectors have to be compared there.

    Such a row shares enough pivots with another one that it meets in no smaller list. Lists of
    over `block` rows are passed on whole, as they come, so that a task holds no more than a block.
    """

    def wanted(table: pa.Table) -> pa.Table:
        near = _unpacked(table.column("near"), shape.length)
        of, hit = table.column("list").to_numpy(), np.zeros(table.num_rows, bool)
        for i, j in _pairs(*_groups(table, ["label", "list"])):
            count, least = shape.meets(near[i], near[j])
            ok = (count >= shape.shared) & (least == of[i])
            hit[i[ok]] = hit[j[ok]] = True
        return table.filter(pa.array(hit))

    def run(batches):
        held, long = None, None  # rows of the last list so far; the list that has outgrown a block
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            if not t.num_rows:
                continue
            starts, ends = _groups(t, ["label", "list"])
            name = lambda i, t=t: (t.column("label")[int(i)].as_py(), t.column("list")[int(i)].as_py())
            done = 0
            if long is not None and name(0) == long:  # the rest of a long list
                done = int(ends[0])
                yield from t.slice(0, done).to_batches()
            last = int(starts[-1])
            if last > done:
                large = [(s, e) for s, e in zip(starts[:-1], ends[:-1], strict=True) if e - s > block and s >= done]
                for s, e in large:
                    yield from t.slice(int(s), int(e - s)).to_batches()
                some = np.ones(last - done, bool)
                for s, e in large:
                    some[s - done : e - done] = False
                yield from wanted(t.slice(done, last - done).filter(pa.array(some)).combine_chunks()).to_batches()
                done = last
            if done < t.num_rows and t.num_rows - done > block:
                long = name(t.num_rows - 1)
                yield from t.slice(done).to_batches()
                done = t.num_rows
            elif done == t.num_rows:
                long = name(t.num_rows - 1)
            else:
                long = None
            held = t.slice(done).combine_chunks() if done < t.num_rows else None
        if held is not None and held.num_rows:
            yield from wanted(held).to_batches()

    return lists.repartition("label", "list").sortWithinPartitions("label", "list").mapInArrow(run, lists.schema)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row for each row of vectors(vec_id, embedding, label): links at cosine >= threshold.

    vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable,
    itself included), kept (vec_id = component_id). Only vectors of the same label (not null)
    and dimension are compared; vectors that are null, zero or hold null or non-finite
    components link with nothing, nor do rows without vec_id (component null, kept).
    Repeated ids count as one node of the graph, each row as a vector of its own. Extra columns
    are ignored; an empty table gives an empty result.

    Equal vectors are first joined to one with a count. The index may miss pairs near the
    threshold (see SHAPES), and nothing below it links. With `pivots` = 1 there is one list for a
    label, of which all pairs are compared in blocks: the exact way, of quadratic work.
    """
    spark = vectors.sparkSession
    folder = shared_dir(spark)
    kind = vectors.schema["embedding"].dataType.simpleString()
    vector = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"), F.col("label").cast("int").alias("label"))
    good = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    key = F.concat(*[F.hex(F.xxhash64(F.lit(seed), "label", "embedding")) for seed in (1, 2)])  # 128 bits tell vectors apart
    rows = rows.withColumn("key", F.when(good, key))
    distinct = stored(rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.min("label").alias("label"), F.min_by("embedding", "vec_id").alias("embedding"), F.count("*").alias("copies")), folder, "distinct")
    ids = stored(rows.select("vec_id", "key"), folder, "ids")
    n = distinct.count()
    links = []
    for dim in [r[0] for r in distinct.select(F.size("embedding").alias("d")).distinct().collect()]:
        links.append(_links(distinct.where(F.size("embedding") == dim), n, threshold, pivots, block, f"{folder}/{dim}"))
    if not links:
        found = spark.createDataFrame([], "rep long, linked long, peer long")
    else:
        found = links[0]
        for x in links[1:]:
            found = found.unionByName(x)
    counted = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    roots = connected_components(found.where("peer is not null").select(F.col("rep").alias("a"), F.col("peer").alias("b")))
    known = distinct.select("key", "rep", "copies").join(counted, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    known = stored(known.select("key", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"), "copies"), folder, "known")
    out = skew_safe_join(ids.where("key is not null"), known.drop("copies"), "key", known.select("key", F.col("copies").alias("n")), how="inner").select("vec_id", "n_links", "component_id")
    rest = ids.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _links(distinct: DataFrame, n: int, threshold: float, pivots: int | None, block: int, folder: str) -> DataFrame:
    """(rep, linked, peer): partial counts of linked vectors, and a member of the same component."""
    points = pick_pivots(distinct, pivots or min(MOST, max(FEWEST, 4 * math.isqrt(n))), threshold - 0.1)
    shape = Shape(len(points))
    met = stored(candidates(postings(distinct, points), shape, block), folder, "candidates")
    # where all rows of a list have one smaller list in common, that one compares them
    length = met.groupBy("label", "list").agg(F.count("*").alias("n"), F.min("least").alias("low"), F.max("least").alias("high")).where("n > 1 and not (low = high and high < list)")
    blocks = length.select("label", "list", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")).cast("int")
    # a row of block b goes to all pairs of blocks that b is in; within (b, b) all are compared
    to = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j")))
    cut = (
        met.join(blocks, ["label", "list"])
        .withColumn("mine", mine)
        .withColumn("to", F.explode(to))
        .select("label", "list", "to.i", "to.j", F.when(F.col("to.i") == F.col("to.j"), 2).when(F.col("mine") == F.col("to.i"), 0).otherwise(1).alias("side"), "rep", "near", "least")
    )
    dealt = cut.join(distinct.select("rep", "embedding", "copies"), "rep").repartition("label", "list", "i", "j").sortWithinPartitions("label", "list", "i", "j", "least")

    def compare(table: pa.Table) -> pa.Table:
        starts, ends = _groups(table, ["label", "list", "i", "j"])
        unit, near = _unit(_matrix(table.column("embedding"))), _unpacked(table.column("near"), shape.length)
        of, least, side = (table.column(c).to_numpy() for c in ("list", "least", "side"))
        small = ends - starts <= SMALL
        found = []
        for i, j in _pairs(starts[small], ends[small]):
            ok = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
            found.append((i[ok], j[ok]))
        for s, e in zip(starts[~small], ends[~small], strict=True):
            found += _large(unit, least, int(s), int(e), int(of[s]), threshold)
        i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
        ok = (side[i] == 2) | (side[i] != side[j])
        i, j = i[ok], j[ok]
        ok = shape.meets(near[i], near[j])[1] == of[i]  # each pair counts in one list
        i, j = i[ok], j[ok]
        rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        ids, at = np.unique(rep, return_inverse=True)
        linked = np.bincount(at[i], copies[j], len(ids)) + np.bincount(at[j], copies[i], len(ids))
        root = forest(len(ids), at[i], at[j])
        hit = np.flatnonzero(linked > 0)
        return pa.table({"rep": ids[hit], "linked": linked[hit].astype(np.int64), "peer": pa.array(ids[root[hit]], mask=root[hit] == hit)})

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            if not t.num_rows:
                continue
            last = int(_groups(t, ["label", "list", "i", "j"])[0][-1])  # this group may go on in the next batch
            if last:
                yield from compare(t.slice(0, last).combine_chunks()).to_batches()
            held = t.slice(last).combine_chunks()
        if held is not None and held.num_rows:
            yield from compare(held).to_batches()

    return stored(dealt.mapInArrow(run, "rep long, linked long, peer long"), folder, "links")


def _large(unit: np.ndarray, least: np.ndarray, s: int, e: int, of: int, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the rows s to e, sorted by `least`, with a cosine of the threshold or more.

    Rows with the same smallest list meet there, so that in larger lists only rows with different
    ones are compared.
    """
    out = []
    cuts = s + np.flatnonzero(np.r_[True, least[s + 1 : e] != least[s : e - 1]])
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), e], strict=True):
        within = least[a] == of
        for lo in range(a, b, 512):
            hi = min(b, lo + 512)
            start = lo if within else b
            if start < e:
                i, j = np.nonzero(unit[lo:hi] @ unit[start:e].T >= threshold)
                i, j = i + lo, j + start
                out.append((i[i < j], j[i < j]))
    return out
