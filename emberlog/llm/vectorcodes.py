"""Vector code compression: integer product codes, learned by a treeAggregate over column blocks.

Vectors become integers floor(scale * x), cut into equal consecutive parts; each part is coded by
its nearest entry of that part's codebook. All arithmetic is on integers, so that neither the
layout of the table nor the order of sums changes a code.

Odd rows: vectors that are null, empty or hold null or non-finite components are left out, as are
vectors of another length than the one of smallest id (or, where no id is given, the smallest
vector); integers beyond 2^28 are clamped there, which keeps all sums within 64 bits. Null ids come
last among the entries that codebooks start from, rows of one id in the order of their vectors.
A dimension that the parts don't divide gives the last part fewer components; parts without any
component code as entry 0. Fewer vectors than entries give as many entries as there are vectors;
an empty table gives no rows. Repeated rows count each time. Columns of any other name are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, skew_safe_join, stored

#: Integers are clamped here: squares of differences over 2^4 components and sums over 2^34 rows fit 64 bits.
LARGEST = 1 << 28
#: Bytes of one block of integers, and rows whose distances to all entries are held at once.
BLOCK, ROWS = 4 << 20, 1024


@dataclass(frozen=True)
class Codebooks:
    """Entries of each part, an int64 array (entries, width) a part; `bounds` cut a vector into parts."""

    bounds: tuple[int, ...]
    entries: tuple[np.ndarray, ...]
    scale: int

    @property
    def dim(self) -> int:
        return self.bounds[-1]

    def sha256(self) -> str:
        """Digest of all components as decimal text: by part, entry and position, joined by commas."""
        digest, rest = hashlib.sha256(), ""
        for e in self.entries:
            if e.size:
                digest.update((rest + ",".join(map(str, e.ravel().tolist()))).encode())
                rest = ","
        return digest.hexdigest()


def usable(v: Column) -> Column:
    """Whether a vector can be coded: not null or empty, all components there and finite."""
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & whole


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(x.astype(np.float64) * scale), -LARGEST, LARGEST).astype(np.int64)


def _matrices(batches: Iterator[pa.RecordBatch], at: int, dim: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches, each with its column `at` as integers: a row for each component."""
    step = max(1, BLOCK // (8 * dim))
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            flat = np.asarray(part.column(at).flatten())
            yield part, np.ascontiguousarray(integers(flat.reshape(-1, dim), scale).T)


def nearest(columns: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry for each vector, ties to the lower one, and its squared distance.

    columns has a row for each component; distances of all entries grow component by component.
    They are 32 bits wide where that holds them exactly.
    """
    width, n = columns.shape
    code, error = np.zeros(n, np.int64), np.zeros(n, np.int64)
    most = int(max(np.abs(columns).max(initial=0), np.abs(book).max(initial=0)))
    kind = np.int32 if width * (2 * most) ** 2 < 2**31 else np.int64
    columns, entries = columns.astype(kind), np.ascontiguousarray(book.T.astype(kind))
    for i in range(0, n, ROWS):
        block = columns[:, i : i + ROWS]
        total = np.zeros((block.shape[1], len(book)), kind)
        apart = np.empty_like(total)
        for d in range(width):
            np.subtract(block[d][:, None], entries[d][None, :], out=apart)
            np.multiply(apart, apart, out=apart)
            total += apart
        best = total.argmin(axis=1)
        code[i : i + ROWS], error[i : i + ROWS] = best, total[np.arange(len(best)), best]
    return code, error


def _add_block(sums: list, block: np.ndarray, books: Codebooks) -> list:
    """Add a block's parts to the sums and counts of their nearest entries."""
    for p, book in enumerate(books.entries):
        part = block[books.bounds[p] : books.bounds[p + 1]]
        code, _ = nearest(part, book)
        np.add.at(sums[p][0], code, part.T)
        np.add.at(sums[p][1], code, 1)
    return sums


def _merge(a: list, b: list) -> list:
    for (sums, counts), (more, also) in zip(a, b, strict=True):
        sums += more
        counts += also
    return a


def _blocks(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """The vectors as blocks of integer columns of bounded size, a row each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, columns in _matrices(batches, 0, dim, scale):
            kind = np.int16 if np.abs(columns).max(initial=0) < 2**15 else np.int32
            yield pa.RecordBatch.from_pydict({"width": [np.dtype(kind).itemsize], "columns": [columns.astype(kind).tobytes()]}, pa.schema([("width", pa.int32()), ("columns", pa.binary())]))

    return vectors.select("v").mapInArrow(pack, "width int, columns binary")


def fit(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks | None:
    """Codebooks of all vectors; None if no vector can be coded.

    They start as the parts of the `entries` smallest ids. Each round assigns every part to its
    nearest entry and moves each entry to floor(sum / count) of its parts; an entry without parts
    stays. Only sums and counts travel: one tensor a task, merged in a tree, whose size doesn't
    depend on the table. Blocks of integers are kept for the rounds; what is lost is read again.
    """
    t = vectors.where(usable(F.col(column))).select(F.col(id_col).alias("i"), F.col(column).cast("array<double>").alias("v"))
    first = t.orderBy(F.col("i").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return None
    dim = len(first[0].v)
    while any(len(r.v) != dim for r in first):  # vectors of other lengths are no part of this space
        t = t.where(F.size("v") == dim)
        first = t.orderBy(F.col("i").asc_nulls_last(), "v").limit(entries).collect()
    start = integers(np.array([r.v for r in first]), scale)
    width = -(-dim // parts)
    bounds = tuple(min(dim, width * p) for p in range(parts + 1))
    books = Codebooks(bounds, tuple(start[:, a:b].copy() for a, b in zip(bounds, bounds[1:], strict=False)), scale)
    blocks = _blocks(t.where(F.size("v") == dim), dim, scale).rdd.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for _ in range(rounds):
            zero = [(np.zeros(e.shape, np.int64), np.zeros(len(e), np.int64)) for e in books.entries]

            def add(sums: list, row, books: Codebooks = books) -> list:
                block = np.frombuffer(row.columns, f"i{row.width}").reshape(books.dim, -1)
                return _add_block(sums, block, books)

            moved = blocks.treeAggregate(zero, add, _merge, depth=3)
            books = Codebooks(bounds, tuple(np.where(n[:, None] > 0, s // np.maximum(n, 1)[:, None], e) for e, (s, n) in zip(books.entries, moved, strict=True)), scale)
    finally:
        blocks.unpersist()
    return books


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", column: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """Codes of all vectors: (id, keep..., codes array<int> by part, error long); one pass, no shuffle."""
    t = vectors.where(usable(F.col(column)) & (F.size(column) == books.dim)).select(id_col, *keep, F.col(column).cast("array<double>").alias("v"))
    parts = len(books.entries)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, columns in _matrices(batches, 1 + len(keep), books.dim, books.scale):
            found = [nearest(columns[a:b], e) for a, b, e in zip(books.bounds, books.bounds[1:], books.entries, strict=False)]
            flat = np.stack([c for c, _ in found], axis=1).astype(np.int32).ravel()
            codes = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, parts, dtype=np.int32), flat)
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], codes, pa.array(sum(e for _, e in found))], names=[id_col, *keep, "codes", "error"])

    kinds = T.StructType([vectors.schema[c] for c in (id_col, *keep)]).add("codes", T.ArrayType(T.IntegerType())).add("error", "long")
    return t.mapInArrow(code, kinds)


def decode(codes: DataFrame, books: Codebooks, column: str = "codes", into: str = "embedding") -> DataFrame:
    """Add the vectors that codes stand for: entries over scale; native, for codebooks of bounded size."""
    tables = [F.lit((e / books.scale).tolist()) for e in books.entries]
    return codes.withColumn(into, F.concat(*[F.get(t, F.get(F.col(column), F.lit(p))) for p, t in enumerate(tables)]))


def compress(vectors: DataFrame, label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """Every vector's code as hexadecimal text, with its error and that of its whole label.

    (vec_id, code, error, label_error, codebooks_sha256, label). Null labels are one label. Codes
    are written once; errors meet their label's sum by broadcast of at most 256 hot labels, and by
    a shuffle for the others.
    """
    spark = vectors.sparkSession
    books = fit(vectors, parts=parts, entries=entries, rounds=rounds, scale=scale)
    label = vectors.schema[label_col].dataType.simpleString()
    if books is None:
        return spark.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string, label {label}")
    digits = max(2, len(f"{max(1, entries) - 1:x}"))
    text = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), digits, "0")), "")
    same = F.to_json(F.struct(F.col("label")))
    found = encode(vectors.withColumn("label", F.col(label_col)), books, keep=("label",)).select("vec_id", "label", text.alias("code"), "error", same.alias("_same"))
    found = stored(found, shared_dir(spark), "codes")
    sums = found.groupBy("_same").agg(F.count("*").alias("n"), F.sum("error").alias("label_error"))
    sums = stored(sums, shared_dir(spark), "labels")
    out = skew_safe_join(found, sums.select("_same", "label_error"), "_same", sums.select("_same", "n"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"), "label")
