"""Line dedup: lines that several documents hold stay in the document of smallest id alone.

A line's key is the line without ASCII white space at both ends, A-Z in lower case. Two Bloom
filters over 64-bit hashes of keys tell once-seen from twice-seen ones; they are built in pieces
where the texts are, and merged by segment. Only lines that the second filter suspects shuffle, as
SHA-256 digests of their keys, to be confirmed and to find the first document. A filter has no
false negatives, so its size decides how much shuffles and never what is dropped.

Odd rows: null and empty texts are one empty line. Rows of one doc_id are one document, whose copies
of a line all stay if it is the smallest. Rows without an id take no part: they keep all lines and
make none repeated. Very long texts and lines are read whole. Columns of any other name go along and
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, shared_batches, shared_dir, stored

#: Code points that a key has at least.
SHORTEST = 10
#: Bits a key sets; bits of a filter for each line (of these, 2^LARGEST at most: 64 MB); of a segment.
PROBES, BITS_A_LINE, SEGMENT, LARGEST = 5, 12, 20, 29
#: Bits of one batch that are sorted at once.
TOGETHER = 4_000_000


def keys(text: bytes | None, shortest: int = SHORTEST) -> list[bytes | None]:
    """The key of each line of a UTF-8 text; None for one of under `shortest` code points."""
    found = [line.strip() for line in (text or b"").lower().split(b"\n")]  # of bytes, both know ASCII only
    return [k if len(k) >= 4 * shortest or sum(b & 0xC0 != 0x80 for b in k) >= shortest else None for k in found]


def _hashed(lines: list[bytes | None]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k, 42) for k in lines), np.uint64, len(lines))


def _digest(k: bytes) -> bytes:
    return hashlib.sha256(k).digest()


def positions(h: np.ndarray, bits: int) -> np.ndarray:
    """(hashes, PROBES) places in a filter of 2^bits, spread by double hashing."""
    h = h.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[:, None] + np.arange(PROBES, dtype=np.uint64)[None, :] * step[:, None]) & np.uint64((1 << bits) - 1)


def _set(bitmap: np.ndarray, places: np.ndarray) -> None:
    """Set places, which are sorted and distinct, in a packed bitmap."""
    if len(places):
        at = (places >> np.uint64(3)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        bitmap[at[starts]] |= np.bitwise_or.reduceat(np.left_shift(1, places & np.uint64(7), dtype=np.uint64).astype(np.uint8), starts)


def _test(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bitmap[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 == 1


def add(once: np.ndarray, twice: np.ndarray, h: np.ndarray, bits: int) -> None:
    """Add hashes: a bit that is set a second time is set in `twice`, too.

    A hash that comes twice sets all of its bits twice, whatever else does; so none is missed.
    """
    step = max(1, TOGETHER // PROBES)
    for i in range(0, len(h), step):
        places, count = np.unique(positions(h[i : i + step], bits), return_counts=True)
        again = places[(count > 1) | _test(once, places)]
        _set(twice, again)
        _set(once, places)


def _build(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The two filters of a task's documents, in compressed segments; those without a bit are left out."""
    once, twice = np.zeros(1 << (bits - 3), np.uint8), np.zeros(1 << (bits - 3), np.uint8)
    for batch in batches:
        add(once, twice, np.asarray(batch.column(0).flatten().drop_null()), bits)
    pack, size = zstandard.ZstdCompressor(level=1), 1 << (min(SEGMENT, bits) - 3)
    for i in range(0, len(once), size):
        if once[i : i + size].any():
            yield pa.RecordBatch.from_pydict({"segment": [i // size], "once": [pack.compress(once[i : i + size])], "twice": [pack.compress(twice[i : i + size])]}, pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))


def _merge(bits: int, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One segment from those of all tasks, one at a time: what two tasks have set is set twice."""
    size, unpack = 1 << (min(SEGMENT, bits) - 3), zstandard.ZstdDecompressor()
    once, twice, segment = np.zeros(size, np.uint8), np.zeros(size, np.uint8), None
    for batch in parts:
        for segment, a, b in zip(*batch.select(["segment", "once", "twice"]).columns, strict=True):
            more = np.frombuffer(unpack.decompress(a.as_py()), np.uint8)
            twice |= np.frombuffer(unpack.decompress(b.as_py()), np.uint8) | (once & more)
            once |= more
    if segment is not None and twice.any():
        yield pa.RecordBatch.from_pydict({"segment": [segment.as_py()], "twice": [twice.tobytes()]}, pa.schema([("segment", pa.int32()), ("twice", pa.binary())]))


def filters(found: DataFrame, folder: str, bits: int) -> str:
    """Write the filter of hashes that are seen twice; found has one array of hashes (h) for each document."""
    pieces = found.select("h").mapInArrow(partial(_build, bits), "segment int, once binary, twice binary")
    merged = pieces.groupBy("segment").applyInArrow(_merge_of(bits), "segment int, twice binary")
    merged.write.mode("overwrite").parquet(f"{folder}/twice")
    return f"{folder}/twice"


def _merge_of(bits: int):
    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _merge(bits, parts)

    return merge


@lru_cache(maxsize=1)
def _twice(path: str, bits: int) -> np.ndarray:
    """In a task: the filter of twice-seen hashes, of 2^bits."""
    size = 1 << (min(SEGMENT, bits) - 3)
    out = np.zeros(1 << (bits - 3), np.uint8)
    for batch in shared_batches(path, ["segment", "twice"]):
        for segment, bitmap in zip(batch.column(0), batch.column(1), strict=True):
            at = segment.as_py() * size
            out[at : at + size] = np.frombuffer(bitmap.as_py(), np.uint8)
    return out


def _texts(batch) -> Iterator[bytes | None]:
    return (x.as_py() for x in batch)


def hashes(shortest: int):
    """For mapInArrow over texts: the distinct hashes of keys of each document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(_hashed([k for k in keys(t, shortest) if k is not None])).view(np.int64) for t in _texts(batch.column(0))]
            offsets = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, np.concatenate([*found, np.zeros(0, np.int64)]))], names=["h"])

    return find


def suspects(path: str, bits: int, shortest: int):
    """A function of texts: digests of the keys that the filter has as twice seen."""

    @F.arrow_udf("array<binary>")
    def probe(text: pa.Array) -> pa.Array:
        bitmap, out = _twice(path, bits), []
        for t in _texts(text):
            found = list({k for k in keys(t, shortest) if k is not None})
            hit = _test(bitmap, positions(_hashed(found), bits)).all(axis=1)
            out.append([_digest(found[i]) for i in np.flatnonzero(hit)])
        return pa.array(out, pa.list_(pa.binary()))

    return probe


def without(shortest: int):
    """A function of texts and of digests they lose: what stays, and how many lines go."""

    @F.arrow_udf("kept binary, n_dropped long")
    def cut(text: pa.Array, lost: pa.Array) -> pa.Array:
        kept, n = [], []
        for t, gone in zip(_texts(text), lost, strict=True):
            if gone.is_valid:
                bad = set(gone.as_py())
                stay = [line for line, k in zip(t.split(b"\n"), keys(t, shortest), strict=True) if k is None or _digest(k) not in bad]
                kept.append(b"\n".join(stay))
                n.append(t.count(b"\n") + 1 - len(stay))
            else:
                kept.append(t)
                n.append(0)
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(n, pa.int64())], names=["kept", "n_dropped"])

    return cut


def repeated_lines(documents: DataFrame, shortest: int = SHORTEST, bits: int | None = None) -> tuple[DataFrame, Column]:
    """What each document loses: (id, lost), lost: digests of keys; only documents that lose any.

    Second, the column of suspected digests of a row of documents. `bits` (the filter has 2^bits)
    follows from the number of lines; beyond LARGEST the filter fills up and more digests shuffle.
    """
    folder, text = shared_dir(documents.sparkSession), F.when(F.col("doc_id").isNotNull(), F.col("text").cast("binary"))
    found = stored(documents.select(text.alias("text")).mapInArrow(hashes(shortest), "h array<long>"), folder, "hashes")
    if bits is None:
        total = found.agg(F.sum(F.size("h"))).first()[0] or 0
        bits = min(LARGEST, max(13, (BITS_A_LINE * total).bit_length()))
    held = suspects(filters(found, folder, bits), bits, shortest)(text)
    rows = stored(documents.select(F.col("doc_id").alias("id"), held.alias("held")).select("id", F.explode("held").alias("digest")), folder, "suspects")
    several = rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("digest", "first")
    several = stored(several, folder, "several")  # both sides of the join below are plain shuffles, which are split where a digest is hot
    lost = rows.join(several, "digest").where("id <> first").groupBy("id").agg(F.collect_set("digest").alias("lost"))
    return stored(lost, folder, "lost"), held


def drop_repeated_lines(documents: DataFrame, shortest: int = SHORTEST, bits: int | None = None) -> DataFrame:
    """documents with `kept` (the text that stays), `n_lines` before and `n_dropped`, in place of columns of these names.

    Documents without a suspected line pass by; the others meet what they lose by their id.
    """
    lost, held = repeated_lines(documents, shortest, bits)
    columns = [c for c in documents.columns if c not in ("kept", "n_lines", "n_dropped")]
    size, own, gone, done = fresh(columns, "_held", "_id", "_lost", "_cut")
    columns = [f"`{c}`" for c in columns]
    d = documents.select(*columns, F.size(held).alias(size))
    whole = F.coalesce("text", F.lit(""))
    free = d.where(F.col(size) == 0).select(*columns, whole.alias("kept"), F.lit(0).cast("long").alias("n_dropped"))
    rest = d.where(F.col(size) > 0).join(lost.select(F.col("id").alias(own), F.col("lost").alias(gone)), F.col("doc_id") == F.col(own), "left")
    rest = rest.select(*columns, without(shortest)(F.col("text").cast("binary"), F.col(gone)).alias(done))
    rest = rest.select(*columns, F.col(done)["kept"].cast("string").alias("kept"), F.col(done)["n_dropped"].alias("n_dropped"))
    n_lines = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    return free.unionByName(rest).select(*columns, "kept", n_lines.cast("long").alias("n_lines"), "n_dropped")


def dedup_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document."""
    return drop_repeated_lines(documents.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
