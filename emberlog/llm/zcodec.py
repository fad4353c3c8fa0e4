"""Text classification by compressed size: zstandard coders with raw-content dictionaries."""

from __future__ import annotations

from functools import lru_cache

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_per_bucket


@lru_cache(maxsize=512)
def coder(content: bytes, level: int) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def sizes(data: bytes, dictionaries: list[bytes], level: int, block: int) -> list[int]:
    """Bytes that all blocks of data take with each dictionary.

    Blocks start afresh from the dictionary, so a long text is judged by the dictionary all
    the way and not by its own beginning.
    """
    view = memoryview(data)
    blocks = [view[i : i + block] for i in range(0, len(data), block)]
    return [sum(len(c.compress(b)) for b in blocks) for c in (coder(d, level) for d in dictionaries)]


def pieces(texts: DataFrame, ids: DataFrame, key: str, longest: int) -> dict:
    """{key: middle pieces of the sampled texts}; ids(key, doc_id, bucket) is a bounded sample.

    At most `longest` characters of each sampled text come to the driver.
    """
    middle = F.greatest(F.lit(1), F.floor((F.length("text") - longest) / 2) + 1).cast("int")
    rows = (
        texts.join(F.broadcast(ids), "doc_id")
        .groupBy(key, "bucket")
        .agg(F.min(F.substring(F.col("text"), middle, F.lit(longest))).alias("piece"))
        .orderBy(key, "bucket")
        .collect()
    )
    out: dict = {}
    for r in rows:
        if r.piece:
            out.setdefault(r[key], []).append(r.piece)
    return out


def sample_ids(labelled: DataFrame, key: str, buckets: int) -> DataFrame:
    return one_per_bucket(labelled, [key], "doc_id", buckets)


def dictionary(parts: list[str], size: int, piece: int) -> bytes:
    """Middle pieces of the parts, up to `size` bytes; `piece` bytes of each, or more if they are few."""
    share = max(piece, size // max(1, len(parts)))
    out, total = [], 0
    for p in parts:
        b = p.encode("utf-8", "surrogatepass")
        at = max(0, (len(b) - share) // 2)
        b = b[at : at + share]
        if total + len(b) + 1 > size:
            break
        out.append(b)
        total += len(b) + 1
    return b"\n".join(out)
