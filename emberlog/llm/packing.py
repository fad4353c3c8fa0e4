"""Best-fit packing into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored, word_count

CAPACITIES = (512, 1024, 2048, 4096)
#: Words that one packing task should hold, about; its rows are ids and sizes only.
SHARD = 8_000_000
#: What a bin costs besides its length (in words): masks, padding to a tile, one more sequence.
OVERHEAD = 16.0


def pack(sizes: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of items of 1 to max(capacities) words, given largest first.

    An item goes to the open bin, of whatever length, that it leaves the least room in. If
    none has room, a bin is opened: of the lengths that hold the item, the one whose cost for
    each word is least if the room it leaves is filled as well as items still to come can
    fill it. At the end each bin shrinks to the smallest permitted length that holds its
    contents. Returns for each item its bin, its offset in the bin, and for each bin its length.
    """
    caps = sorted(capacities)
    rooms: list[int] = []  # distinct rooms of open bins, ascending
    bins_of: dict[int, list[int]] = {}
    used: list[int] = []
    bin_id, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    left = np.concatenate([np.cumsum(sizes[::-1])[::-1], [0]])  # words still to come

    def add(room: int, b: int) -> None:
        if room:
            if room not in bins_of:
                bins_of[room] = []
                insort(rooms, room)
            bins_of[room].append(b)

    for i, s in enumerate(sizes.tolist()):
        at = bisect_left(rooms, s)
        if at < len(rooms):
            room = rooms[at]
            b = bins_of[room].pop()
            if not bins_of[room]:
                del bins_of[room], rooms[at]
        else:
            rest = int(left[i + 1])
            room = min((c for c in caps if c >= s), key=lambda c: ((c + overhead) / min(c, s + rest), c))
            b = len(used)
            used.append(0)
        bin_id[i], offset[i] = b, used[b]
        used[b] += s
        add(room - s, b)
    full = np.array(used, np.int64)
    return bin_id, offset, np.array(caps, np.int64)[np.searchsorted(caps, full)] if len(full) else full


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, shard: int = SHARD, overhead: float = OVERHEAD) -> DataFrame:
    """Place all words of docs(doc_id, text) into bins of permitted lengths.

    One row for each segment: doc_id, part (from 0), start (words before it in the text),
    length (words), bin_id (string, unique over all shards), bin_length (permitted length),
    bin_offset (words before it in the bin). A text longer than the largest length is cut into
    full bins and a rest. Null texts and texts without words get one row of length 0 without
    bin; they pass by the packing tasks, however many they are. Repeated rows are packed each by
    itself (their segments are told apart by bin and offset only), and spread over all shards by
    their places in the input; a null doc_id packs like any other. Ties of length go by doc_id and
    part. Extra columns are ignored; an empty table gives an empty result. Reruns over the same
    files agree.
    """
    folder = shared_dir(docs.sparkSession)
    sized = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_text"), F.monotonically_increasing_id().alias("_row")), folder, "sized")
    total = sized.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // shard))
    top = max(capacities)
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("size") - 1) / top)).cast("int")), lambda k: F.struct(k.alias("part"), (k * top).cast("long").alias("start"), F.least(F.lit(top), F.col("size") - k * top).cast("long").alias("length")))
    cut = sized.withColumn("_x", F.explode(parts)).select("doc_id", "_text", "_row", "_x.part", "_x.start", "_x.length")
    cut = cut.withColumn("_shard", F.pmod(F.xxhash64(F.lit(5), "doc_id", "part", "length", "_text", "_row"), F.lit(shards)).cast("int"))

    def run(key, table):
        # largest first; the rest of the order only makes reruns agree
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("part", "ascending"), ("_row", "ascending")])
        b, off, caps = pack(table.column("length").to_numpy(), capacities, overhead)
        shard_no = key[0].as_py()
        names = pa.array([f"{shard_no}-{x}" for x in b.tolist()], pa.string())
        return pa.table([table.column("doc_id"), table.column("part"), table.column("start"), table.column("length"), names, pa.array(caps[b]), pa.array(off)], names=["doc_id", "part", "start", "length", "bin_id", "bin_length", "bin_offset"])

    schema = "doc_id long, part int, start long, length long, bin_id string, bin_length long, bin_offset long"
    packed = cut.where("length > 0").groupBy("_shard").applyInArrow(run, schema)
    none = lambda kind: F.lit(None).cast(kind)
    blank = sized.where("size <= 0").select("doc_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("start"), "size", none("string"), none("long"), none("long"))
    return packed.union(blank)
