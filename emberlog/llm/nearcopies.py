"""Near copies by word shingles: MinHash bands find candidates, exact overlaps of the sets decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import connected_components, forest, shared_dir, stored

#: Words of a shingle, and the Jaccard similarity of shingle sets from which texts are near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: A pair is a candidate if all ROWS minima of one of the BANDS agree: at similarity 0.8 all but
#: (1 - 0.8 ** 5) ** 20 = 0.0004 of the pairs are, and more above.
BANDS, ROWS = 20, 5
#: Sets of a band's bucket that meet the others at once (longer buckets are cut into blocks, and all
#: pairs of blocks meet), and shingles counted at once.
BLOCK, COLUMNS = 1024, 4096
#: Bytes of the sets of a block, about: long texts make smaller blocks.
BYTES = 64 << 20

_R = np.random.default_rng(5)
_A = _R.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_B = _R.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)[:, None]


def _distinct(blocks) -> np.ndarray:
    return np.unique(np.concatenate([np.unique(h) for h in blocks])) if blocks else np.zeros(0, np.uint64)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, as in simhash.fingerprint."""
    return _distinct(list(simhash.shingle_hashes(text, shingle)))


def _signature(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64))


def _bands(s: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(s), 1024):
        np.minimum(low, (s[at : at + 1024] * _A + _B).min(axis=1), out=low)
    return np.array([xxhash.xxh64_intdigest(low[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)], dtype=np.uint64).astype(np.int64)


def _sketches(batches):
    """Of each text, from one pass over its words: fingerprint, and signature and bands of its set."""
    for b in batches:
        fp, sig, bands, n = [], [], [], []
        for t in b.column(1):
            blocks = list(simhash.shingle_hashes(t.as_py(), SHINGLE))
            s = _distinct(blocks)
            fp.append(simhash.majority(blocks))
            sig.append(_signature(s) if len(s) else None)
            bands.append(_bands(s) if len(s) else None)
            n.append(len(s))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, dtype=np.uint64).astype(np.int64)), pa.array(sig, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(n, pa.int64())], names=["doc_id", "fp", "sig", "bands", "hashes"])


def _sets(batches):
    for b in batches:
        found = [shingles(t.as_py()) for t in b.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([_signature(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["sig", "hashes"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two of the sets share, counted exactly."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(n > 1) - 1  # what only one set has is in no overlap
    owner, at = owner[n[at] > 1], column[at[n[at] > 1]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((m, m), np.float32)
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        i, j = np.searchsorted(at, [lo, lo + COLUMNS])
        one = np.zeros((m, min(COLUMNS, int(at[-1]) + 1 - lo)), np.float32)
        one[owner[i:j], at[i:j] - lo] = 1
        out += one @ one.T
    return out


def _links(similarity: float):
    def run(key, table):
        sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        nodes, size = table.column("node").to_numpy(), np.array([len(s) for s in sets], float)
        both = size[:, None] + size
        i, j = np.nonzero(np.triu(overlaps(sets).astype(float) * (1 + similarity) >= similarity * both - 1e-9 * both, 1))
        root = forest(len(sets), i, j)
        # a chain and not a star, so that no node has many links
        order = np.lexsort((nodes, root))
        a, b = order[:-1], order[1:]
        ok = (root[a] == root[b]) & (nodes[a] != nodes[b])
        return pa.table({"a": nodes[a[ok]], "b": nodes[b[ok]]})

    return run


def near_links(docs: DataFrame, sketch: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between groups of documents whose shingle sets are near.

    sketch(doc_id, sig, bands, hashes, node), with the group of each. Texts of equal sets count once. Of
    each bucket of candidates all pairs are compared, by their whole sets; a spanning chain of the
    near ones comes back, never the pairs.
    """
    folder = shared_dir(docs.sparkSession)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    each = stored(sketch.where("sig is not null").groupBy("sig", "node").agg(F.min("doc_id").alias("first"), F.min("bands").alias("bands"), F.min("hashes").alias("hashes")), folder, "each")
    named = each.groupBy("sig").agg(F.min("node").alias("low"))
    same = each.join(named, "sig").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    one = each.groupBy("sig").agg(F.min(F.struct("node", "first", "bands", "hashes")).alias("m"))
    rows = stored(one.select("sig", "m.node", "m.first", "m.hashes", F.explode("m.bands").alias("key")), folder, "rows")
    # a bucket whose sets are all of one group has nothing to add
    many = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("hashes").alias("hashes"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.sum(F.xxhash64("sig").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "sig")).alias("x")).where("n > 1 and lo < hi")
    # near copies share many bands: of buckets with the same sets one is compared
    many = many.groupBy("n", "s", "x").agg(F.min(F.struct("key", "hashes")).alias("m")).select("m.key", "n", F.col("m.hashes").alias("total"))
    members = stored(rows.join(many, "key"), folder, "members")
    wanted = members.select("sig", F.col("first").alias("doc_id")).distinct()
    sets = texts.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("text").mapInArrow(_sets, "sig long, hashes binary").join(wanted.select("sig"), "sig", "left_semi").groupBy("sig").agg(F.min("hashes").alias("hashes"))
    sets = stored(sets, folder, "sets")
    parts = F.greatest(F.ceil(F.col("n") / block), F.least(F.col("n"), F.ceil(8 * F.col("total") / BYTES))).cast("int")
    own = F.pmod(F.xxhash64("sig", F.lit(7)), F.col("parts")).cast("int")
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), F.col("own")))
    dealt = members.withColumn("parts", parts).withColumn("own", own).withColumn("other", F.explode(others))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "sig").join(sets, "sig")
    return dealt.groupBy("key", "i", "j").applyInArrow(_links(similarity), "a long, b long").unionByName(same).distinct()


def keep_representatives(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay when each group of near copies keeps its smallest doc_id.

    Documents link when the fingerprints of their five-word shingles do, in the trie self-join of
    simhash (2 bits), or when their shingle sets have at least this Jaccard similarity. Texts that
    are null or without words are copies of each other; very long ones are hashed in blocks.
    Repeated rows of an id count as copies: one stays. Rows without id cannot be named by a group;
    of those only exact repeats of a text go. Columns of any name go along; an empty table stays
    empty.
    """
    folder = shared_dir(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = stored(texts.mapInArrow(_sketches, "doc_id long, fp long, sig long, bands array<long>, hashes long"), folder, "sketch")
    parts = stored(simhash.components(sketch).where("doc_id is not null").select("doc_id", "sig", "bands", "hashes", F.col("component_id").alias("node")), folder, "parts")
    gone = connected_components(near_links(docs, parts, similarity)).where("node <> root").select(F.col("node").alias("doc_id"))
    return simhash.representatives(docs, parts.where("doc_id = node").select("doc_id").join(gone, "doc_id", "left_anti"))
