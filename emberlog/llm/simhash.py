"""SimHash near-duplicates by a self-join of the binary trie over all fingerprints."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forest, shared_dir, skew_safe_join, stored

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Residents of a trie node at most: heavier nodes are cut at the next bit. Each cut sends
#: fingerprints to more visitors, so nodes are large. All nodes are cut at DEPTH at least; at all 64
#: bits a node has one distinct fingerprint.
BUCKET, DEPTH, DEEPEST = 250_000, 3, 64


def shingle_hashes(text: str | None, shingle: int = 3, seed: int = 42):
    """Yield XXH64 of the word shingles of a text as arrays of at most 65,536, repeats included.

    A-Z are lower-cased; fewer words than a shingle has make one shingle; no words (or null) none.
    """
    words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    k = min(shingle, len(words))
    view, starts = memoryview(b" ".join(words)), [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    digest, n = xxhash.xxh64_intdigest, len(words) - k + 1 if words else 0
    for at in range(0, n, 65536):  # a very long text needs no more memory than a block
        hi = min(n, at + 65536)
        yield np.array([digest(view[i:j], seed) for i, j in zip(starts[at:hi], [x - 1 for x in starts[at + k : hi + k]], strict=True)], dtype=np.uint64)


def majority(blocks) -> int:
    """The 64 bits that are set in over half of the hashes of all blocks; 0 for none."""
    votes, n = np.zeros(64, dtype=np.int64), 0
    for h in blocks:
        votes += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half the hashes of the word shingles.

    Shingles count as often as they occur; no words (or null) give 0.
    """
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row of docs(doc_id, text); fp holds the 64 bits as a signed long."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle, seed) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, dtype=np.uint64).astype(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def trie_pairs(fps: np.ndarray, distance: int, depth: int = 0, own: int = 0, block: int = 65_536):
    """Yield index arrays (i, j) of pairs of sorted distinct uint64 within `distance` bits.

    A node of the binary trie is a range of the sorted array. Pairs of nodes go down together,
    bit by bit; what differs on the way is added up, and a pair of nodes is dropped once it
    exceeds the budget. Small pairs of nodes are compared at once. With `depth`, all nodes there
    are paired with node `own` only.
    """
    n = len(fps)
    if not n:
        return
    if depth:
        top = (fps >> np.uint64(64 - depth)).astype(np.int64)
        at = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
        ends = np.r_[at[1:], n]
        nodes = top[at]
        mine = np.flatnonzero(nodes == own)
        if not len(mine):
            return
        m = mine[0]
        err = np.bitwise_count((nodes ^ own).astype(np.uint64)).astype(np.int64)
        ok = err <= distance
        state = np.stack([np.full(ok.sum(), at[m]), np.full(ok.sum(), ends[m]), at[ok], ends[ok], err[ok], np.full(ok.sum(), depth)])
    else:
        state = np.array([[0], [n], [0], [n], [0], [0]])
    # depth first in blocks: at most a few blocks for each level wait on the stack
    stack = [state.astype(np.int32)]
    while stack:
        s = stack.pop()
        if s.shape[1] > block:
            stack.append(s[:, block:])
            s = s[:, :block]
        al, ah, bl, bh, err, d = s
        self_pair = al == bl
        na, nb = ah - al, bh - bl
        s = s[:, ~(self_pair & (na == 1))]
        al, ah, bl, bh, err, d = s
        self_pair, na, nb = al == bl, ah - al, bh - bl
        leaf = (na.astype(np.int64) * nb <= 16) | (d >= 64)
        if leaf.any():
            la, lb, ln, lm, ls = al[leaf], bl[leaf], na[leaf], nb[leaf], self_pair[leaf]
            count = ln.astype(np.int64) * lm
            of = np.repeat(np.arange(len(la)), count)
            k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            i, j = la[of] + k // lm[of], lb[of] + k % lm[of]
            ok = ~ls[of] | (i < j)
            i, j = i[ok], j[ok]
            near = np.bitwise_count(fps[i] ^ fps[j]) <= distance
            if near.any():
                yield i[near], j[near]
        al, ah, bl, bh, err, d, self_pair = (x[~leaf] for x in (al, ah, bl, bh, err, d, self_pair))
        if not len(al):
            continue
        am, bm = _split(fps, al, ah, d), _split(fps, bl, bh, d)
        one = err + 1
        parts = [
            np.stack([al, am, bl, bm, err, d + 1]),
            np.stack([am, ah, bm, bh, err, d + 1]),
            np.stack([al, am, bm, bh, one, d + 1]),
            np.stack([am, ah, bl, bm, one, d + 1])[:, ~self_pair],
        ]
        s = np.concatenate(parts, axis=1)
        s = s[:, (s[1] > s[0]) & (s[3] > s[2]) & (s[4] <= distance)]
        if s.shape[1]:
            stack.append(s)


def _split(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Where bit d turns to 1 in each range [lo, hi) of a trie node at depth d."""
    shift = (np.uint64(63) - d.astype(np.uint64))
    bound = ((fps[lo] >> shift) | np.uint64(1)) << shift
    return np.clip(np.searchsorted(fps, bound, side="left"), lo, hi).astype(np.int32)


def cut(distinct: DataFrame, bucket: int = BUCKET) -> list[tuple[int, int]]:
    """Nodes (depth, leading bits) that part the trie of all `fp`, none of over `bucket` residents.

    Level by level, the residents of the nodes that are still too heavy are counted. The nodes
    are few: each has a parent of over `bucket` residents.
    """
    nodes, depth = [(DEPTH, i) for i in range(1 << DEPTH)], DEPTH
    while depth < DEEPEST:
        top = F.shiftrightunsigned("fp", 64 - depth).alias("top")
        open_ = [p for d, p in nodes if d == depth]
        counted = distinct.select(top).groupBy("top").agg(F.count("*").alias("n")).where(F.col("n") > bucket)
        heavy = {r.top for r in counted.where(F.col("top").isin(open_)).collect()} if open_ else set()
        if not heavy:
            break
        nodes = [x for x in nodes if x[0] < depth or x[1] not in heavy] + [(depth + 1, 2 * p + bit) for p in sorted(heavy) for bit in (0, 1)]
        depth += 1
    return sorted(nodes, key=lambda x: x[1] << (64 - x[0]))


def near_links(distinct: DataFrame, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints `fp` just as all near pairs do.

    The trie is cut into nodes of bounded residents, deeper where fingerprints crowd. A
    fingerprint goes to the node it lies below and, as a visitor, to every node before that
    whose path is within the budget; each node is joined by trie_pairs and returns a spanning
    forest of its pairs, never the pairs themselves.
    """
    nodes = cut(distinct, bucket)
    depths = np.array([d for d, _ in nodes], np.uint64)
    paths = np.array([p for _, p in nodes], np.uint64)
    low = paths << (np.uint64(64) - depths)

    def send(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            own = np.searchsorted(low, fp.view(np.uint64), side="right") - 1
            for i in range(len(nodes)):
                ok = (own >= i) & (np.bitwise_count((fp.view(np.uint64) >> (np.uint64(64) - depths[i])) ^ paths[i]) <= distance)
                if ok.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(ok.sum(), i, np.int32)), pa.array(fp[ok])], names=["node", "fp"])

    def join(key, table):
        fps = np.sort(table.column("fp").to_numpy().view(np.uint64))
        i = key[0].as_py()
        root = np.arange(len(fps))
        for a, b in trie_pairs(fps, distance, int(depths[i]), int(paths[i])):
            root = forest(len(fps), root[a], root[b])[root]
        linked = np.flatnonzero(root != np.arange(len(fps)))
        return pa.table({"a": fps[linked].view(np.int64), "b": fps[root[linked]].view(np.int64)})

    sent = distinct.select("fp").mapInArrow(send, "node int, fp long")
    return sent.groupBy("node").applyInArrow(join, "a long, b long")


def simhash_components(docs: DataFrame, distance: int = 2, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text).

    Fingerprints link at `distance` or fewer differing bits; component_id is the smallest
    doc_id reachable over links, itself included. Texts that are null or have no word have
    fingerprint zero and link like any other. Rows with a null doc_id keep a row; they
    connect others through their fingerprint but never name a component, which is null if
    none of its rows has an id. Repeated rows and ids give a row each; very long texts are hashed
    whole, in blocks; further columns are ignored; an empty table gives an empty result.
    """
    out = components(stored(fingerprints(docs, shingle), shared_dir(docs.sparkSession), "fp"), distance)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def components(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Add component_id to the stored rows fps(doc_id, fp): see simhash_components."""
    folder = shared_dir(fps.sparkSession)
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), folder, "distinct")
    roots = connected_components(near_links(distinct, distance)).select(F.col("node").alias("fp"), "root")
    named = stored(distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"), "n"), folder, "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("n"))
    by_fp = skew_safe_join(named.select("root", "fp"), least.select("root", "component_id"), "root", named.groupBy("root").agg(F.count("*").alias("n"))).select("fp", "component_id")
    return skew_safe_join(fps, by_fp, "fp", named.select("fp", "n"))


def keep_representatives(docs: DataFrame, distance: int = 2, shingle: int = 3) -> DataFrame:
    """The rows of docs that stay when each group of near copies keeps its smallest doc_id.

    Repeated rows of an id count as copies: one stays. Rows without id cannot be named by a
    group; of those only exact repeats of a text go.
    """
    return representatives(docs, simhash_components(docs, distance, shingle).where("doc_id = component_id"))


def representatives(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of docs whose id is in named(doc_id), each id once, and the texts without id.

    Of rows that share an id the one of least text stays (null first), then of least other columns.
    """
    every = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns])
    keep = named.groupBy("doc_id").agg(F.count("*").alias("n"))
    once = docs.join(keep.where("n = 1").select("doc_id"), "doc_id", "left_semi")
    again = docs.join(keep.where("n > 1").select("doc_id"), "doc_id", "left_semi")
    again = again.groupBy("doc_id").agg(F.min_by(every, F.struct("text", F.to_json(every))).alias("_row")).select("_row.*")
    unnamed = docs.where("doc_id is null").dropDuplicates(["text"])
    return once.unionByName(again).unionByName(unnamed).select(docs.columns)
