"""Approximate nearest neighbours by largest inner product: robust-pruned directed graphs in shards."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyarrow.dataset import field
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_batches, shared_dir, stored
from .vectordedup import usable

#: Edges of a node, beams while building and searching (for shards up to SMALL; beyond, the beam
#: grows with the root of the shard, which holds the recall), relaxation of the pruning.
DEGREE, BUILD_BEAM, BEAM, SMALL, ALPHA = 32, 48, 64, 6_400, 1.2
#: Distinct vectors of a shard at most, about; shards that one task searches together; tasks at
#: least (for parallel work). In 64 random dimensions a shard of 25,600 finds 0.96 of the five
#: nearest; larger ones would need longer beams than they save searches.
SHARD, TOGETHER, TASKS = 25_000, 8, 8


class Graph:
    """Directed graph over the rows of x (float32); nearness is squared distance.

    Built in growing batches: greedy searches in the graph so far propose neighbours, relaxed
    distance pruning keeps those that no kept one is much nearer to, and edges go both ways.
    """

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 1):
        self.x = np.ascontiguousarray(x, np.float32)
        self.sq = np.einsum("ij,ij->i", self.x, self.x)
        n = len(x)
        self.degree, self.alpha = min(degree, max(1, n - 1)), alpha
        self.width = self.degree + self.degree // 2  # lists outgrow the degree by half before they are pruned again
        self.edges = np.full((n, self.width), -1, np.int32)
        order = np.random.default_rng(seed).permutation(n)
        mean = self.x.mean(axis=0)
        self.entry = int(np.argmin(self.sq - 2 * self.x @ mean)) if n else 0
        order = np.r_[self.entry, order[order != self.entry]]
        done, batch = 1, 1
        while done < n:
            new = order[done : done + batch]
            near, _ = self.search(self.x[new], beam)
            # the batch's own points may be each other's neighbours, too
            if len(new) > 1:
                d = self.sq[new][None, :] - 2 * self.x[new] @ self.x[new].T
                np.fill_diagonal(d, np.inf)
                k = min(8, len(new) - 1)
                near = np.concatenate([near, new[np.argpartition(d, k - 1, axis=1)[:, :k]]], axis=1)
            self.edges[new, : self.degree] = self._prune(new, near)
            self._back(new)
            done += len(new)
            batch = min(1024, max(1, done // 2))

    def _prune(self, nodes: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Robust pruning of candidates (-1 for none) of each node, in chunks of bounded memory."""
        out = np.full((len(nodes), self.degree), -1, np.int32)
        step = max(1, 2_000_000 // max(1, near.shape[1] ** 2))
        for at in range(0, len(nodes), step):
            out[at : at + step] = self._prune_chunk(nodes[at : at + step], near[at : at + step])
        return out

    def _prune_chunk(self, nodes: np.ndarray, near: np.ndarray) -> np.ndarray:
        near = np.sort(near, axis=1)
        bad = (near < 0) | (near == nodes[:, None])
        bad[:, 1:] |= near[:, 1:] == near[:, :-1]
        c = np.where(bad, 0, near)
        v = self.x[c]
        d = np.maximum(self.sq[c] + self.sq[nodes][:, None] - 2 * np.einsum("ijk,ik->ij", v, self.x[nodes]), 0)
        d[bad] = np.inf
        rank = np.argsort(d, axis=1, kind="stable")
        c, d, v = np.take_along_axis(c, rank, 1), np.take_along_axis(d, rank, 1), np.take_along_axis(v, rank[:, :, None], 1)
        between = self.sq[c][:, :, None] + self.sq[c][:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
        alive = np.isfinite(d)
        out = np.full((len(nodes), self.degree), -1, np.int32)
        rows = np.arange(len(nodes))
        for r in range(self.degree):
            some = alive.any(axis=1)
            if not some.any():
                break
            pick = alive.argmax(axis=1)  # the nearest that is left
            out[some, r] = c[rows, pick][some]
            alive &= ~(self.alpha**2 * between[rows, pick] <= d)
            alive[rows, pick] = False
        return out

    def _back(self, nodes: np.ndarray) -> None:
        """Edges back to the nodes; where a list overflows it is pruned again."""
        to = self.edges[nodes]
        src = np.repeat(nodes, to.shape[1])[to.ravel() >= 0]
        dst = to.ravel()[to.ravel() >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        at = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]]) if len(dst) else np.zeros(0, int)
        count = np.diff(np.r_[at, len(dst)])
        for lo in range(0, len(at), 256):  # lists of similar length would pad less; hubs are few
            a, k = at[lo : lo + 256], count[lo : lo + 256]
            node = dst[a]
            more = np.full((len(a), int(k.max())), -1, np.int64)
            of = np.repeat(np.arange(len(a)), k)
            pos = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            more[of, pos] = src[np.repeat(a, k) + pos]
            both = np.concatenate([self.edges[node], more], axis=1)
            both = -np.sort(-both, axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            size = (both >= 0).sum(axis=1)
            fits = size <= self.width
            self.edges[node[fits]] = -np.sort(-both[fits], axis=1)[:, : self.width]
            if (~fits).any():
                self.edges[node[~fits], : self.degree] = self._prune(node[~fits], both[~fits])
                self.edges[node[~fits], self.degree :] = -1

    def search(self, q: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries together: (nodes, squared distances less |q|^2), nearest first."""
        q = np.ascontiguousarray(q, np.float32)
        n, m = len(self.x), len(q)
        rows = np.arange(m)
        ids = np.full((m, beam), -1, np.int64)
        dist = np.full((m, beam), np.inf, np.float32)
        open_ = np.zeros((m, beam), bool)
        ids[:, 0], dist[:, 0], open_[:, 0] = self.entry, self.sq[self.entry] - 2 * q @ self.x[self.entry], True
        seen = np.zeros((m, n), bool)
        seen[:, self.entry] = True
        active = rows
        while len(active):
            o = open_[active]
            order = np.argsort(np.where(o, dist[active], np.inf), axis=1)[:, :width]
            pick = np.take_along_axis(ids[active], order, 1)
            ok = np.take_along_axis(o, order, 1)
            np.put_along_axis(o, order, False, 1)
            open_[active] = o
            nb = np.where(ok[:, :, None], self.edges[np.maximum(pick, 0)], -1).reshape(len(active), -1)
            r, col = np.nonzero(nb >= 0)
            node = nb[r, col]
            fresh = ~seen[active[r], node]
            r, col, node = r[fresh], col[fresh], node[fresh]
            # a node may come from several lists at once: keep its first
            _, first = np.unique(r * n + node, return_index=True)
            r, col, node = r[first], col[first], node[first]
            seen[active[r], node] = True
            new_d = np.full(nb.shape, np.inf, np.float32)
            new_d[r, col] = self.sq[node] - 2 * np.einsum("ij,ij->i", self.x[node], q[active[r]])
            all_d = np.concatenate([dist[active], new_d], axis=1)
            all_i = np.concatenate([ids[active], nb], axis=1)
            all_o = np.concatenate([open_[active], np.isfinite(new_d)], axis=1)
            best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            dist[active], ids[active], open_[active] = (np.take_along_axis(a, best, 1) for a in (all_d, all_i, all_o))
            active = active[open_[active].any(axis=1)]
        order = np.argsort(dist, axis=1, kind="stable")
        dist, ids = np.take_along_axis(dist, order, 1), np.take_along_axis(ids, order, 1)
        return np.where(np.isfinite(dist), ids, -1), dist


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, beam: int = BEAM, shard: int = SHARD, tasks: int = TASKS) -> DataFrame:
    """The k rows of largest inner product for each row whose vec_id is divisible by `every`.

    vectors(vec_id, embedding) to query_id, rank (from 1), vec_id, score (double precision, on
    the original vectors), nearest first, ties to the smaller vec_id; what has the query's own
    id is no candidate. Vectors that are null, zero or hold null or non-finite components take
    no part, nor do rows without vec_id, nor vectors of another dimension than the query.
    Repeated rows count once; an id with several vectors is a candidate with each, and asks
    with the smallest. Extra columns are ignored; an empty table gives an empty result.

    Equal vectors are one node of the index with its k + 1 smallest ids, which is all that any
    answer can need. Nodes are dealt into shards by hash of the vector. A task builds the graphs
    of a few shards, reads the queries from their table in the shared folder, block by block, and
    hands on the k best that it has for each; only these are shuffled, and ranked. What a lost
    executor takes with it is the graphs of its tasks, of bounded size. To make distance agree
    with inner product, one component is added that evens out the norms.
    """
    folder = shared_dir(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null").where(usable(F.col("embedding"))).distinct()
    rows = stored(rows, folder, "rows")
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id")))
    nodes = stored(ranked.where(F.col("_r") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), folder, "nodes")
    stats = nodes.agg(F.count("*"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))).first()
    n, top = stats[0], float(stats[1] or 0.0)
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    stored(asked.select("vec_id", F.size("embedding").alias("dim"), "embedding"), folder, "asked")
    parts = max(tasks, -(-n // shard))
    together = max(1, min(TOGETHER, parts // tasks))
    index = nodes.select(F.pmod(F.xxhash64("embedding", F.lit(3)), F.lit(parts)).cast("int").alias("shard"), F.size("embedding").alias("dim"), "ids", "embedding")
    dealt = index.repartitionById(-(-parts // together), F.floor(F.col("shard") / together).cast("int")).sortWithinPartitions("dim", "shard")

    def run(batches):
        held, dim = [], None
        for b in batches:
            dims = b.column(1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, dims[1:] != dims[:-1]]) if b.num_rows else []
            for lo, hi in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
                if held and dims[lo] != dim:
                    yield from answers(held, dim)
                    held = []
                dim = int(dims[lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from answers(held, dim)

    def answers(held, dim):
        t = pa.Table.from_batches(held).combine_chunks()
        shards, x = t.column("shard").to_numpy(), t.column("embedding").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        ids = t.column("ids").combine_chunks()
        first, ids = ids.offsets.to_numpy(), ids.values.to_numpy()
        rest = np.sqrt(np.maximum(top - np.einsum("ij,ij->i", x, x), 0))
        even = np.c_[x, rest].astype(np.float32) / max(np.sqrt(top), 1e-300)
        starts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]])
        graphs = [(int(s), Graph(even[s:e])) for s, e in zip(starts, [*starts[1:], len(x)], strict=True)]
        del even
        for block in shared_batches(f"{folder}/asked", ["vec_id", "embedding"], field("dim") == dim):
            me, q = block.column(0).to_numpy(), block.column(1).flatten().to_numpy().reshape(-1, dim)
            flat = np.c_[q, np.zeros(len(q))] / np.maximum(np.sqrt(np.einsum("ij,ij->i", q, q)), 1e-300)[:, None]
            found = [[] for _ in me]
            for start, graph in graphs:
                size = len(graph.x)
                reach = max(k + 1, math.ceil(beam * max(1.0, size / SMALL) ** 0.5))
                step = max(16, min(512, 50_000_000 // size))
                for at in range(0, len(me), step):
                    near, _ = graph.search(flat[at : at + step], reach)
                    for i, nodes_found in enumerate(near):
                        found[at + i].append(nodes_found[nodes_found >= 0] + start)
            yield best(me, q, [np.concatenate(f) for f in found], x, first, ids)

    def best(me, q, found, x, first, ids):
        out: list[list] = [[], [], []]
        for mine, v, f in zip(me.tolist(), q, found, strict=True):
            score = x[f] @ v
            f = f[np.argsort(-score, kind="stable")[: k + 1]] if len(np.unique(score)) == len(score) else f
            rows = [(-float(np.dot(x[i], v)), int(y)) for i in f.tolist() for y in ids[first[i] : first[i + 1]]]
            for s, y in sorted(r for r in rows if r[1] != mine)[:k]:
                out[0].append(mine)
                out[1].append(y)
                out[2].append(-s)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    nearest_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
