"""Hierarchical navigable small-world graphs, one per shard, with shard results merged.

A shard's graph is a stack of layers, each a flat array of neighbour numbers over a prefix of the shard's vectors in
random order. Inner products become distances in one more dimension (every vector is lifted to the same length), so the
graph is a metric one. A node's candidates are its nearest in its layer, found block by block with matrix products, and
its nearest in the sparser layers, which give the long links; diverse ones are kept and linked back.

Whole batches of queries walk the graph in step: each round expands the best unexpanded entries of all beams at once.
How wide the beam must be depends on the data. Each shard fits its own: SAMPLE of its vectors are searched by brute
force, and the beam doubles until the walk finds TARGET of their neighbours.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .vectors import K, QUERY_EVERY, _top, _usable

LINKS = 16
NEAR, FAR = 40, 4
ENTRIES = 16
LAYER_RATIO = 16
TOP_LAYER = 64
#: The shard's beam: the first one tried, and the bounded sample that it is fitted on.
BEAM, SAMPLE, TARGET = 64, 128, 0.95
#: Similarities that are held at a time.
CELLS = 1 << 23


class Graph:
    """Layers over lifted vectors; the last one holds all of them."""

    def __init__(self, vectors: np.ndarray):
        square = (vectors * vectors).sum(1)
        lift = np.sqrt(np.maximum(square.max(initial=0) - square, 0))
        self.x = np.ascontiguousarray(np.c_[vectors, lift], dtype=np.float32)
        sizes = [len(vectors)]
        while sizes[-1] > TOP_LAYER:
            sizes.append(sizes[-1] // LAYER_RATIO)
        self.sizes = sizes[::-1]  # from the sparsest up; the first has no links, all of it is looked at
        self.layers = [self._layer(n) for n in range(1, len(self.sizes))]  # (nodes, links), -1 where there is none
        self.beam = BEAM

    def nearest(self, of: np.ndarray, size: int, count: int) -> np.ndarray:
        """The nodes below ``size`` that are most similar to the rows ``of``, without order."""
        count = min(count, size)
        group = max(1, size // 512)
        whole = size // group * group
        out = np.empty((len(of), count), dtype=np.int64)
        step = max(1, CELLS // size)
        for at in range(0, len(of), step):
            sims = of[at : at + step] @ self.x[:size].T
            rows = np.arange(len(sims))[:, None]
            if group > 1 and whole // group > count:
                # the best lie in the groups of the best maxima, or past the last whole group
                best = sims[:, :whole].reshape(len(sims), -1, group).max(axis=2)
                best = np.argpartition(-best, count - 1, axis=1)[:, :count]
                some = (best[:, :, None] * group + np.arange(group)).reshape(len(sims), -1)
                some = np.concatenate([some, np.broadcast_to(np.arange(whole, size), (len(sims), size - whole))], axis=1)
                few = np.argpartition(-sims[rows, some], count - 1, axis=1)[:, :count]
                out[at : at + step] = some[rows, few]
            else:
                out[at : at + step] = np.argpartition(-sims, count - 1, axis=1)[:, :count]
        return out

    def _layer(self, level: int) -> np.ndarray:
        size, links = self.sizes[level], []
        step = 1024
        for at in range(0, size, step):
            nodes = np.arange(at, min(size, at + step))
            found = [self.nearest(self.x[nodes], size, NEAR + 1)]
            found += [self.nearest(self.x[nodes], n, FAR) for n in self.sizes[:level]]
            links.append(self._diverse(nodes, np.concatenate(found, axis=1)))
        return self._linked_back(np.concatenate(links))

    def _diverse(self, nodes: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Up to LINKS of each node's candidates, none nearer to one chosen before than to the node; free places go to
        the nearest of the rest."""
        rows = np.arange(len(nodes))[:, None]
        found = np.sort(found, axis=1)
        repeated = np.zeros(found.shape, dtype=bool)
        repeated[:, 1:] = found[:, 1:] == found[:, :-1]
        sim = np.matmul(self.x[found], self.x[nodes][:, :, None])[:, :, 0]
        sim[repeated | (found == nodes[:, None])] = -np.inf
        order = np.argsort(-sim, axis=1, kind="stable")
        node, sim = found[rows, order], sim[rows, order]
        x = self.x[node]
        between = np.matmul(x, x.transpose(0, 2, 1))
        kept, rival = np.zeros(node.shape, dtype=bool), np.full(node.shape, -np.inf, dtype=np.float32)
        count = np.zeros(len(node), dtype=np.int64)
        for j in range(node.shape[1]):
            take = (sim[:, j] > np.maximum(rival[:, j], -np.inf)) & (count < LINKS) & (sim[:, j] > -np.inf)
            kept[:, j] = take
            count += take
            rival[take] = np.maximum(rival[take], between[take, j])
        rank = np.where(kept, 0, np.where(sim > -np.inf, 1, 2))
        order = np.argsort(rank, axis=1, kind="stable")[:, :LINKS]
        out = np.where(rank[rows, order] < 2, node[rows, order], -1)
        return np.pad(out, ((0, 0), (0, LINKS - out.shape[1])), constant_values=-1)

    def _linked_back(self, links: np.ndarray) -> np.ndarray:
        """Every node's links, then the nearest of those that link to it, 2 * LINKS in all."""
        n = len(links)
        layer = np.full((n, 2 * LINKS), -1)
        layer[:, :LINKS] = links
        source, target = np.repeat(np.arange(n), LINKS), links.ravel()
        source, target = source[target >= 0], target[target >= 0]
        mutual = (links[target] == source[:, None]).any(axis=1)
        source, target = source[~mutual], target[~mutual]
        sim = np.empty(len(source), dtype=np.float32)
        for at in range(0, len(source), 1 << 18):
            part = slice(at, at + (1 << 18))
            sim[part] = np.einsum("nd,nd->n", self.x[source[part]], self.x[target[part]])
        order = np.lexsort((-sim, target))
        source, target = source[order], target[order]
        nth = np.arange(len(target)) - np.searchsorted(target, target)
        keep = nth < LINKS
        layer[target[keep], LINKS + nth[keep]] = source[keep]
        return layer

    def _walk(self, layer: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int) -> np.ndarray:
        """Beams of nodes, best first, of every row of ``q``; -1 fills what was not found."""
        beam = min(beam, len(layer))
        expand = min(beam, max(4, beam // 32))
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), len(layer) + 1), dtype=bool)
        seen[:, -1] = True
        node = np.full((len(q), beam), -1)
        sim = np.full((len(q), beam), -np.inf, dtype=np.float32)
        done = np.ones((len(q), beam), dtype=bool)
        start = start[:, :beam]
        width = start.shape[1]
        node[:, :width], done[:, :width] = start, False
        sim[:, :width] = np.matmul(self.x[start], q[:, :, None])[:, :, 0]
        seen[rows, start] = True
        while True:
            waiting = np.where(done, -np.inf, sim)
            pick = np.argpartition(-waiting, expand - 1, axis=1)[:, :expand]
            live = np.flatnonzero(~done[rows, pick].all(axis=1))
            if not len(live):
                break
            r, p = live[:, None], pick[live]
            chosen = np.where(done[r, p], -1, node[r, p])
            done[r, p] = True
            near = np.where(chosen[..., None] >= 0, layer[chosen], -1).reshape(len(live), -1)
            near[seen[r, near]] = -1
            seen[r, near] = True
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            got = np.matmul(self.x[near], q[live][:, :, None])[:, :, 0]
            got[near < 0] = -np.inf
            all_sim = np.concatenate([sim[live], got], axis=1)
            best = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
            rr = np.arange(len(live))[:, None]
            sim[live] = all_sim[rr, best]
            node[live] = np.concatenate([node[live], near], axis=1)[rr, best]
            done[live] = np.concatenate([done[live], near < 0], axis=1)[rr, best] | (sim[live] == -np.inf)
        return node[rows, np.argsort(-sim, axis=1, kind="stable")]

    def search(self, q: np.ndarray, beam: int | None = None) -> np.ndarray:
        """Nodes found for the rows of ``q``, -1 where there are fewer than the beam."""
        q = np.ascontiguousarray(np.c_[q, np.zeros(len(q))], dtype=np.float32)
        if not self.layers:
            return np.broadcast_to(np.arange(len(self.x)), (len(q), len(self.x)))
        at = self.nearest(q, self.sizes[0], ENTRIES)
        for layer in self.layers[:-1]:
            at = self._walk(layer, q, at, ENTRIES)
        return self._walk(self.layers[-1], q, at, beam or self.beam)

    def fit_beam(self, vectors: np.ndarray, k: int) -> float:
        """Double the beam until the walk finds TARGET of the sample's k nearest or holds the whole shard; the recall."""
        sample = vectors[np.linspace(0, len(vectors) - 1, min(SAMPLE, len(vectors))).astype(int)]
        lifted = np.ascontiguousarray(np.c_[sample, np.zeros(len(sample))], dtype=np.float32)
        want = self.nearest(lifted, len(self.x), k)
        while True:
            found = self.search(sample)
            recall = np.mean([len(np.intersect1d(a, b)) for a, b in zip(want, found)]) / want.shape[1]
            if recall >= TARGET or self.beam >= len(self.x):
                return recall
            self.beam *= 2


def graph_search(rows: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int) -> Callable:
    """Build a shard's graph over its distinct vectors; a vector that many rows repeat is one node."""
    distinct, of = np.unique(matrix, axis=0, return_inverse=True)
    spread = np.argsort((np.arange(len(distinct)) * 0x9E3779B1) % (1 << 32), kind="stable")
    distinct, place = distinct[spread], np.argsort(spread)
    of = place[of.ravel()]
    order = np.lexsort((ids, of))
    at = np.searchsorted(of[order], np.arange(len(distinct) + 1))
    graph = Graph(distinct)
    graph.fit_beam(distinct, k + 1)

    def run(q_rows: np.ndarray, q: np.ndarray):
        out = []
        nodes = graph.search(q)
        for i in range(len(q)):
            own = nodes[i][nodes[i] >= 0]
            score = distinct[own] @ q[i]
            best = np.argsort(-score, kind="stable")[: k + 1]
            # of the rows that share a vector the k + 1 of smallest id suffice
            found = [order[at[v] : min(at[v + 1], at[v] + k + 1)] for v in own[best].tolist()]
            points = np.repeat(score[best], [len(f) for f in found])
            found = np.concatenate(found)
            other = rows[found] != q_rows[i]
            found, points = ids[found[other]], points[other]
            top = np.lexsort((found, -points))[:k]
            out.append((np.full(len(top), i), found[top], points[top]))
        of_query, found, score = (np.concatenate(c) for c in zip(*out))
        return of_query.astype(np.int64), found.astype(np.int64), score.astype(np.float64)

    return run


def nearest(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, shards: int | None = None) -> DataFrame:
    """(vec_id, embedding) -> (query_id, rank, vec_id, score): k nearest found by inner product in doubles.

    Vectors that are null, empty, all zero or hold a null or non-finite component take no part; others meet those of
    their own length. A row repeated whole counts once. Rows that share an id but not the vector are queries and
    candidates of their own, each query with k results. Ties go to the smaller vec_id. An empty table gives an empty
    result; other columns are ignored, whatever their names. Scores of what is found are exact. Every shard fits its
    beam until it finds 0.95 of what brute force finds for a sample of its own rows.
    """
    some = vectors.where("exists(embedding, x -> x <> 0)")
    return _top(_usable(some), graph_search, "double", k, every, shards)


def op1_ann_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
