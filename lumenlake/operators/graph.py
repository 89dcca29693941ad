"""Navigable small-world graphs: layered proximity graphs over shards of a corpus, searched by a beam.

A shard is a few thousand vectors.  Each has a level, drawn so that a layer has one in M of the nodes of the layer below;
within a layer a node is linked to near nodes that are nearer to it than to each other, and links go both ways.  As a
shard fits in memory, the candidates for links are its true nearest nodes, by matrix products, and no search is needed to
find them.  A query goes down the layers to a near node, and from there keeps the `ef` best nodes it has met until all of
them have been looked at.  Many queries take each step at once.

Every shard is searched and the best of all shards are merged, so recall does not depend on how rows are dealt.
"""

from __future__ import annotations

import numpy as np

#: Links of a node (twice as many in the lowest layer), nodes considered for them, and the width of the beam.
LINKS, CONSIDERED, BEAM = 16, 200, 64
#: Nodes whose links are chosen at once.
AT_ONCE = 256


def _chosen(x: np.ndarray, nodes: np.ndarray, near: np.ndarray, links: int) -> np.ndarray:
    """Of each node's candidates, nearest first, up to `links` that are nearer to it than to those chosen before."""
    to_node = np.einsum("nd,ncd->nc", x[nodes], x[near])
    to_chosen = np.full(near.shape, -np.inf, x.dtype)
    open_ = np.ones(near.shape, bool)
    out = np.full((len(nodes), links), -1, np.int32)
    rows = np.arange(len(nodes))
    for k in range(min(links, near.shape[1])):
        first = open_.argmax(1)
        some = open_[rows, first]
        if not some.any():
            break
        pick = near[rows, first]
        out[some, k] = pick[some]
        to_chosen = np.maximum(to_chosen, np.einsum("nd,ncd->nc", x[pick], x[near]))
        open_ &= to_node > to_chosen
        open_[rows, first] = False
    return out


def _layer(x: np.ndarray, links: int, most: int, considered: int) -> np.ndarray:
    """Neighbours of every vector, -1 where there are fewer than `most`: its own choice and those that chose it."""
    n = len(x)
    if n < 2:
        return np.full((n, most), -1, np.int32)
    own = []
    for at in range(0, n, AT_ONCE):
        nodes = np.arange(at, min(n, at + AT_ONCE))
        alike = x[nodes] @ x.T
        alike[np.arange(len(nodes)), nodes] = -np.inf
        many = min(considered, n - 1)
        near = np.argpartition(-alike, many - 1, axis=1)[:, :many]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(alike, near, 1), axis=1, kind="stable"), 1)
        own.append(_chosen(x, nodes, near, links))
    own = np.concatenate(own)
    a, b = np.repeat(np.arange(n), own.shape[1]), own.ravel()
    a, b = a[b >= 0], b[b >= 0]
    ends = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = ends // n, ends % n
    # Of a node that many have chosen, the nearest stay.
    order = np.lexsort((b, -(x[a] * x[b]).sum(1), a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    out = np.full((n, most), -1, np.int32)
    out[a[place < most], place[place < most]] = b[place < most]
    return out


class Graph:
    """The layers of a shard: the numbers of their nodes, and for each node of a layer the numbers of its neighbours."""

    def __init__(self, x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.x, self.layers = np.ascontiguousarray(x, np.float32), layers

    @classmethod
    def of(cls, x: np.ndarray, links: int = LINKS, considered: int = CONSIDERED, seed: int = 7) -> "Graph":
        x = np.ascontiguousarray(x, np.float32)
        level = np.floor(-np.log(1.0 - np.random.default_rng(seed).random(len(x))) / np.log(links)).astype(int)
        layers = []
        for k in range(int(level.max(initial=0)) + 1):
            nodes = np.flatnonzero(level >= k).astype(np.int32)
            layers.append((nodes, _layer(x[nodes], links, 2 * links if k == 0 else links, considered)))
        return cls(x, layers)

    def pack(self) -> bytes:
        parts = [np.array([len(self.layers)], "<i4").tobytes()]
        for nodes, near in self.layers:
            parts += [np.array([len(nodes), near.shape[1]], "<i4").tobytes(), nodes.astype("<i4").tobytes(), near.astype("<i4").tobytes()]
        return b"".join(parts)

    @classmethod
    def unpack(cls, x: np.ndarray, raw: bytes) -> "Graph":
        data, at, layers = np.frombuffer(raw, "<i4"), 1, []
        for _ in range(int(data[0])):
            n, width = data[at], data[at + 1]
            nodes, near = data[at + 2 : at + 2 + n], data[at + 2 + n : at + 2 + n + n * width].reshape(n, width)
            layers.append((nodes, near))
            at += 2 + n + n * width
        return cls(x, layers)

    def _walk(self, layer: int, q: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(the ef best nodes of a layer that each query meets, their scores, how many it meets) from a node each."""
        nodes, near = self.layers[layer]
        x = self.x[nodes]
        many, rows = len(q), np.arange(len(q))
        met = np.zeros((many, len(nodes)), bool)
        met[rows, start] = True
        beam, score = np.full((many, ef), -1), np.full((many, ef), -np.inf, np.float32)
        beam[:, 0], score[:, 0] = start, (q * x[start]).sum(1)
        todo = score > -np.inf
        count = np.ones(many, np.int64)
        while True:
            best = np.where(todo, score, -np.inf).argmax(1)
            live = np.flatnonzero(todo[rows, best])
            if not len(live):
                return nodes[beam.clip(0)], np.where(beam < 0, -np.inf, score), count
            todo[live, best[live]] = False
            found = near[beam[live, best[live]]]
            new = (found >= 0) & ~met[live[:, None], found.clip(0)]
            i, j = np.nonzero(new)
            met[live[i], found[i, j]] = True
            count[live] += new.sum(1)
            fresh = np.full(found.shape, -np.inf, np.float32)
            fresh[i, j] = (q[live[i]] * x[found[i, j]]).sum(1)
            merged = np.concatenate([score[live], fresh], axis=1)
            keep = np.argpartition(-merged, ef - 1, axis=1)[:, :ef]
            take = lambda old, more: np.take_along_axis(np.concatenate([old, more], axis=1), keep, 1)
            score[live], beam[live], todo[live] = np.take_along_axis(merged, keep, 1), take(beam[live], found), take(todo[live], new)

    def search(self, q: np.ndarray, k: int, ef: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each query: about the k best nodes (-1: none), their scores, and how many vectors it has been held against."""
        q, ef = np.ascontiguousarray(q, np.float32), max(ef, k)
        start, total = np.zeros(len(q), int), np.zeros(len(q), np.int64)
        if not len(self.x):
            return np.full((len(q), k), -1), np.full((len(q), k), -np.inf), total
        for layer in range(len(self.layers) - 1, 0, -1):
            got, _, count = self._walk(layer, q, start, 1)
            total += count
            start = np.searchsorted(self.layers[layer - 1][0], got[:, 0])
        got, score, count = self._walk(0, q, start, min(ef, len(self.x)))
        order = np.argsort(-score, axis=1, kind="stable")[:, :k]
        score = np.take_along_axis(score, order, 1)
        return np.where(score > -np.inf, np.take_along_axis(got, order, 1), -1), score, total + count
