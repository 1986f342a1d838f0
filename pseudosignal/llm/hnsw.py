"""A hierarchical navigable small-world graph over one bounded shard of unit vectors.

After Malkov and Yashunin (2016). Used inside tasks; Spark deals shards and queries out.
"""

from __future__ import annotations

import heapq

import numpy as np

LINKS = 12  # of a node in the upper layers; twice as many in the lowest
BUILD_BEAM = 48
# How much less near a node may be that a widened beam passes through.
SLACK = 0.1


class Graph:
    """vectors: unit rows (double). layers[k]: neighbours of each node of layer k."""

    def __init__(self, vectors: np.ndarray, seed: int = 0) -> None:
        self.vectors = vectors
        self.layers: list[dict[int, np.ndarray]] = []
        self.entry = -1
        self._seen = np.zeros(len(vectors), np.int64)
        self._turn = 0
        random = np.random.default_rng(seed)
        heights = (-np.log(1 - random.random(len(vectors))) / np.log(LINKS)).astype(int)
        for node, height in enumerate(heights.tolist()):
            self._insert(node, height)
        self._link_back()

    def _link_back(self) -> None:
        """Make the links of the lowest layer mutual: a node that all its neighbours have dropped
        could not be found."""
        if not self.layers:
            return
        links = self.layers[0]
        sizes = [len(links[i]) for i in range(len(self.vectors))]
        ends = np.concatenate([links[i] for i in range(len(self.vectors))])
        starts = np.repeat(np.arange(len(self.vectors), dtype=np.int32), sizes)
        pairs = np.unique(
            np.stack([np.append(starts, ends), np.append(ends, starts)], axis=1), axis=0
        )
        bounds = np.searchsorted(pairs[:, 0], np.arange(1, len(self.vectors)))
        self.layers[0] = dict(enumerate(np.split(pairs[:, 1], bounds)))

    def _insert(self, node: int, height: int) -> None:
        vector = self.vectors[node]
        top = len(self.layers) - 1
        start = [self.entry]
        if self.entry >= 0:
            for layer in range(top, height, -1):
                start = [self._beam(vector, start, layer, 1)[0][1]]
        for layer in range(min(top, height), -1, -1):
            found = self._beam(vector, start, layer, BUILD_BEAM)
            most = LINKS * (2 if layer == 0 else 1)
            chosen = self._diverse(found, LINKS)
            links = self.layers[layer]
            links[node] = np.array(chosen, np.int32)
            for other in chosen:
                old = np.append(links[other], np.int32(node))
                if len(old) > most:
                    near = self.vectors[old] @ self.vectors[other]
                    order = np.argsort(-near, kind="stable")
                    ranked = list(zip(near[order].tolist(), old[order].tolist(), strict=True))
                    old = np.array(self._diverse(ranked, most), np.int32)
                links[other] = old
            start = [i for _, i in found]
        for _ in range(top + 1, height + 1):
            self.layers.append({node: np.empty(0, np.int32)})
            self.entry = node

    def _diverse(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Near nodes that are nearer to the new one than to each other; filled up with the rest."""
        if len(found) <= most:
            return [i for _, i in found]
        ids = [i for _, i in found]
        mutual = self.vectors[ids] @ self.vectors[ids].T
        taken: list[int] = []
        best = np.full(len(ids), -2.0)  # similarity to the nearest one taken
        for k, (near, _) in enumerate(found):
            if near > best[k]:
                taken.append(k)
                if len(taken) == most:
                    break
                np.maximum(best, mutual[k], out=best)
        if len(taken) < most:
            have = set(taken)
            rest = (k for k in range(len(ids)) if k not in have)
            taken += [k for k, _ in zip(rest, range(most - len(taken)), strict=False)]
        return [ids[k] for k in taken]

    def _beam(
        self, vector: np.ndarray, start: list[int], layer: int, width: int
    ) -> list[tuple[float, int]]:
        """The nearest nodes met by a beam of this width, nearest first."""
        self._turn += 1
        turn, seen, links, vectors = self._turn, self._seen, self.layers[layer], self.vectors
        start = list(dict.fromkeys(start))
        seen[start] = turn
        near = (vectors[start] @ vector).tolist()
        todo = [(-s, i) for s, i in zip(near, start, strict=True)]
        heapq.heapify(todo)
        kept = list(zip(near, start, strict=True))
        heapq.heapify(kept)
        while len(kept) > width:
            heapq.heappop(kept)
        while todo:
            far, node = heapq.heappop(todo)
            if len(kept) >= width and -far < kept[0][0]:
                break
            around = links[node]
            new = around[seen[around] != turn]
            if not len(new):
                continue
            seen[new] = turn
            near = vectors[new] @ vector
            if len(kept) >= width:
                better = near > kept[0][0]
                new, near = new[better], near[better]
            for s, i in zip(near.tolist(), new.tolist(), strict=True):
                if len(kept) < width:
                    heapq.heappush(kept, (s, i))
                    heapq.heappush(todo, (-s, i))
                elif s > kept[0][0]:
                    heapq.heapreplace(kept, (s, i))
                    heapq.heappush(todo, (-s, i))
        return sorted(kept, key=lambda x: (-x[0], x[1]))

    def within(
        self, vector: np.ndarray, least: float, width: int, own: int | None = None
    ) -> np.ndarray:
        """Nodes with similarity of at least ``least``. ``own``: the node of the vector itself.

        If all of the beam is that near, it is widened to everything that is linked to nodes
        at least nearly as near, so groups of any size come out whole."""
        if self.entry < 0:
            return np.empty(0, np.int64)
        start = [self.entry]
        for layer in range(len(self.layers) - 1, 0, -1):
            start = [self._beam(vector, start, layer, 1)[0][1]]
        if own is not None:
            start.append(own)
        found = self._beam(vector, start, 0, width)
        if len(found) == width and found[-1][0] >= least:
            return self._flood(vector, np.array([i for _, i in found]), least)
        return np.array([i for s, i in found if s >= least], np.int64)

    def _flood(self, vector: np.ndarray, nodes: np.ndarray, least: float) -> np.ndarray:
        self._turn += 1
        self._seen[nodes] = self._turn
        kept, links = [nodes], self.layers[0]
        while len(nodes):
            around = np.unique(np.concatenate([links[i] for i in nodes.tolist()]))
            new = around[self._seen[around] != self._turn]
            self._seen[new] = self._turn
            near = self.vectors[new] @ vector
            nodes = new[near >= least - SLACK]
            kept.append(new[near >= least])
        return np.sort(np.concatenate(kept)).astype(np.int64)

    def arrays(self) -> dict[str, np.ndarray]:
        """What it takes to build the graph again without inserting."""
        out = {"vectors": self.vectors, "entry": np.array([self.entry])}
        for k, layer in enumerate(self.layers):
            nodes = sorted(layer)
            out[f"nodes{k}"] = np.array(nodes, np.int32)
            out[f"sizes{k}"] = np.array([len(layer[i]) for i in nodes], np.int32)
            out[f"links{k}"] = np.concatenate([layer[i] for i in nodes] or [np.empty(0, np.int32)])
        return out

    @classmethod
    def of_arrays(cls, saved: dict[str, np.ndarray]) -> Graph:
        graph = cls(saved["vectors"][:0])
        graph.vectors = saved["vectors"]
        graph.entry = int(saved["entry"][0])
        graph._seen = np.zeros(len(graph.vectors), np.int64)
        k = 0
        while f"nodes{k}" in saved:
            parts = np.split(saved[f"links{k}"], np.cumsum(saved[f"sizes{k}"])[:-1])
            graph.layers.append(dict(zip(saved[f"nodes{k}"].tolist(), parts, strict=True)))
            k += 1
        return graph
