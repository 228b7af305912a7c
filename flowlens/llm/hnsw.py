"""Hierarchical navigable small-world graph over the vectors of one shard."""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np

#: Links of a vector on the upper layers (twice as many on the lowest), and beam while building.
LINKS, BUILD_BEAM = 12, 48


class Graph:
    """Unit vectors with layered links; the layer of a vector comes from a seeded generator, so builds agree."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 1):
        self.vectors = np.ascontiguousarray(vectors, dtype=np.float32)
        self.links, n = links, len(vectors)
        draws = np.random.default_rng(seed).random(n)
        self.levels = np.minimum(16, (-np.log(np.maximum(draws, 1e-12)) / math.log(links)).astype(int))
        self.base = np.full((n, 2 * links), -1, dtype=np.int32)
        self.degree = np.zeros(n, dtype=np.int32)
        self.upper: list[dict[int, list[int]]] = []
        self.top = -1
        self.entry = 0
        self._seen, self._stamp = np.zeros(n, dtype=np.int64), 0
        for i in range(n):
            self._insert(i, beam)

    def to_bytes(self) -> bytes:
        """The links; the vectors travel once, beside them."""
        return pickle.dumps((self.links, self.base, self.degree, self.upper, self.top, self.entry), protocol=5)

    @classmethod
    def from_bytes(cls, octets: bytes, vectors: np.ndarray) -> Graph:
        self = cls.__new__(cls)
        self.vectors = np.ascontiguousarray(vectors, dtype=np.float32)
        self.links, self.base, self.degree, self.upper, self.top, self.entry = pickle.loads(octets)
        self._seen, self._stamp = np.zeros(len(self.vectors), dtype=np.int64), 0
        return self

    def _near(self, i: int, layer: int) -> np.ndarray | list[int]:
        return self.base[i, : self.degree[i]] if layer == 0 else self.upper[layer - 1].get(i, [])

    def _beam(self, q: np.ndarray, starts: list[int], beam: int, layer: int) -> list[tuple[float, int]]:
        """The ``beam`` most similar vectors found from ``starts``, most similar first."""
        self._stamp += 1
        seen, stamp, vectors = self._seen, self._stamp, self.vectors
        seen[starts] = stamp
        best = [(float(vectors[s] @ q), s) for s in starts]
        heapq.heapify(best)
        todo = [(-x, s) for x, s in best]
        heapq.heapify(todo)
        while todo:
            x, c = heapq.heappop(todo)
            if len(best) >= beam and -x < best[0][0]:
                break
            near = self._near(c, layer)
            if layer:
                near = np.array(near, dtype=np.int32)
            near = near[seen[near] != stamp]
            if not len(near):
                continue
            seen[near] = stamp
            for s, i in zip((vectors[near] @ q).tolist(), near.tolist(), strict=True):
                if len(best) < beam:
                    heapq.heappush(best, (s, i))
                    heapq.heappush(todo, (-s, i))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, i))
                    heapq.heappush(todo, (-s, i))
        return sorted(best, reverse=True)

    def _spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours in different directions: one that is nearer to a chosen one than to the new vector comes after the others."""
        if len(found) <= most:
            return [i for _, i in found]
        ids = np.array([i for _, i in found])
        among = self.vectors[ids] @ self.vectors[ids].T
        chosen: list[int] = []
        rest: list[int] = []
        closest = np.full(len(ids), -np.inf)
        for k, (s, _) in enumerate(found):
            if closest[k] < s:
                chosen.append(k)
                np.maximum(closest, among[k], out=closest)
                if len(chosen) == most:
                    break
            else:
                rest.append(k)
        return ids[(chosen + rest)[:most]].tolist()

    def _descend(self, q: np.ndarray, layer: int) -> int:
        at, s = self.entry, float(self.vectors[self.entry] @ q)
        for k in range(self.top, layer, -1):
            moved = True
            while moved:
                moved = False
                near = self._near(at, k)
                if len(near):
                    sims = self.vectors[near] @ q
                    j = int(sims.argmax())
                    if sims[j] > s:
                        at, s, moved = int(near[j]), float(sims[j]), True
        return at

    def _insert(self, i: int, beam: int) -> None:
        level, q = int(self.levels[i]), self.vectors[i]
        while len(self.upper) < level:
            self.upper.append({})
        if self.top < 0:
            self.top, self.entry = level, i
            for k in range(1, level + 1):
                self.upper[k - 1][i] = []
            return
        starts = [self._descend(q, level)]
        for k in range(min(level, self.top), -1, -1):
            found = self._beam(q, starts, beam, k)
            starts = [j for _, j in found]
            near = self._spread(found, self.links)
            most = 2 * self.links if k == 0 else self.links
            if k == 0:
                self.base[i, : len(near)], self.degree[i] = near, len(near)
            else:
                self.upper[k - 1][i] = near
            for j in near:
                self._link_back(j, i, k, most)
        for k in range(self.top + 1, level + 1):
            self.upper[k - 1][i] = []
        if level > self.top:
            self.top, self.entry = level, i

    def _link_back(self, j: int, i: int, layer: int, most: int) -> None:
        if layer == 0 and self.degree[j] < most:
            self.base[j, self.degree[j]] = i
            self.degree[j] += 1
            return
        near = [*(self.base[j, : self.degree[j]].tolist() if layer == 0 else self.upper[layer - 1][j]), i]
        if len(near) > most:
            sims = self.vectors[near] @ self.vectors[j]
            near = self._spread(sorted(zip(sims.tolist(), near, strict=True), reverse=True), most)
        if layer == 0:
            self.base[j, : len(near)], self.degree[j] = near, len(near)
            self.base[j, len(near) :] = -1
        else:
            self.upper[layer - 1][j] = near

    def within(self, q: np.ndarray, least: float, beam: int) -> list[int]:
        """Vectors at least ``least`` similar to ``q``: the beam doubles until it reaches past them, then their links are followed."""
        if not len(self.vectors):
            return []
        start, beam = self._descend(q, 0), min(beam, len(self.vectors))
        while True:
            found = self._beam(q, [start], beam, 0)
            if found[-1][0] < least or len(found) < beam or beam >= len(self.vectors):
                break
            beam = min(2 * beam, len(self.vectors))
        hits = [i for s, i in found if s >= least]
        known, todo = set(hits), list(hits)
        while todo:
            near = [j for j in self._near(todo.pop(), 0).tolist() if j not in known]
            if near:
                near = [j for j, s in zip(near, (self.vectors[near] @ q).tolist(), strict=True) if s >= least]
                known.update(near)
                todo += near
        return list(known)
