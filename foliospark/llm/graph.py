"""Robust-pruned directed graph over the unit vectors of one shard, in numpy.

Vectors enter in batches that grow with the graph. A beam search from the entry points proposes the neighbours of a
batch, relaxed pruning keeps diverse edges, and edges are made both ways. All searches of a batch run together.
"""

from __future__ import annotations

import numpy as np


class Graph:
    """Graph of the rows of ``x`` (unit vectors, float32)."""

    def __init__(self, x: np.ndarray, degree: int = 20, beam: int = 24, relax: float = 1.15, seed: int = 1):
        self.x = np.ascontiguousarray(x, np.float32)
        self.n, self.degree, self.beam, self.relax = len(x), degree, beam, relax
        #: room for half as many edges again, so that pruning runs only now and then
        self.edges = np.full((self.n, degree + degree // 2), -1, np.int32)
        rng = np.random.default_rng(seed)
        order = rng.permutation(self.n).astype(np.int32)
        self.entries = order[: min(128, self.n)]
        done = len(self.entries)
        self._all_pairs(order[:done])
        while done < self.n:
            batch = order[done : done + max(16, min(512, done // 8))]
            self._insert(batch)
            done += len(batch)

    def _all_pairs(self, ids: np.ndarray) -> None:
        if len(ids) < 2:
            return
        sims = self.x[ids] @ self.x[ids].T
        np.fill_diagonal(sims, -2)
        cand = np.broadcast_to(ids, sims.shape)
        order = np.argsort(-sims, axis=1)[:, :-1]
        cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
        self.edges[ids, : self.degree] = self._prune(cand[:, :48], sims[:, :48])

    def search(self, q: np.ndarray, beam: int | None = None, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of each row of ``q``: the nodes of its final beam and their similarities, the most similar first."""
        beam = beam or self.beam
        b = len(q)
        row = np.arange(b)
        seen = np.zeros((b, self.n), bool)
        ids = np.full((b, beam), -1, np.int32)
        sims = np.full((b, beam), -2.0, np.float32)
        opened = np.ones((b, beam), bool)
        m = min(beam, len(self.entries))
        start = q @ self.x[self.entries].T
        order = np.argsort(-start, axis=1)[:, :m]
        ids[:, :m], sims[:, :m] = self.entries[order], np.take_along_axis(start, order, 1)
        opened[:, :m] = False
        seen[:, self.entries] = True
        active = row
        while len(active):
            closed = ~opened[active]
            pick = np.argsort(~closed, axis=1, kind="stable")[:, :expand]
            use = np.take_along_axis(closed, pick, 1)
            keep = use.any(1)
            active, pick, use = active[keep], pick[keep], use[keep]
            if not len(active):
                break
            opened[active[:, None], pick] = True
            nodes = np.take_along_axis(ids[active], pick, 1)
            near = self.edges[np.where(use, nodes, 0)]
            near = np.where(use[:, :, None], near, -1).reshape(len(active), -1)
            r, c = np.nonzero(near >= 0)
            nb = near[r, c]
            ar = active[r]
            new = ~seen[ar, nb]
            r, nb, ar = r[new], nb[new], ar[new]
            seen[ar, nb] = True
            s = np.einsum("ij,ij->i", self.x[nb], q[ar])
            good = s > sims[ar, -1]
            r, nb, s = r[good], nb[good], s[good]
            counts = np.bincount(r, minlength=len(active))
            wide = int(counts.max()) if len(r) else 0
            if not wide:
                continue
            place = np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts)
            add = np.full((len(active), wide), -1, np.int32)
            add_sim = np.full((len(active), wide), -2.0, np.float32)
            add[r, place], add_sim[r, place] = nb, s
            all_sim = np.concatenate((sims[active], add_sim), 1)
            top = np.argsort(-all_sim, axis=1)[:, :beam]
            ids[active] = np.take_along_axis(np.concatenate((ids[active], add), 1), top, 1)
            now = np.take_along_axis(all_sim, top, 1)
            twice = ids[active][:, 1:] == ids[active][:, :-1]  # a node met twice in one step: equal, so side by side
            now[:, 1:][twice] = -2
            sims[active] = now
            done = np.concatenate((opened[active], np.zeros_like(add, bool)), 1)
            opened[active] = np.take_along_axis(done, top, 1) | (sims[active] <= -2)
        top = np.argsort(-sims, axis=1)
        ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
        return np.where(sims > -2, ids, -1), sims

    def _prune(self, cand: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Relaxed pruning: an edge to a candidate is left out if a kept neighbour is nearer to it, by the factor relax.

        Candidates come the most similar first; squared distances of unit vectors are 2 - 2 * similarity.
        """
        b, width = cand.shape
        valid = (cand >= 0) & (sims > -2)
        vectors = self.x[np.where(valid, cand, 0)]
        between = 2 - 2 * (vectors @ vectors.transpose(0, 2, 1))
        far = 2 - 2 * sims
        out = np.full((b, self.degree), -1, np.int32)
        size = np.zeros(b, np.int64)
        alive = valid.copy()
        for j in range(width):
            take = alive[:, j] & (size < self.degree)
            at = np.flatnonzero(take)
            if not len(at):
                continue
            out[at, size[at]] = cand[at, j]
            size[at] += 1
            alive[at] &= self.relax**2 * between[at, j, :] > far[at]
        # free places go to the nearest candidates that were left out
        for j in range(width):
            at = np.flatnonzero(valid[:, j] & (size < self.degree) & (size < self.degree // 2))
            at = at[~(out[at] == cand[at, j][:, None]).any(1)]
            out[at, size[at]] = cand[at, j]
            size[at] += 1
        return out

    def _insert(self, batch: np.ndarray) -> None:
        ids, sims = self.search(self.x[batch])
        inner = self.x[batch] @ self.x[batch].T  # members of one batch do not see each other in the graph
        np.fill_diagonal(inner, -2)
        m = min(8, len(batch) - 1)
        if m > 0:
            near = np.argpartition(-inner, m - 1, axis=1)[:, :m]
            ids = np.concatenate((ids, batch[near]), 1)
            sims = np.concatenate((sims, np.take_along_axis(inner, near, 1)), 1)
            order = np.argsort(-sims, axis=1)
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        edges = self._prune(ids, sims)
        self.edges[batch, : self.degree] = edges
        # the other direction
        source = np.repeat(batch, self.degree)
        target = edges.ravel()
        source, target = source[target >= 0], target[target >= 0]
        self._add_back(target, source)

    def _grouped(self, target: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((-s, target))
        nodes, counts = np.unique(target, return_counts=True)
        place = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
        return order, nodes, np.repeat(np.arange(len(nodes)), counts), place

    def _add_back(self, target: np.ndarray, source: np.ndarray) -> None:
        if not len(target):
            return
        s = np.einsum("ij,ij->i", self.x[target], self.x[source])
        order, nodes, row, place = self._grouped(target, s)
        keep = place < self.edges.shape[1]
        wide = int(place[keep].max()) + 1
        cand = np.full((len(nodes), wide), -1, np.int32)
        cand[row[keep], place[keep]] = source[order][keep]
        have = self.edges[nodes]
        free = (have < 0).sum(1)
        need = (cand >= 0).sum(1)
        fits = need <= free
        f = np.flatnonzero(fits)
        if len(f):  # edges are packed to the left
            at = (self.edges.shape[1] - free[f])[:, None] + np.arange(wide)[None, :]
            good = cand[f] >= 0
            rr, cc = np.nonzero(good)
            self.edges[nodes[f[rr]], at[rr, cc]] = cand[f[rr], cc]
        o = np.flatnonzero(~fits)
        if len(o):
            both = np.concatenate((have[o], cand[o]), 1)
            sims = np.einsum("ikj,ij->ik", self.x[np.maximum(both, 0)], self.x[nodes[o]])
            sims[both < 0] = -2
            by = np.argsort(-sims, axis=1)
            self.edges[nodes[o]] = -1
            self.edges[nodes[o], : self.degree] = self._prune(np.take_along_axis(both, by, 1), np.take_along_axis(sims, by, 1))
