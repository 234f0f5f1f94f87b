"""A navigable small-world graph over unit vectors, built and searched for many vectors at a time in numpy.

Layers hold ever fewer nodes. Neighbours are chosen for spread: a candidate is linked if it is closer to the
new node than to any neighbour taken so far; places left over go to the closest of the others. Searches
keep a beam of the ``ef`` closest nodes seen and expand its open ones until none is left.
"""

from __future__ import annotations

import pickle

import numpy as np

LINKS, BUILD_BEAM, BATCH = 12, 48, 256


class Graph:
    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        n = len(vectors)
        rng = np.random.default_rng(11)
        self.level = np.minimum((-np.log(rng.random(n) + 1e-12) / np.log(LINKS)).astype(np.int64), 6)
        self.links: list[np.ndarray] = []
        self.orphans = np.zeros(0, np.int64)

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        g = cls(vectors)
        n = len(vectors)
        if n == 0:
            return g
        g.level[0] = g.level.max()
        g.links = [np.full((n, LINKS * (2 if lv == 0 else 1)), -1, np.int32) for lv in range(int(g.level.max()) + 1)]
        at = 1
        while at < n:
            new = np.arange(at, min(n, at + min(BATCH, at)))
            g._insert(new)
            at = int(new[-1]) + 1
        # Nodes that few others point to and that even a search for themselves misses are kept aside, for direct comparison.
        rare = np.flatnonzero(np.bincount(g.links[0][g.links[0] >= 0], minlength=n) <= 3)
        missed = [rare[~(g.beam(vectors[rare], g._enter(vectors[rare]), BUILD_BEAM, 0)[0] == rare[:, None]).any(1)] for rare in np.array_split(rare, max(1, len(rare) // BATCH))]
        g.orphans = np.concatenate(missed)
        return g

    def _enter(self, q: np.ndarray) -> np.ndarray:
        start = np.zeros((len(q), 1), np.int64)
        for lv in range(len(self.links) - 1, 0, -1):
            start = self.beam(q, start, 8, lv)[0]
        return start

    def dumps(self) -> bytes:
        """All but the vectors, which are stored once, as given."""
        return pickle.dumps((self.level, self.links, self.orphans), 5)

    @classmethod
    def loads(cls, raw: bytes, vectors: np.ndarray) -> Graph:
        g = cls.__new__(cls)
        g.vectors = vectors
        g.level, g.links, g.orphans = pickle.loads(raw)
        return g

    def _spread(self, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """For each row of candidates (best first, -1: none) the ones to link, padded with -1."""
        rows, width = ids.shape
        v = self.vectors[np.maximum(ids, 0)]
        among = np.einsum("rad,rbd->rab", v, v)
        taken = np.zeros((rows, width), bool)
        count = np.zeros(rows, np.int64)
        for c in range(width):
            near = np.where(taken, among[:, c, :], -np.inf).max(axis=1)
            ok = (ids[:, c] >= 0) & (sims[:, c] > near) & (count < most)
            taken[:, c] = ok
            count += ok
        order = np.argsort(~taken * 2 + (ids < 0), axis=1, kind="stable")[:, :most]
        return np.take_along_axis(ids, order, 1)

    def _insert(self, new: np.ndarray) -> None:
        q = self.vectors[new]
        start = np.zeros((len(new), 1), np.int64)
        peers = q @ q.T
        np.fill_diagonal(peers, -np.inf)
        for lv in range(len(self.links) - 1, -1, -1):
            ids, sims = self.beam(q, start, BUILD_BEAM if lv == 0 else BUILD_BEAM // 2, lv)
            start = ids[:, : max(1, BUILD_BEAM // 8)]
            here = np.flatnonzero(self.level[new] >= lv)
            if not len(here):
                continue
            k = min(len(here), BUILD_BEAM // 2)
            p = peers[np.ix_(here, here)]
            top = np.argpartition(-p, k - 1, axis=1)[:, :k]
            psims = np.take_along_axis(p, top, 1)
            pids = np.where(np.isfinite(psims), new[here][top], -1)
            allids, allsims = np.concatenate([ids[here], pids], 1), np.concatenate([sims[here], psims], 1)
            order = np.argsort(-allsims, axis=1, kind="stable")[:, :BUILD_BEAM]
            allids, allsims = np.take_along_axis(allids, order, 1), np.take_along_axis(allsims, order, 1)
            chosen = self._spread(q[here], allids, allsims, LINKS)
            self.links[lv][new[here], : chosen.shape[1]] = chosen
            src, dst = np.repeat(new[here], chosen.shape[1]), chosen.ravel()
            self._back(lv, src[dst >= 0], dst[dst >= 0])

    def _back(self, lv: int, src: np.ndarray, dst: np.ndarray) -> None:
        """Links dst -> src, pruned where a node has too many."""
        links = self.links[lv]
        most = links.shape[1]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
        for lo in range(0, len(nodes), 512):
            v, f, c = nodes[lo : lo + 512], first[lo : lo + 512], count[lo : lo + 512]
            width = int(c.max())
            col = np.arange(width)
            more = np.where(col < c[:, None], src[np.minimum(f[:, None] + col, len(src) - 1)], -1)
            ids = np.concatenate([links[v], more], 1)
            ids = np.sort(ids, axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            ids[ids == v[:, None]] = -1
            sims = np.where(ids >= 0, np.einsum("rad,rd->ra", self.vectors[np.maximum(ids, 0)], self.vectors[v]), -np.inf)
            best = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * most]
            ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            full = (ids >= 0).sum(1) > most
            out = np.full((len(v), most), -1, np.int32)
            w = min(most, ids.shape[1])
            out[:, :w] = ids[:, :w]
            if full.any():
                got = self._spread(self.vectors[v[full]], ids[full], sims[full], most)
                out[full, : got.shape[1]] = got
            links[v] = out

    def beam(self, q: np.ndarray, start: np.ndarray, ef: int, lv: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the beam of each query, best first; -1 and -inf where it has fewer."""
        vec, links, n, rows = self.vectors, self.links[lv], len(self.vectors), len(q)
        ids = np.full((rows, ef), -1, np.int64)
        sims = np.full((rows, ef), -np.inf, np.float32)
        done = np.ones((rows, ef), bool)
        seen = np.zeros((rows, n), bool)
        s = np.sort(start[:, :ef], axis=1)
        s[:, 1:][s[:, 1:] == s[:, :-1]] = -1
        w = s.shape[1]
        ids[:, :w] = s
        sims[:, :w] = np.where(s >= 0, np.einsum("rad,rd->ra", vec[np.maximum(s, 0)], q), -np.inf)
        done[:, :w] = s < 0
        r, c = np.nonzero(s >= 0)
        seen[r, s[r, c]] = True
        active = np.arange(rows)
        while len(active):
            score = np.where(done[active], -np.inf, sims[active])
            pick = np.argpartition(-score, min(step, ef) - 1, axis=1)[:, :step]
            good = np.isfinite(np.take_along_axis(score, pick, 1))
            some = good.any(1)
            active, pick, good = active[some], pick[some], good[some]
            if not len(active):
                break
            node = np.where(good, ids[active[:, None], pick], -1)
            done[active[:, None], pick] = True
            nb = np.where(node[:, :, None] >= 0, links[np.maximum(node, 0)], -1).reshape(len(active), -1).astype(np.int64)
            nb.sort(axis=1)
            nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = -1
            fresh = (nb >= 0) & ~seen[active[:, None], np.maximum(nb, 0)]
            r, c = np.nonzero(fresh)
            if not len(r):
                continue
            seen[active[r], nb[r, c]] = True
            got = np.full(nb.shape, -np.inf, np.float32)
            got[r, c] = np.einsum("ad,ad->a", vec[nb[r, c]], q[active[r]])
            allsims = np.concatenate([sims[active], got], 1)
            allids = np.concatenate([ids[active], np.where(fresh, nb, -1)], 1)
            alldone = np.concatenate([done[active], ~fresh], 1)
            top = np.argpartition(-allsims, ef - 1, axis=1)[:, :ef]
            ids[active], sims[active], done[active] = (np.take_along_axis(x, top, 1) for x in (allids, allsims, alldone))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def within(self, q: np.ndarray, least: float, ef: int, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, similarity) of nodes found at ``least`` or more.

        From a query's beam on, every node within ``margin`` below ``least`` is expanded, so that a query with
        thousands of links costs as much as it has links, whatever the beam holds.
        """
        out = []
        n, links = len(self.vectors), self.links[0]
        per = max(1, min(BATCH, (64 << 20) // max(1, n)))
        for lo in range(0, len(q), per):
            part = q[lo : lo + per]
            ids, sims = self.beam(part, self._enter(part), min(ef, n), 0)
            r, c = np.nonzero(ids >= 0)
            row, node, sim = r, ids[r, c], sims[r, c]
            seen = np.zeros((len(part), n), bool)
            seen[row, node] = True
            while len(row):
                near = sim >= least - margin
                row, node, sim = row[near], node[near], sim[near]
                hit = (sim >= least) & ~np.isin(node, self.orphans)
                out.append((row[hit] + lo, node[hit], sim[hit]))
                found = []
                for k in range(0, len(row), 1 << 13):
                    a, b = np.repeat(row[k : k + (1 << 13)], links.shape[1]), links[node[k : k + (1 << 13)]].ravel().astype(np.int64)
                    new = b >= 0
                    a, b = a[new], b[new]
                    new = ~seen[a, b]
                    key = np.unique(a[new] * n + b[new])
                    a, b = key // n, key % n
                    seen[a, b] = True
                    found.append((a, b, np.einsum("ad,ad->a", self.vectors[b], part[a])))
                row, node, sim = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (row[:0], node[:0], sim[:0])
        for lo in range(0, len(q), BATCH):
            sims = q[lo : lo + BATCH] @ self.vectors[self.orphans].T
            r, c = np.nonzero(sims >= least)
            out.append((r + lo, self.orphans[c], sims[r, c]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
