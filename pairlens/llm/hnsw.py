"""Hierarchical navigable small-world graphs in numpy: many queries move through a graph in step.

Nodes are numbered by falling level, so the layers are prefixes of the node
numbers and every layer is one adjacency array.
"""

from __future__ import annotations

import io

import numpy as np

M, EF, EF_BUILD, EXPAND, LANES = 16, 32, 48, 4, 512
#: Nearest neighbours that an audit asks for, and the share of them that it wants.
NEIGHBOURS, NEAR_ENOUGH = 3, 0.95
#: Nodes that a search starts from; beam that a search for pairs starts with; pairs that an audit plants.
ENTRIES, REACH, PLANTED = 16, 8, 512
#: Share of planted pairs that an audit wants at least: no less than the neighbours' wider beam finds.
FOUND = 0.99
#: Nearest of its own neighbours that have an edge back to a node; edges that a node has for that, at most.
BACK, MORE = 4, 32


def _top(ids: np.ndarray, sims: np.ndarray, width: int, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(-sims, axis=1)[:, :width]
    return tuple(np.take_along_axis(x, order, 1) for x in (ids, sims, *more))


def _beam(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ef best nodes found for each query from its entry points (a row each, -1: none), best first; -1 where there are fewer."""
    q, n = len(queries), len(edges)
    rows = np.arange(q)[:, None]
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True  # stands for -1
    entry = np.where(entry < 0, n, entry)
    entry = np.sort(entry, axis=1)
    entry[:, 1:][entry[:, 1:] == entry[:, :-1]] = n
    seen[rows, entry] = True
    sims = np.where(entry < n, np.einsum("qd,qed->qe", queries, x[np.minimum(entry, n - 1)]), -2).astype(np.float32)
    ids = entry
    if ids.shape[1] < ef:
        pad = ef - ids.shape[1]
        ids, sims = np.pad(ids, ((0, 0), (0, pad)), constant_values=n), np.pad(sims, ((0, 0), (0, pad)), constant_values=-2)
    done = ids == n
    ids, sims, done = _top(ids, sims, ef, done)
    live = np.arange(q)
    while len(live):
        open_ = ~done[live]
        rank = np.cumsum(open_, axis=1)
        pick = open_ & (rank <= EXPAND)
        width = min(EXPAND, ef)
        at = np.argsort(~pick, axis=1, kind="stable")[:, :width]
        chosen = np.take_along_axis(pick, at, 1)
        nodes = np.where(chosen, np.take_along_axis(ids[live], at, 1), n)
        done[live] |= pick
        near = np.where(nodes[:, :, None] < n, edges[np.minimum(nodes, n - 1)], -1).reshape(len(live), -1)
        near = np.where(near < 0, n, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[live[:, None], near]] = n
        new = near < n
        seen[live[:, None], near] = True
        cap = int(new.sum(1).max()) if new.size else 0
        if cap:
            near = np.sort(near, axis=1)[:, :cap]
            s = np.where(near < n, np.einsum("qd,qed->qe", queries[live], x[np.minimum(near, n - 1)]), -2).astype(np.float32)
            ids[live], sims[live], done[live] = _top(np.concatenate([ids[live], near], 1), np.concatenate([sims[live], s], 1), ef, np.concatenate([done[live], near == n], 1))
        live = live[(~done[live]).any(1)]
    return np.where(ids < n, ids, -1), sims


def _select(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
    """Of the candidates of each row, best first, up to width that lead different ways: nearer to the row than to any kept before; then the best others."""
    rows, c = ids.shape
    v = x[np.maximum(ids, 0)]
    between = np.einsum("rid,rjd->rij", v, v)
    keep = np.zeros((rows, c), bool)
    there = ids >= 0
    for j in range(c):
        blocked = (keep[:, :j] & (between[:, j, :j] > sims[:, j : j + 1])).any(1) if j else np.zeros(rows, bool)
        keep[:, j] = there[:, j] & ~blocked & (keep[:, :j].sum(1) < width)
    order = np.argsort(np.where(keep, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :width]
    out = np.take_along_axis(ids, order, 1)
    if out.shape[1] < width:
        out = np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)
    return out


def _link_back(x: np.ndarray, edges: np.ndarray, new: np.ndarray, width: int) -> None:
    """Adds the new nodes to the lists of those that they point to, which are chosen anew where they are full."""
    src = np.repeat(new, edges.shape[1])
    dst = edges[new].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.lexsort((-np.einsum("id,id->i", x[src], x[dst]), dst))
    src, dst = src[order], dst[order]
    nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
    most = 2 * width
    for at in range(0, len(nodes), 2048):
        part, f, n = nodes[at : at + 2048], first[at : at + 2048], np.minimum(count[at : at + 2048], most)
        own = np.full((len(part), int(n.max())), -1, np.int64)
        r = np.repeat(np.arange(len(part)), n)
        k = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
        own[r, k] = src[f[r] + k]
        ids = np.concatenate([edges[part], own], 1)
        ids = -np.sort(-ids, axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        sims = np.where(ids >= 0, np.einsum("qd,qed->qe", x[part], x[np.maximum(ids, 0)]), -2)
        ids, sims = _top(ids, sims, ids.shape[1])
        full = (ids >= 0).sum(1) > width
        edges[part[~full]] = ids[~full][:, :width]
        if full.any():
            edges[part[full]] = _select(x, ids[full], sims[full], width)


class Graph:
    """x: unit vectors as float32, by falling level; layers: adjacency arrays, the lowest first; more: what else there is by node."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, layers: list[np.ndarray], ef: int = EF, reach: int = REACH, **more: np.ndarray):
        self.x, self.ids, self.layers, self.ef, self.reach, self.more = x, ids, layers, ef, reach, more

    def __getattr__(self, name: str) -> np.ndarray:
        if name != "more" and name in self.more:
            return self.more[name]
        raise AttributeError(name)

    @classmethod
    def build(cls, x: np.ndarray, ids: np.ndarray, seed: int = 5, **more: np.ndarray) -> Graph:
        level = np.floor(-np.log(1 - np.random.default_rng(seed).random(len(x))) / np.log(M)).astype(np.int64)
        order = np.argsort(-level, kind="stable")
        x, ids, level = np.ascontiguousarray(x[order], np.float32), ids[order], level[order]
        g = cls(x, ids, [], **{k: v[order] for k, v in more.items()})
        for l in range(int(level.max()) if len(x) else 0, -1, -1):
            g.layers.insert(0, g._layer(int((level >= l).sum()), M * (2 if l == 0 else 1)))
        if len(x):
            g._point_back()
        return g

    def _layer(self, n: int, width: int) -> np.ndarray:
        """A layer over the first n nodes; the layers so far lie above it."""
        x, edges = self.x, np.full((n, width), -1, np.int32)
        size = min(n, 64)
        if size > 1:
            s = x[:size] @ x[:size].T
            np.fill_diagonal(s, -3)
            near = np.argsort(-s, axis=1)[:, : size - 1]
            edges[:size] = _select(x, near, np.take_along_axis(s, near, 1), width)
            _link_back(x, edges[:size], np.arange(size), width)
        while size < n:
            new = np.arange(size, min(n, size + min(size, LANES)))
            entry = self._descend(x[new])
            entry = np.where(entry < size, entry, 0)
            near, sims = _beam(x[:size], edges[:size], x[new], entry, EF_BUILD)
            s = x[new] @ x[new].T
            np.fill_diagonal(s, -3)
            k = min(width, len(new) - 1)
            if k > 0:
                own = np.argsort(-s, axis=1)[:, :k]
                near, sims = _top(np.concatenate([near, new[own]], 1), np.concatenate([sims, np.take_along_axis(s, own, 1)], 1), EF_BUILD)
            edges[new] = _select(x, near, sims, width)
            size = int(new[-1]) + 1
            _link_back(x, edges, new, width)
        return edges

    def _point_back(self) -> None:
        """Edges of the lowest layer from the BACK nearest neighbours of each node to it, in columns of their own: among many near copies a full list drops nodes, and no search gets to them."""
        x, edges = self.x, self.layers[0]
        src, dst = [], []
        for at in range(0, len(x), 4096):
            part = edges[at : at + 4096]
            sims = np.where(part >= 0, np.einsum("qd,qed->qe", x[at : at + 4096], x[np.maximum(part, 0)]), -2)
            near = _top(part, sims, BACK)[0]
            node = np.repeat(np.arange(at, at + len(part)), near.shape[1])
            near = near.ravel()
            node, near = node[near >= 0], near[near >= 0]
            lost = ~(edges[near] == node[:, None]).any(1)
            src.append(near[lost])
            dst.append(node[lost])
        src, dst = np.concatenate(src), np.concatenate(dst)
        known = np.bincount(edges[edges >= 0], minlength=len(x))
        order = np.lexsort((known[dst], src))  # those that fewest edges lead to come first
        src, dst = src[order], dst[order]
        place = np.arange(len(src)) - np.searchsorted(src, src)
        src, dst, place = src[place < MORE], dst[place < MORE], place[place < MORE]
        if len(src):
            more = np.full((len(x), int(place.max()) + 1), -1, np.int32)
            more[src, place] = dst
            self.layers[0] = np.concatenate([edges, more], 1)

    def _descend(self, queries: np.ndarray, layers: list[np.ndarray] | None = None) -> np.ndarray:
        entry = np.zeros((len(queries), 1), np.int64)
        for edges in reversed(self.layers if layers is None else layers):
            entry = _beam(self.x[: len(edges)], edges, queries, entry, 2)[0]
        return entry

    def _entries(self, queries: np.ndarray) -> np.ndarray:
        """The nodes nearest to each query of the layer above the lowest, a sixteenth of all: looked at whole, as a descent ends in one place, often a wrong one."""
        if len(self.layers) < 2:
            return np.zeros((len(queries), 1), np.int64)
        s = queries @ self.x[: len(self.layers[1])].T
        most = min(ENTRIES, s.shape[1])
        return np.argpartition(-s, most - 1, axis=1)[:, :most]

    def search(self, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        return _beam(self.x, self.layers[0], queries, self._entries(queries), min(ef, len(self.x)))

    def within(self, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of the pairs found with a cosine of least or more.

        A beam full of such nodes is too narrow: those queries go again with
        twice the beam.  A node so near stands out, and the beam that the audit
        sets for pairs, reach, is narrower than that for neighbours.
        """
        rows, nodes = [], []
        for at in range(0, len(queries), LANES):
            todo, ef = np.arange(at, min(at + LANES, len(queries))), self.reach
            while len(todo):
                ids, sims = self.search(queries[todo], ef)
                hit = (sims >= least) & (ids >= 0)
                narrow = hit[:, -1] & (ids.shape[1] < len(self.x))
                r, c = np.nonzero(hit & ~narrow[:, None])
                rows.append(todo[r])
                nodes.append(ids[r, c])
                todo, ef = todo[narrow], ef * 2
        return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(nodes) if nodes else np.zeros(0, np.int64)

    def planted(self, least: float, n: int, seed: int = 7) -> np.ndarray:
        """Vectors a cosine of least from a node each, in random directions: the pairs that are hardest to find, in any shard."""
        rng = np.random.default_rng(seed)
        y = self.x[rng.integers(0, len(self.x), n)].astype(np.float64)
        z = rng.normal(size=y.shape)
        z -= (z * y).sum(1, keepdims=True) * y
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        y, z, norm = (v[norm[:, 0] > 1e-9] for v in (y, z, norm))  # one dimension has no such directions
        c = min(1.0, least + 1e-5)
        return (c * y + np.sqrt(1 - c * c) * z / norm).astype(np.float32)

    def audit(self, least: float, want: float, queries: np.ndarray, own: np.ndarray | None = None) -> tuple[float, float]:
        """Widens the beams until the search finds the share want of what brute force finds: pairs of least or more, of queries and of planted vectors; and NEAR_ENOUGH of the NEIGHBOURS nearest of queries.

        own: the ids of the queries; a query's pair with itself counts for nothing.  Returns both shares, of pairs the lesser.
        """
        n = len(self.x)
        if not n or not len(queries):
            return 1.0, 1.0
        q = queries.astype(np.float32)
        s = q @ self.x.T
        if own is not None:
            s[own[:, None] == self.ids[None, :]] = -3
        best = min(NEIGHBOURS, n)
        top = np.argpartition(-s, best - 1, axis=1)[:, :best]
        top = [t[v > -2] for t, v in zip(top, np.take_along_axis(s, top, 1), strict=True)]
        probes = self.planted(least, PLANTED)
        asked = [(v, {(int(i), int(j)) for i, j in zip(*np.nonzero(t >= least), strict=True)}, w) for v, t, w in ((q, s, want), (probes, probes @ self.x.T, max(want, FOUND)))]
        share = lambda v, truth: len(truth & {(int(i), int(j)) for i, j in zip(*self.within(v, least), strict=True)}) / len(truth) if truth else 1.0
        found = [share(v, t) for v, t, _ in asked]
        while any(f < w for f, (*_, w) in zip(found, asked, strict=True)) and self.reach < n:
            self.reach *= 2
            found = [share(v, t) for v, t, _ in asked]
        recall = min(found)
        while True:
            ids = np.concatenate([self.search(q[a : a + LANES], self.ef)[0] for a in range(0, len(q), LANES)])
            knn = float(np.mean([len(np.intersect1d(a, b)) / len(b) for a, b in zip(ids, top, strict=True) if len(b)] or [1.0]))
            if knn >= NEAR_ENOUGH or self.ef >= n:
                return recall, knn
            self.ef *= 2

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, x=self.x, ids=self.ids, ef=self.ef, reach=self.reach, **{f"m_{k}": v for k, v in self.more.items()}, **{f"l{i}": e for i, e in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Graph:
        z = np.load(io.BytesIO(data))
        layers = sum(k[0] == "l" for k in z.files)
        return cls(z["x"], z["ids"], [z[f"l{i}"] for i in range(layers)], int(z["ef"]), int(z["reach"]), **{k[2:]: z[k] for k in z.files if k.startswith("m_")})
