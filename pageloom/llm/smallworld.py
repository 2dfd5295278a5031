"""A navigable small-world graph over 256-bit signatures under Hamming distance.

Links come from sorted passes. A pass orders the nodes by some of their bits, drawn anew each time, and
compares every node with those that stand near it in that order. A node keeps its nearest finds as short links, the
nearest finds outside its own group as further ones, and a few random nodes as long links. The number of
passes follows from the number of nodes: so many that a lone pair at the radius stands side by side in one
of them with probability ``FOUND``. The cost of a pass doesn't depend on how the nodes lie: a crowd of
near-equal signatures takes no longer than as many strangers.

A search starts at a query's links, keeps a beam of the nearest nodes seen, expands those within ``reach``
(what is farther can't lead to a near copy), and unites the query with every node within the radius that
it comes by. Beams expand while they are full of hits and bring new ones.
"""

from __future__ import annotations

import math

import numpy as np

WINDOW, WIDTH, OUTSIDE, LONG, BEAM, STEP = 16, 8, 4, 2, 16, 4
FOUND = 0.95
_NONE = 1 << 10
_FAR = np.int64(1 << 20)
_VISITS = 1 << 26


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def agreeing(bits: int, distance: int) -> float:
    """The probability that none of the drawn bits is one in which two signatures at this distance differ."""
    return math.prod(max(0, 256 - distance - i) / (256 - i) for i in range(bits))


def pass_count(n: int, radius: int) -> int:
    """Passes after which a lone pair at the radius has stood within ``WINDOW`` places with probability FOUND.

    Nodes that agree in the first k drawn bits and differ in the next stand about n / 2^(k+1) places apart.
    """
    k = max(0, math.ceil(math.log2(max(n, 1) / (2 * WINDOW))))
    beside = agreeing(k, radius)
    return 1 if beside == 1 else math.ceil(math.log(1 - FOUND) / math.log(1 - beside))


def places(sig: np.ndarray, picks: list[np.ndarray]) -> list[np.ndarray]:
    """For each draw of at most 64 bits: those bits of each signature as one number, the first foremost."""
    planes = _planes(sig)
    return [_packed(planes, p) for p in picks]


def _planes(sig: np.ndarray) -> np.ndarray:
    """(256, n): the bits of all signatures."""
    return np.ascontiguousarray(np.unpackbits(np.ascontiguousarray(sig).view(np.uint8), axis=1, bitorder="little").T)


def _packed(planes: np.ndarray, picks: np.ndarray) -> np.ndarray:
    out = np.zeros(planes.shape[1], np.uint64)
    for k in range(0, len(picks), 8):
        byte = np.zeros(planes.shape[1], np.uint8)
        for p in picks[k : k + 8]:
            byte += byte
            byte |= planes[p]
        out = (out << np.uint64(min(8, len(picks) - k))) | byte
    return out


class Groups:
    """Union-find over 0..n-1 whose root is the least member; ``up`` always names the roots."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.up[a], self.up[b]
            hi, lo = np.maximum(a, b), np.minimum(a, b)
            move = hi != lo
            a, b, hi, lo = a[move], b[move], hi[move], lo[move]
            if len(a):
                np.minimum.at(self.up, hi, lo)
                while not np.array_equal(up := self.up[self.up], self.up):
                    self.up = up

    def roots(self, x: np.ndarray) -> np.ndarray:
        return self.up[x]

    def all(self) -> np.ndarray:
        return self.up


class Graph:
    """The graph over ``sig`` (n, 4) and the groups of nodes within ``radius`` found so far."""

    def __init__(self, sig: np.ndarray, radius: int, seed: int = 7) -> None:
        self.sig, self.n, self.radius, self.reach = sig, len(sig), radius, radius * 3 // 2
        self.groups = Groups(self.n)
        rng = np.random.default_rng(seed)
        self.near = np.full((self.n, WIDTH), -1, np.int32), np.full((self.n, WIDTH), _NONE, np.int16)
        self.outside = np.full((self.n, OUTSIDE), -1, np.int32), np.full((self.n, OUTSIDE), _NONE, np.int16)
        self.long = rng.integers(0, max(self.n, 1), (self.n, LONG)).astype(np.int32)
        planes = _planes(sig)
        for _ in range(pass_count(self.n, radius)):
            self._pass(_packed(planes, rng.permutation(256)[:32]))

    def _pass(self, place: np.ndarray) -> None:
        order = (np.sort((place << np.uint64(32)) | np.arange(self.n, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        s = np.ascontiguousarray(self.sig[order].T)
        close: list[tuple[np.ndarray, np.ndarray]] = []
        for w in range(1, min(WINDOW, self.n - 1) + 1):
            d = np.bitwise_count(s[0, w:] ^ s[0, :-w])
            for k in (1, 2, 3):
                d += np.bitwise_count(s[k, w:] ^ s[k, :-w])  # 256 wraps to 0 and is measured again below
            at = np.flatnonzero(d <= self.reach)
            if len(at):
                close.append((order[at], order[at + w]))
        if close:
            self._take(np.concatenate([c[0] for c in close]), np.concatenate([c[1] for c in close]))

    def _take(self, i: np.ndarray, j: np.ndarray) -> None:
        """Unite the pairs within the radius and keep the nearest as links, both ways."""
        d = hamming(self.sig[i], self.sig[j])
        hit = d <= self.radius
        self.groups.union(i[hit], j[hit])
        i, j, d = np.r_[i, j], np.r_[j, i], np.r_[d, d]
        ok = d <= self.reach
        i, j, d = i[ok], j[ok], d[ok]
        _nearest(*self.near, i, j, d)
        apart = (d > self.radius) & (self.groups.roots(i) != self.groups.roots(j))
        _nearest(*self.outside, i[apart], j[apart], d[apart])

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether the beam of each query filled with hits, and whether any came from outside its group."""
        block = min(len(q), max(1, _VISITS // self.n))
        seen = np.zeros((block, self.n), bool)
        parts = [self._lockstep(q[i : i + block], beam, seen) for i in range(0, len(q), block)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _lockstep(self, q: np.ndarray, beam: int, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = len(q)
        seen[np.arange(m), q] = True
        been, found = [(np.arange(m), q)], []
        grew = np.zeros(m, bool)
        # a beam entry packs distance, expanded flag and node: sorting the integers sorts the beam
        heap = np.full((m, beam), _FAR << 33, np.int64)
        live, cand = np.arange(m), self._links(q[:, None])
        while len(live):
            cand = np.sort(cand, axis=1)
            fresh = cand >= 0
            fresh[:, 1:] &= cand[:, 1:] != cand[:, :-1]
            safe = np.maximum(cand, 0)
            fresh &= ~seen[live[:, None], safe]
            r, c = np.nonzero(fresh)
            node = cand[r, c].astype(np.int64)
            seen[live[r], node] = True
            been.append((live[r], node))
            d = hamming(self.sig[node], self.sig[q[live[r]]])
            hit = np.flatnonzero(d <= self.radius)
            hit = hit[self.groups.roots(q[live[r[hit]]]) != self.groups.roots(node[hit])]
            grew[live[r[hit]]] = True
            found.append((q[live[r[hit]]], node[hit]))
            more = np.full(cand.shape, _FAR << 33, np.int64)
            more[r, c] = (d << 33) | node
            top = np.sort(np.concatenate([heap[live], more], axis=1), axis=1)[:, :beam]
            open_ = ((top >> 32) & 1 == 0) & (top >> 33 <= self.reach)
            turn = open_ & (np.cumsum(open_, axis=1) <= STEP)
            heap[live] = np.where(turn, top | (1 << 32), top)
            pick = np.sort(np.where(turn, top & 0xFFFFFFFF, -1), axis=1)[:, -STEP:]
            some = (pick >= 0).any(1)
            live, pick = live[some], pick[some]
            cand = self._links(pick)
        self.groups.union(*(np.concatenate(x) for x in zip(*found)))
        for r, node in been:  # the next block begins with none seen
            seen[r, node] = False
        return heap.max(axis=1) >> 33 <= self.radius, grew

    def _links(self, nodes: np.ndarray) -> np.ndarray:
        to = np.concatenate([self.near[0][nodes], self.outside[0][nodes], self.long[nodes]], axis=2)
        to[nodes < 0] = -1
        return to.reshape(len(nodes), to.shape[1] * to.shape[2])


def _nearest(link: np.ndarray, far: np.ndarray, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
    """Bring the links (i, j) at distance d into the tables of each node's nearest."""
    better = d < far[i, -1]
    i, j, d = i[better], j[better], d[better]
    if not len(i):
        return
    width = link.shape[1]
    rows = np.unique(i)
    r, c = np.nonzero(link[rows] >= 0)
    i, j, d = np.r_[i, rows[r]], np.r_[j, link[rows[r], c]], np.r_[d, far[rows[r], c]]
    o = np.lexsort((j, d, i))
    i, j, d = i[o], j[o], d[o]
    once = np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
    i, j, d = i[once], j[once], d[once]
    at = np.arange(len(i))
    rank = at - np.maximum.accumulate(np.where(np.r_[True, i[1:] != i[:-1]], at, 0))
    keep = rank < width
    link[i[keep], rank[keep]], far[i[keep], rank[keep]] = j[keep], d[keep]


def neighbours(sig: np.ndarray, radius: int, seed: int = 7) -> Groups:
    """Groups of the nodes within ``radius`` of each other, every node being a query.

    What the passes found is united at once. A node with a link that leads out of its group may have near
    copies there that stood beside it in no pass, so it searches the graph.
    """
    if len(sig) < 2:
        return Groups(len(sig))
    graph = Graph(sig, radius, seed)
    groups = graph.groups
    r, c = np.nonzero(graph.outside[0] >= 0)
    out = groups.roots(r) != groups.roots(graph.outside[0][r, c])
    q, beam = np.unique(r[out]), BEAM
    while len(q):
        full, grew = graph.search(q, min(beam, graph.n))
        q, beam = q[full & grew], beam * 2
    return groups


def exact_pairs(sig: np.ndarray, radius: int) -> np.ndarray:
    """All pairs i < j within the radius, by comparing every two; what recall is audited against."""
    out = []
    for i in range(len(sig)):
        j = np.flatnonzero(hamming(sig[i], sig[i + 1 :]) <= radius) + i + 1
        out.append(np.stack([np.full(len(j), i), j], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)
