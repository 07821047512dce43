"""Navigable small-world graph over Hamming distance, for many queries at once.

Nodes are signatures of 256 bits, inserted in batches: each is linked with the ``LINKS`` nearest nodes that a beam
search finds among those before it, in both directions, and keeps the ``DEGREE`` nearest of its links. A search starts
from all nodes that share an entry with the query in one of several tables - in this space distances hardly differ but
for near copies, so a walk from afar has no slope to follow - and walks on over links, the best of its beam first. While
a beam is full of hits, it is expanded: all nodes in reach over hits are then looked at, however many there are.

The tables are samples of bits, as many as it takes for a pair that differs in ``FAR`` of its bits to share one with
``MEET``; or the columns of ``entries`` (a row a node, ``EMPTY`` for none), of which near copies have a share of at least
``alike`` in common. A query then needs to look into that many of its own only that one in common must be among them: it
takes those of the fewest nodes, and no pair is lost. If its tables hold as many as there are nodes, it looks at all.
"""

from __future__ import annotations

import numpy as np

BITS, LINKS, DEGREE, BEAM, STEP = 256, 8, 16, 16, 2
FAR, MEET, EMPTY = 0.3, 0.95, 0xFFFF
NONE = np.int64(1 << 62)
CHUNK = 1024
#: Distances that are computed at once.
PAIRS = 1 << 20


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distance over the last axis, of four words."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def sampled(sig: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """(n, samples): the bits at each row of picks as a number."""
    bits = np.unpackbits(np.ascontiguousarray(sig).view(np.uint8).reshape(len(sig), 32), axis=1, bitorder="little")
    out = np.zeros((len(sig), len(picks)), np.int64)
    for j in range(picks.shape[1]):
        out |= bits[:, picks[:, j]].astype(np.int64) << j
    return out


def _best(keys: np.ndarray, n: int) -> np.ndarray:
    """The n smallest distinct entries of each row. An entry is distance << 33 | node << 1 | (1 if not yet expanded)."""
    keys = np.sort(keys, 1)
    same = (keys[:, 1:] >> 1) == (keys[:, :-1] >> 1)
    if same.any():
        keys[:, 1:][same] = NONE
        keys = np.sort(keys, 1)
    if keys.shape[1] < n:
        keys = np.pad(keys, ((0, 0), (0, n - keys.shape[1])), constant_values=NONE)
    return keys[:, :n].copy()


class Graph:
    def __init__(self, sig: np.ndarray, seed: int = 5, entries: np.ndarray | None = None, alike: float = 0.5):
        self.sig, n = sig, len(sig)
        self.looked = np.ones((n, 0), bool)
        if entries is None:
            width = int(np.clip(np.log2(max(n, 2)) - 3, 4, 20))
            share = (1 - FAR) ** width
            rng = np.random.default_rng([seed, n])
            picks = np.stack([rng.choice(BITS, width, replace=False) for _ in range(int(np.ceil(np.log(1 - MEET) / np.log(1 - share))))])
            entries = sampled(sig, picks)
            used = np.ones(entries.shape, bool)
            need = np.full(n, entries.shape[1])
        else:
            used = entries != EMPTY
            own = used.sum(1)
            need = own - np.ceil(own * alike - 1e-9).astype(np.int64) + 1
        entries = entries.astype(np.int32)
        self.order = np.argsort(entries, 0, kind="stable").astype(np.int32)
        self.low, self.high = np.empty(entries.shape, np.int32), np.empty(entries.shape, np.int32)
        for t in range(entries.shape[1]):
            keys = entries[self.order[:, t], t]
            self.low[:, t], self.high[:, t] = np.searchsorted(keys, entries[:, t], "left"), np.searchsorted(keys, entries[:, t], "right")
        # the entries that a node looks into: those of the fewest nodes
        size = np.where(used, self.high - self.low, n + 1)
        rank = np.argsort(np.argsort(size, 1, kind="stable"), 1, kind="stable")
        self.looked = used & (rank < need[:, None])
        self.links = np.full((n, DEGREE), -1, np.int64)
        self.far = np.full((n, DEGREE), 1 << 20, np.int64)
        at = 0
        while at < n:
            to = min(n, at + min(max(at, 256), 4096))
            for a in range(at, to, CHUNK):
                b = min(to, a + CHUNK)
                # of the first batch all pairs with nodes before it; later ones search
                found = self._all(np.arange(a, b), b) if at == 0 else _best(self._search(np.arange(a, b), at, 2, -1)[0], LINKS)
                self._link(np.arange(a, b), found[:, :LINKS])
            at = to
        # who links to each node: a link that its other end has dropped for nearer ones still leads back
        to_, by = self.links.ravel(), np.repeat(np.arange(n), DEGREE)
        order = np.argsort(to_, kind="stable")
        self.back = by[order]
        self.back_at = np.searchsorted(to_[order], np.arange(n + 1))

    def _all(self, nodes: np.ndarray, n: int) -> np.ndarray:
        d = distance(self.sig[nodes][:, None], self.sig[None, :n])
        key = (d << 33) | (np.arange(n)[None] << 1)
        key[np.arange(n)[None] >= nodes[:, None]] = NONE
        return _best(key, LINKS)

    def _link(self, nodes: np.ndarray, found: np.ndarray) -> None:
        ok = found < NONE
        x = np.repeat(nodes, ok.sum(1))
        y, d = (found[ok] >> 1) & 0xFFFFFFFF, found[ok] >> 33
        a, b, d = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([d, d])
        own = np.unique(a)
        a = np.concatenate([a, np.repeat(own, DEGREE)])
        b, d = np.concatenate([b, self.links[own].ravel()]), np.concatenate([d, self.far[own].ravel()])
        o = np.lexsort((b, d, a))
        a, b, d = a[o], b[o], d[o]
        first = np.searchsorted(a, own)
        rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
        keep = (rank < DEGREE) & (b >= 0)
        self.links[own], self.far[own] = -1, 1 << 20
        self.links[a[keep], rank[keep]], self.far[a[keep], rank[keep]] = b[keep], d[keep]

    def _seeds(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in nodes, node), sorted and distinct, of those that share an entry that is looked into."""
        n = len(self.sig)
        size = np.where(self.looked[nodes], self.high[nodes] - self.low[nodes], 0).astype(np.int64)
        whole = size.sum(1) >= n
        size[whole] = 0
        q, t = np.nonzero(size)
        each = size[q, t]
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(self.low[nodes[q], t], each)
        pairs = np.repeat(q, each) * n + self.order[at, np.repeat(t, each)]
        pairs = np.sort(np.concatenate([pairs, (np.flatnonzero(whole)[:, None] * n + np.arange(n)).ravel()]))
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
        return np.divmod(pairs, n)

    def _started(self, nodes: np.ndarray, below: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Beams of the nearest seeds, and all pairs (place, node) of seeds within the radius."""
        beam, left, right = np.full((len(nodes), BEAM), NONE, np.int64), [], []
        total = np.minimum(np.where(self.looked[nodes], self.high[nodes] - self.low[nodes], 0).sum(1, dtype=np.int64), len(self.sig))
        part = (np.cumsum(total) - total) // PAIRS
        for p in np.unique(part).tolist():
            own = np.flatnonzero(part == p)
            x, y = self._seeds(nodes[own])
            d = distance(self.sig[nodes[own[x]]], self.sig[y])
            hit = d <= radius
            left.append(own[x[hit]])
            right.append(y[hit])
            old = y < below
            key = np.sort((x[old] << 43) | (d[old] << 33) | (y[old] << 1) | 1)
            x, key = key >> 43, key & ((1 << 43) - 1)
            rank = np.arange(len(x)) - np.searchsorted(x, x)
            beam[own[x[rank < BEAM]], rank[rank < BEAM]] = key[rank < BEAM]
        return beam, np.concatenate(left), np.concatenate(right)

    def _keys(self, query: np.ndarray, nodes: np.ndarray, below: int) -> np.ndarray:
        d = distance(self.sig[nodes], query[:, None])
        return np.where((nodes >= 0) & (nodes < below), (d << 33) | (nodes << 1) | 1, NONE)

    def _search(self, asked: np.ndarray, below: int, rounds: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Beams of nodes asked for, among nodes below a number: rounds of expansion, and more while hits are unexpanded.

        Also the pairs (place in asked, node) of all seeds within the radius.
        """
        query = self.sig[asked]
        beam, left, right = self._started(asked, below, radius)
        live, i = np.arange(len(query)), 0
        while len(live):
            own = beam[live]
            todo = (own & 1).astype(bool) & (own < NONE)
            near = todo & ((own >> 33) <= radius)
            go = near.any(1) | (todo.any(1) & (i < rounds))
            live, own, todo = live[go], own[go], todo[go]
            if not len(live):
                break
            pick = np.argsort(~todo, 1, kind="stable")[:, :STEP]
            chosen = np.take_along_axis(own, pick, 1)
            ok = np.take_along_axis(todo, pick, 1)
            nodes = np.where(ok, (chosen >> 1) & 0xFFFFFFFF, 0)
            np.put_along_axis(own, pick, np.where(ok, chosen & ~np.int64(1), chosen), 1)
            more = np.where(ok[:, :, None], self.links[nodes], -1).reshape(len(live), -1)
            beam[live] = _best(np.concatenate([own, self._keys(query[live], more, below)], 1), BEAM)
            i += 1
        return beam, left, right

    def within(self, query: np.ndarray, radius: int, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) found at most radius apart; the queries are the nodes."""
        assert len(query) == len(self.sig)
        return self.near(0, len(query), radius, rounds)

    def near(self, start: int, end: int, radius: int, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (node, node) found at most radius apart, of the nodes from start to end with any."""
        left, right = [], []
        n = len(self.sig)
        for a in range(start, min(end, n), CHUNK):
            asked = np.arange(a, min(end, n, a + CHUNK))
            part = self.sig[asked]
            beam, x, y = self._search(asked, n, rounds, radius)
            left.append(x + a)
            right.append(y)
            hit = (beam >> 33) <= radius
            full = hit.all(1)
            row, col = np.nonzero(hit & ~full[:, None])
            left.append(row + a)
            right.append((beam[row, col] >> 1) & 0xFFFFFFFF)
            for q in np.flatnonzero(full).tolist():
                got = self._reach(part[q], (beam[q] >> 1) & 0xFFFFFFFF, radius)
                left.append(np.full(len(got), a + q))
                right.append(got)
        if not left:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pairs = np.unique(np.concatenate(left) * n + np.concatenate(right))
        return pairs // n, pairs % n

    def _reach(self, query: np.ndarray, nodes: np.ndarray, radius: int) -> np.ndarray:
        """All hits in reach from hits over hits."""
        seen, out = np.zeros(len(self.sig), bool), [nodes]
        seen[nodes] = True
        while len(nodes):
            near = np.concatenate([self.links[nodes].ravel(), *(self.back[self.back_at[i] : self.back_at[i + 1]] for i in nodes.tolist())])
            near = near[near >= 0]
            near = np.unique(near[~seen[near]])
            seen[near] = True
            nodes = near[distance(self.sig[near], query) <= radius]
            out.append(nodes)
        return np.concatenate(out)
