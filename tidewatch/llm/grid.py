"""Last tokens of every prefix of many pieces, filled side by side with array operations."""

from __future__ import annotations

import numpy as np

from tidewatch.llm.bpe import NONE, Merges

_MULT = np.int64(-0x61C8864680B583EB)  # odd; products wrap


class Table:
    """A fixed map from non-negative 64-bit keys to 32-bit values, -1 for other keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.power = max(4, int(keys.size * 3).bit_length())
        self.keys, self.values = np.full(1 << self.power, -1, np.int64), np.full(1 << self.power, -1, np.int32)
        slot, todo = self._slot(keys), np.arange(keys.size)
        while todo.size:
            put = todo[self.keys[slot[todo]] < 0]
            self.keys[slot[put]] = keys[put]  # of several for one slot, the last stays
            won = self.keys[slot[todo]] == keys[todo]
            self.values[slot[todo[won]]] = values[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & ((1 << self.power) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT) >> (64 - self.power)) & ((1 << self.power) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        held = self.keys[slot]
        far = np.flatnonzero((held != keys) & (held >= 0))
        while far.size:
            slot[far] = (slot[far] + 1) & ((1 << self.power) - 1)
            held[far] = self.keys[slot[far]]
            far = far[(held[far] != keys[far]) & (held[far] >= 0)]
        return np.where(held == keys, self.values[slot], -1)


class Grid:
    """The tables of a byte vocabulary as arrays."""

    def __init__(self, machine: Merges):
        number, nodes, edges, pairs = machine.number, {b"": 0}, {}, {}
        for x, i in number.items():
            for k in range(1, len(x)):
                a, b = number.get(x[:k]), number.get(x[k:])
                if a is not None and b is not None:
                    pairs[a << 22 | b] = i
            for k in range(len(x)):
                at = nodes[x[:k]]
                to = nodes.setdefault(x[: k + 1], len(nodes))
                edges[at << 8 | x[k]] = to
        self.child = Table(np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int32, len(edges)))
        self.joined = Table(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        self.ends = np.array([number.get(x, NONE) for x in nodes], np.int32)
        self.open = np.zeros(len(nodes), bool)
        self.open[np.fromiter(edges, np.int64, len(edges)) >> 8] = True
        self.rank, self.left, self.right = (np.array(x, np.int32) for x in (machine.rank, machine.left, machine.right))
        self.size = np.array([len(x) for x in machine.text], np.int32)

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`Merges.fits` of many pairs."""
        ok = np.ones(a.size, bool)
        todo, before = np.arange(a.size), np.full(a.size, np.iinfo(np.int32).max, np.int32)
        while todo.size:
            t = self.joined.get(a.astype(np.int64) << 22 | b)
            bad = (t >= 0) & (self.rank[t] < before)
            ok[todo[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & (np.maximum(ra, rb) >= 0)
            todo, a, b, ra, rb = todo[go], a[go], b[go], ra[go], rb[go]
            first = ra > rb
            before = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    def last_tokens(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``pieces``: none empty, longest first.  Their lengths, and the last token of each prefix (by piece and length)."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(sizes[0])
        data = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(-1, width)
        last = np.full((len(pieces), width + 1), NONE, np.int32)
        piece, start, node = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        for j in range(width):
            m = int(np.searchsorted(-sizes, -j, side="left"))  # pieces longer than j
            on = piece < m
            piece = np.concatenate([piece[on], np.arange(m, dtype=np.int32)])
            start = np.concatenate([start[on], np.full(m, j, np.int32)])
            node = np.concatenate([node[on], np.zeros(m, np.int32)])
            node = self.child.get(node.astype(np.int64) << 8 | data[piece, j])
            on = node >= 0
            piece, start, node = piece[on], start[on], node[on]
            token = self.ends[node]
            at = np.flatnonzero(token >= 0)
            before = last[piece[at], start[at]]
            ok = before == NONE
            rest = np.flatnonzero(~ok)
            ok[rest] = self.fits(before[rest], token[at[rest]])
            last[piece[at[ok]], j + 1] = token[at[ok]]
            on = self.open[node]
            piece, start, node = piece[on], start[on], node[on]
        return sizes, last

    def tokens(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces (longest first) one after the other, and where each piece's begin, with the end."""
        sizes, last = self.last_tokens(pieces)
        who, at = np.arange(len(pieces)), sizes.copy()
        by, found = [], []
        while who.size:
            t = last[who, at]
            by.append(who)
            found.append(t)
            at = at - self.size[t]
            more = at > 0
            who, at = who[more], at[more]
        by, found = np.concatenate(by[::-1]), np.concatenate(found[::-1])  # the last walked stand first in their piece
        order = np.argsort(by, kind="stable")
        return found[order], np.concatenate([[0], np.cumsum(np.bincount(by, minlength=len(pieces)))])
