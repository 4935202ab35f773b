"""Lazily determinised transducers that step thousands of text chunks side by side.

A *specification* gives a start state, ``step(state, symbol) -> (state, emitted)`` and ``pack``/``unpack``
between states and bytes.  :class:`Lanes` numbers the states as they are met, keeps the transitions in an
open-addressing table and advances one symbol in every chunk ("lane") per vectorised step.  The table is
bounded: it is dropped before a run that finds it too large, and a run adds one state a symbol at most.

Chunks have equal lengths and so begin at arbitrary places.  The map of a chunk from its entry state
to (exit state, outputs) is constant behind the chunk's first reset, a place where the state is known
to be the start state.  Maps compose associatively: a constant map absorbs what stands before it, and
a chunk without a reset passes its entry state on through its symbols.  The first pass evaluates all
constant parts at once; the scan then hands every chunk the exit state of its predecessor, and the
parts before the first resets are evaluated, again side by side.
"""

from __future__ import annotations

import numpy as np

START, DEAD = 0, 1
_MULT = np.int64(-0x61C8864680B583EB)  # odd; products wrap


class Lanes:
    """``bits``: symbols are below ``2**bits``.  ``most_states``: beyond these the table is dropped before the next run."""

    def __init__(self, spec, bits: int, most_states: int = 200_000):
        self.spec, self.bits, self.most_states = spec, bits, most_states
        self._clear()

    def _clear(self) -> None:
        self.objects: list[bytes] = [self.spec.pack(self.spec.start()), b""]
        self.ids: dict[bytes, int] = {self.objects[0]: START}
        self.power, self.used = 14, 0
        self._alloc()

    def _alloc(self) -> None:
        size = 1 << self.power
        self.keys = np.full(size, -1, np.int64)
        self.to = np.zeros(size, np.int32)
        self.out = np.zeros(size, np.int8)

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key * _MULT) >> (64 - self.power)) & ((1 << self.power) - 1)

    def _insert(self, keys: np.ndarray, to: np.ndarray, out: np.ndarray) -> None:
        """Distinct new keys."""
        if (self.used + keys.size) * 2 > (1 << self.power):
            old = self.keys >= 0
            k, t, o = self.keys[old], self.to[old], self.out[old]
            while (self.used + keys.size) * 4 > (1 << self.power):
                self.power += 1
            self._alloc()
            self.used = 0
            self._insert(k, t, o)
        self.used += keys.size
        slot, mask, todo = self._hash(keys), (1 << self.power) - 1, np.arange(keys.size)
        while todo.size:
            free = self.keys[slot[todo]] < 0
            put = todo[free]
            self.keys[slot[put]] = keys[put]  # of several for one slot, the last stays
            won = put[self.keys[slot[put]] == keys[put]]
            self.to[slot[won]], self.out[slot[won]] = to[won], out[won]
            left = np.ones(keys.size, bool)
            left[won] = False
            todo = todo[left[todo]]
            slot[todo] = (slot[todo] + 1) & mask

    def _learn(self, keys: np.ndarray) -> None:
        to, out = np.empty(keys.size, np.int32), np.empty(keys.size, np.int8)
        for i, key in enumerate(keys.tolist()):
            state, symbol = key >> self.bits, key & ((1 << self.bits) - 1)
            if state == DEAD:
                to[i], out[i] = DEAD, 0
                continue
            new, out[i] = self.spec.step(self.spec.unpack(self.objects[state]), symbol)
            new = self.spec.pack(new)
            n = self.ids.get(new)
            if n is None:
                n = self.ids[new] = len(self.objects)
                self.objects.append(new)
            to[i] = n
        self._insert(keys, to, out)

    def _find(self, key: np.ndarray) -> np.ndarray:
        slot = self._hash(key)
        bad = np.flatnonzero(self.keys[slot] != key)
        while bad.size:
            missing = bad[self.keys[slot[bad]] < 0]
            if missing.size:
                self._learn(np.unique(key[missing]))
                return self._find(key)
            slot[bad] = (slot[bad] + 1) & ((1 << self.power) - 1)
            bad = bad[self.keys[slot[bad]] != key[bad]]
        return slot

    def _advance(self, symbols: np.ndarray, keep: np.ndarray | None, state: np.ndarray, states: np.ndarray, outs: np.ndarray) -> np.ndarray:
        """Rows of ``symbols`` are steps, columns lanes; ``keep`` is 0 where a lane starts anew."""
        for t in range(symbols.shape[0]):
            if keep is not None:
                state = state * keep[t]
            slot = self._find((state << self.bits) | symbols[t])
            state = self.to[slot].astype(np.int64)
            states[t], outs[t] = state, self.out[slot]
        return state

    def run(self, symbols: np.ndarray, reset: np.ndarray, chunk: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """State after each symbol and what each emitted.  ``reset[i]``: symbol i is read from the start state."""
        n = symbols.size
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int8)
        if len(self.objects) > self.most_states:
            self._clear()
        chunk = chunk or int(min(1024, max(32, n // 4096)))
        lanes = -(-n // chunk)
        pad = lanes * chunk - n
        s = np.pad(symbols.astype(np.int16), (0, pad)).reshape(lanes, chunk).T.copy()
        r = np.pad(reset, (0, pad), constant_values=True).reshape(lanes, chunk).T.copy()
        r[0, 0] = True
        states, outs = np.empty((chunk, lanes), np.int32), np.empty((chunk, lanes), np.int8)
        first = np.where(r.any(axis=0), r.argmax(axis=0), chunk)
        ends = self._advance(s, ~r, np.full(lanes, DEAD, np.int64), states, outs)
        todo = np.flatnonzero(first > 0)
        while todo.size:  # each round settles every chunk whose predecessor's exit state is known
            ready = todo[ends[todo - 1] != DEAD]
            order = ready[np.argsort(-first[ready], kind="stable")]
            state, deep = ends[order - 1].astype(np.int64), first[order]
            for t in range(int(deep[0])):
                m = int(np.searchsorted(-deep, -t, side="left"))  # lanes whose head is longer than t
                lane = order[:m]
                slot = self._find((state[:m] << self.bits) | s[t, lane])
                state = self.to[slot].astype(np.int64)
                states[t, lane], outs[t, lane] = state, self.out[slot]
                whole = lane[deep[:m] == t + 1]
                whole = whole[first[whole] == chunk]
                if whole.size:
                    ends[whole] = states[t, whole]
            todo = np.setdiff1d(todo, ready, assume_unique=True)
        return states.T.reshape(-1)[:n], outs.T.reshape(-1)[:n]
