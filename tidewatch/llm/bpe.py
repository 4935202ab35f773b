"""Byte-pair encoding as a finite-state device.

Greedy merging gives every prefix of a text one last token.  A split of a text into tokens is the
encoder's own exactly if each token encodes to itself and each pair of neighbours, joined, encodes to
that pair.  So the last token of a prefix is the only token that ends there and fits behind the last
token of what stands before it.  What later symbols can ask about a prefix is finite: the starts from
which some token may still grow, each with the token before it.  That is the state of :class:`Transducer`.

Tables are keyed by packed integers and states are kept as packed bytes, which takes about a third of
what tuples take.
"""

from __future__ import annotations

from array import array

NONE = -1  # "no token before": nothing can merge across
_TOP = 1 << 60
SYMBOL_BITS = 12
_MOST_PAIRS = 60_000


class Merges:
    """``tokens``: symbols (bytes, or a tuple of numbers) -> rank; two neighbours merge if their join is a token,
    lowest rank first, then leftmost.  Single symbols are no merges."""

    def __init__(self, tokens: dict):
        self.text = list(tokens)
        self.longest = max(map(len, self.text), default=0)
        self.number = {x: i for i, x in enumerate(self.text)}
        self.rank = [tokens[x] if len(x) > 1 else -1 for x in self.text]
        self.left, self.right, self.own = [NONE] * len(self.text), [NONE] * len(self.text), [False] * len(self.text)
        for i, x in enumerate(self.text):
            if len(x) == 1:
                self.own[i] = True
                continue
            parts, last = self.merge(x)
            if len(parts) == 1:
                self.own[i], (self.left[i], self.right[i]) = True, last
        self.rank, self.left, self.right, self.own = array("i", self.rank), array("i", self.left), array("i", self.right), bytearray(self.own)
        self.heads = dict(self.number)  # beginnings of tokens, too
        for x in self.text:
            for k in range(len(x) - 1, 0, -1):
                self.heads.setdefault(x[:k], NONE)
        self.memo: dict[int, bool] = {}

    def merge(self, symbols) -> tuple[list[int], tuple | None]:
        """Plain greedy merging; the tokens and the last merge made."""
        parts, made = [self.number[symbols[i : i + 1]] for i in range(len(symbols))], None
        while True:
            best, at = _TOP, -1
            for i in range(len(parts) - 1):
                t = self.number.get(self.text[parts[i]] + self.text[parts[i + 1]])
                if t is not None and self.rank[t] < best:
                    best, at, to = self.rank[t], i, t
            if at < 0:
                return parts, made
            made = (parts[at], parts[at + 1])
            parts[at : at + 2] = [to]

    def fits(self, a: int, b: int) -> bool:
        """Whether the join of two tokens encodes to just these two: undo their merges, latest first, and
        look for a merge across the gap that would have come earlier."""
        key = a << 22 | b
        known = self.memo.get(key)
        if known is not None:
            return known
        before, ok = _TOP, True
        while True:
            t = self.number.get(self.text[a] + self.text[b])
            if t is not None and self.rank[t] < before:
                ok = False
                break
            ra, rb = self.rank[a], self.rank[b]
            if ra > rb:
                before, a = ra, self.right[a]
            elif rb >= 0:
                before, b = rb + 1, self.left[b]
            else:
                break
        if len(self.memo) > _MOST_PAIRS:
            self.memo.clear()
        self.memo[key] = ok
        return ok


class Transducer(Merges):
    """States know how many tokens the prefixes behind the open starts have; a step emits by how much the number of tokens changes."""

    def __init__(self, tokens: dict):
        super().__init__(tokens)
        self.inside = {a << SYMBOL_BITS | b for x in self.text for a, b in zip(x, x[1:])}  # neighbours within tokens
        self.child: dict[int, int] = {}
        self.ends, self.open = array("i", [NONE]), bytearray(1)
        for i, x in enumerate(self.text):
            if self.own[i]:
                at = 0
                for c in x:
                    self.open[at] = True
                    to = self.child.get(at << SYMBOL_BITS | c)
                    if to is None:
                        to = self.child[at << SYMBOL_BITS | c] = len(self.ends)
                        self.ends.append(NONE)
                        self.open.append(False)
                    at = to
                self.ends[at] = i

    def start(self) -> tuple:
        return (NONE,)

    @staticmethod
    def pack(state) -> bytes:
        return array("q", state).tobytes()

    @staticmethod
    def unpack(data: bytes) -> array:
        return array("q", data)

    def step(self, state, c: int) -> tuple[tuple, int]:
        """State: the last token, then each open start as one number: trie node, token before, its count less ours."""
        last = state[0]
        if last != NONE and self.text[last][-1] << SYMBOL_BITS | c not in self.inside:
            last = NONE
        token, more, grown = NONE, 0, []
        for code in (*state[1:], _code(0, last, 0)):
            node = self.child.get(code >> 28 << SYMBOL_BITS | c)
            if node is None:
                continue
            before, t = (code >> 6 & 0x3FFFFF) - 1, self.ends[node]
            less = (code & 63) - 32
            if token == NONE and t != NONE and (before == NONE or self.fits(before, t)):
                token, more = t, less + 1
            if self.open[node]:
                grown.append((node, before, less))
        if token == NONE:
            raise ValueError(f"no token ends at symbol {c!r}")
        return (token, *[_code(n, b, less - more) for n, b, less in grown]), more


def _code(node: int, before: int, less: int) -> int:
    """Nodes and tokens below 2^22, counts that differ by less than 32."""
    return (node << 22 | before + 1) << 6 | less + 32
