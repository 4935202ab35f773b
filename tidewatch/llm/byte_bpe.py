"""Byte-level BPE: encoding by prefix dynamic programming, decoding, exact appends and edits.

For every byte prefix of a piece the one valid last token is stored: of the tokens that end there, the one
that fits behind the last token of what stands before it.  The tokens of any prefix follow by walking back;
appended bytes only add entries; after an edit the entries before it stay, and behind it re-encoding stops
as soon as as many entries as the longest token has bytes are as they were.

On columns, the pieces of many texts are marked with array operations, ``SLICE`` characters at a time, and
the table is filled once for each different piece; the ids of pieces met lately are kept, in two
generations of at most ``GENERATION`` pieces.  A text longer than a slice is cut where white space follows
something else, which no piece spans, so memory does not grow with a text; only a longer stretch without
white space is held whole.

Null and empty texts have no token, the digest of nothing and decode to nothing.  Repeated rows give a
row each.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidewatch.llm.bpe import NONE, Merges
from tidewatch.llm.grid import Grid
from tidewatch.llm.texts import kept, map_texts

SLICE, GENERATION, LONG, ROWS = 250_000, 60_000, 200, 8192
_OTHER, _LETTER, _NUMBER, _WHITE = 0, 1, 2, 3
# fixed values: Unicode White_Space
_WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_BORDER = re.compile(f"(?<=[^{''.join(map(chr, _WHITE_SPACE))}])[ \n\t]")


def parts(text: str, most: int = SLICE) -> Iterator[str]:
    """The text in parts that encode on their own, of ``most`` characters or as few more as there are to a border."""
    at = 0
    while len(text) - at > most:
        border = _BORDER.search(text, at + most)
        if border is None:
            break
        yield text[at : border.start()]
        at = border.start()
    yield text[at:]


def _categories() -> np.ndarray:
    import regex

    kind = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for name, value in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER)):
        for m in regex.finditer(name, every):
            kind[ord(m[0][0]) : ord(m[0][-1]) + 1] = value
    kind[_WHITE_SPACE] = _WHITE
    return kind


class PrefixTable:
    """The last tokens of every prefix of one piece."""

    def __init__(self, machine: Merges, data: bytes = b""):
        self.machine, self.data = machine, b""
        self.last = [NONE]
        self.open: list[int] = []  # starts from which some token may still grow
        self.append(data)

    def append(self, more: bytes) -> None:
        data, last, starts = self.data + more, self.last, self.open
        get, fits = self.machine.heads.get, self.machine.fits
        for to in range(len(self.data) + 1, len(data) + 1):
            starts.append(to - 1)
            dead, token = False, NONE
            for at in starts:
                t = get(data[at:to])
                if t is None:
                    dead = True
                elif t != NONE and token == NONE and (at == 0 or fits(last[at], t)):
                    token = t
            last.append(token)
            if dead:
                starts = [at for at in starts if data[at:to] in self.machine.heads]
        self.data, self.open = data, starts

    def replace(self, at: int, removed: int, put: bytes) -> int:
        """Replace bytes; returns how many entries were computed anew."""
        old, tail, longest = self.last, self.data[at + removed :], self.machine.longest
        self.data, self.last = self.data[:at], old[: at + 1]
        self.open = [k for k in range(max(0, at - longest), at) if self.data[k:] in self.machine.heads]
        self.append(put)
        done, same = len(put), 0
        for i in range(len(tail)):
            if same == longest:
                self.last += old[at + removed + i + 1 :]
                self.data += tail[i:]
                self.open = [k for k in range(max(0, len(self.data) - longest), len(self.data)) if self.data[k:] in self.machine.heads]
                return done
            self.append(tail[i : i + 1])
            done += 1
            same = same + 1 if self.last[-1] == old[at + removed + i + 1] else 0
        return done

    def ids(self, size: int | None = None) -> list[int]:
        """Numbers of the tokens of the prefix of ``size`` bytes (all of them by default)."""
        out, at, text = [], len(self.data) if size is None else size, self.machine.text
        while at:
            out.append(self.last[at])
            at -= len(text[out[-1]])
        return out[::-1]

    def tokens(self, size: int | None = None) -> list[bytes]:
        return [self.machine.text[t] for t in self.ids(size)]


class ByteBpe:
    """``ranks``: token bytes -> id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.machine = Merges(ranks)
        if not all(self.machine.own):
            raise ValueError("a token of the vocabulary does not encode to itself")
        self.grid = Grid(self.machine)
        self.id = np.array([ranks[x] for x in self.machine.text], np.int32)
        self.bytes = {v: k for k, v in ranks.items()}
        self.kind = _categories()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @classmethod
    def from_file(cls, path: str) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def pieces(self, code: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where pieces start.  ``begins``: where texts start.

        The same pieces as the pattern's: a run of letters, numbers or other marks takes one blank before it;
        white space before something else leaves its last character to it or alone; ``'s 't 're 've 'm 'll 'd``
        are split off a letter run behind a lone apostrophe.
        """
        n = code.size
        kind = self.kind[code]
        white = kind == _WHITE
        start = begins.copy()
        start[1:] |= kind[1:] != kind[:-1]
        follows = ~begins  # in the same text as the character before
        start[1:] &= ~(~white[1:] & (code[:-1] == 0x20) & follows[1:])
        start[:-1] |= white[:-1] & ~white[1:] & follows[1:]
        quote = np.flatnonzero((code == 0x27) & start)
        quote = quote[quote + 1 < n]
        quote = quote[follows[quote + 1]]
        after = code[quote + 1]
        one = quote[np.isin(after, [ord(c) for c in "stmd"])]
        two = quote[quote + 2 < n]
        two = two[follows[two + 2]]
        a, b = code[two + 1], code[two + 2]
        two = two[((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))]
        for found, size in ((one, 2), (two, 3)):
            start[found + 1] = False
            end = found + size
            start[end[end < n]] = True
        return start

    def learn(self, pieces: list[bytes]) -> None:
        """Keep the ids of pieces, as 32-bit integers."""
        number, ids = self.machine.number, self.id
        rest = []
        for x in pieces:
            known = self.old.get(x)
            if known is not None:
                self.young[x] = known
            elif x in number:
                self.young[x] = ids[number[x] : number[x] + 1].tobytes()
            elif len(x) > LONG:
                self.young[x] = ids[PrefixTable(self.machine, x).ids()].tobytes()
            else:
                rest.append(x)
        rest.sort(key=len, reverse=True)
        for a in range(0, len(rest), ROWS):
            tokens, at = self.grid.tokens(rest[a : a + ROWS])
            data, at = ids[tokens].tobytes(), (at * 4).tolist()
            self.young.update((x, data[b:c]) for x, b, c in zip(rest[a : a + ROWS], at, at[1:]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin (one more entry at the end)."""
        joined = "".join(texts)
        sizes = np.array([len(x) for x in texts], np.int64)
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        first = np.concatenate([[0], np.cumsum(sizes)])
        begins = np.zeros(code.size, bool)
        begins[first[:-1][sizes > 0]] = True
        start = self.pieces(code, begins)
        width = 1 + (code > 0x7F).astype(np.uint8) + (code > 0x7FF) + (code > 0xFFFF)
        offset = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        data = joined.encode()
        edges = [*offset[:-1][start].tolist(), len(data)]
        words = [data[a:b] for a, b in zip(edges, edges[1:])]
        different = set(words)
        new = [x for x in different if x not in self.young]
        if len(self.young) + len(new) > GENERATION:
            self.old, self.young, new = self.young, {}, list(different)
        self.learn(new)
        found = list(map(self.young.__getitem__, words))
        for x in new:
            if len(x) > LONG:
                del self.young[x]
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        upto = np.concatenate([[0], np.cumsum(counts)])
        before = np.concatenate([[0], np.cumsum(start)])  # pieces that begin before a character
        return np.frombuffer(b"".join(found), np.int32), upto[before[first]]

    def each(self, texts: list[str]) -> Iterator[Iterator[np.ndarray]]:
        """Of every text its ids, those of a long text part by part."""
        if any(len(x) > SLICE for x in texts):
            for x in texts:
                yield (self.encode([p])[0] for p in parts(x))
        else:
            ids, at = self.encode(texts)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                yield iter((ids[a:b],))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def coder(path: str) -> ByteBpe:
    return kept(path, lambda: ByteBpe.from_file(path))


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row."""

    def work(texts: list[str]) -> list:
        own = coder(ranks_path)
        return [[np.concatenate(list(some)) for some in own.each(texts)]]

    return map_texts(docs, work, [T.StructField("ids", T.ArrayType(T.IntegerType()))], id_col, text_col, keeps=ranks_path, chars=SLICE)


def round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encoded, then decoded from the ids.  A narrow map."""

    def work(texts: list[str]) -> list:
        own = coder(ranks_path)
        sizes, digests, back = [], [], []
        for some in own.each(texts):
            n, digest, plain = 0, hashlib.sha256(), hashlib.sha256()
            for ids in some:
                x = ids.tolist()
                digest.update((("," if n and x else "") + ",".join(map(str, x))).encode())
                plain.update(own.decode(x))
                n += len(x)
            sizes.append(n)
            digests.append(digest.hexdigest())
            back.append(plain.hexdigest())
        return [sizes, digests, back]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return map_texts(docs, work, fields, id_col, text_col, keeps=ranks_path, chars=SLICE)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
