"""Token counts of whole texts from a compiled finite-state tokenizer.

The vocabulary of a character-level BPE model (unknown characters fall back to bytes) is compiled into
a deterministic transducer whose transitions say by how many tokens the count changes
(:mod:`.bpe`); :mod:`.lanes` steps it through fixed-size chunks of many texts at once and composes the
chunks' state maps by a scan.  A place that no token can cross is a reset; a text longer than ``SLICE`` is
read in parts that end at resets, so memory does not grow with it.

Null and empty texts have no token.  Repeated ids and texts give a row each; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.bpe import SYMBOL_BITS, Transducer
from tidewatch.llm.lanes import Lanes
from tidewatch.llm.texts import kept, map_texts

SPACE = "▁"
_SEPARATOR = "\ud800"  # a lone surrogate, which no text can hold
SLICE = 250_000


class _Counts(Transducer):
    """Symbols are numbers of known characters; 0 separates texts and stands for unknown characters."""

    def step(self, state, c):
        return (self.start(), 0) if c == 0 else super().step(state, c)


class CountingTransducer:
    """``pieces``: list of (piece, merge rank); every character of a piece must be a piece."""

    def __init__(self, pieces: list[tuple[str, int]]):
        chars = sorted({c for p, _ in pieces for c in p})
        if len(chars) >= 1 << SYMBOL_BITS or {c for c in chars} - {p for p, _ in pieces}:
            raise ValueError("not a character-level vocabulary of the supported size")
        number = {c: i + 1 for i, c in enumerate(chars)}
        self.machine = _Counts({tuple(number[c] for c in p): r for p, r in pieces})
        self.classes = np.zeros(0x110000, np.int16)
        self.classes[[ord(c) for c in chars]] = range(1, len(chars) + 1)
        self.crossed = np.zeros(1 << 2 * SYMBOL_BITS, bool)
        self.crossed[list(self.machine.inside)] = True
        self.lanes = Lanes(self.machine, SYMBOL_BITS)

    @classmethod
    def from_sentencepiece(cls, path: str) -> CountingTransducer:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return cls([(sp.id_to_piece(i), round(-sp.get_score(i))) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))])

    def counts(self, texts: list[str], chunk: int | None = None) -> np.ndarray:
        """Tokens of each text; a text of more than ``SLICE`` characters is read part by part."""
        if any(len(x) > SLICE for x in texts):
            return np.array([sum(int(self._counts([p], chunk)[0]) for p in self.parts(x)) for x in texts], np.int64)
        return self._counts([f"{SPACE}{x}".replace(" ", SPACE) if x else "" for x in texts], chunk)

    def _symbols(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters, their numbers, and whether a token may begin there only."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol = self.classes[code]
        reset = np.ones(code.size, bool)
        reset[1:] = ~self.crossed[(symbol[:-1].astype(np.int32) << SYMBOL_BITS) | symbol[1:]]
        return code, symbol, reset

    def parts(self, text: str, most: int = SLICE) -> Iterator[str]:
        """Parts of a text, ready to count, that no token crosses; as much longer than ``most`` as there is no such place."""
        held = SPACE if text else ""
        for at in range(0, len(text), most):
            held += text[at : at + most].replace(" ", SPACE)
            borders = np.flatnonzero(self._symbols(held)[2])
            if borders[-1]:
                yield held[: borders[-1]]
                held = held[borders[-1] :]
        yield held

    def _counts(self, texts: list[str], chunk: int | None) -> np.ndarray:
        code, symbol, reset = self._symbols("".join(_SEPARATOR + x for x in texts))
        _, more = self.lanes.run(symbol, reset, chunk)
        separator = code == ord(_SEPARATOR)
        count = more.astype(np.int64)
        lost = (symbol == 0) & ~separator  # one token per UTF-8 byte
        count[lost] = 1 + (code[lost] > 0x7F).astype(np.int64) + (code[lost] > 0x7FF) + (code[lost] > 0xFFFF)
        return np.add.reduceat(count, np.flatnonzero(separator)) if texts else np.zeros(0, np.int64)


def transducer(path: str) -> CountingTransducer:
    return kept(path, lambda: CountingTransducer.from_sentencepiece(path))


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; a narrow map, no shuffle."""

    def work(texts: list[str]) -> list:
        n = transducer(model_path).counts(texts)
        return [[len(x.encode()) for x in texts], n, n > limit]

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return map_texts(docs, work, fields, id_col, text_col, keeps=model_path, chars=SLICE)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).select(F.col("doc_id"), "n_bytes", "n_tokens", "over_limit")
