"""Token ids in seekable zstandard files.

A shard holds the ids of its documents, in order, as little-endian unsigned 32-bit integers cut into
frames that decompress on their own.  Behind them stand a skippable frame with the documents' ids and
offsets, and the seek table of the public zstandard seekable format: sizes and the low 32 bits of the
xxh64 digest of every frame.  A reader opens a shard by its two tables and decompresses only the frames
that a requested document touches; each is checked against its digest.

Documents are range-partitioned by id (ties: by text), so shards are in order and a hot or repeated id
cannot fill one; a shard is written under a name of the attempt and then renamed, so a lost or repeated
task leaves the same file.  Only the shards' sizes reach the driver.

Shards are sized by the bytes of their texts, and so are their indexes.  The index holds ids as JSON, so ids
are whole numbers, strings or null; other types are refused.  A text's words are encoded a part at a time;
its ids are held whole.

Null and empty texts have just the end id.  Null ids come first.  Repeated rows are separate documents.
An empty table writes no shard and returns no row.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.llm.texts import kept, slices
from tidewatch.runtime import shared_dir, ship

FRAME_BYTES = 1 << 18
PART = 500_000  # characters of a text whose words are held at a time
# bytes of text in a shard: up to MOST_SHARDS shards of the least size, from there on larger ones up to the greatest
LEAST_SHARD, GREATEST_SHARD, MOST_SHARDS, READ = 16 << 20, 256 << 20, 20_000, 4096
# fixed values of the zstandard frame and seekable formats
_SKIPPABLE, _SEEK_SKIPPABLE, _SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


class ShardWriter:
    """Writes documents one after the other to a binary file object."""

    def __init__(self, out, level: int = 3):
        self.out, self.zstd = out, zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.pending, self.frames, self.ids, self.ends, self.total = bytearray(), [], [], [], 0

    def add(self, doc_id, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.total += len(ids)
        self.ends.append(self.total)
        self.pending += ids
        if len(self.pending) >= FRAME_BYTES:
            view = memoryview(bytes(self.pending))
            full = len(view) // FRAME_BYTES * FRAME_BYTES
            for at in range(0, full, FRAME_BYTES):
                self._frame(view[at : at + FRAME_BYTES])
            self.pending = bytearray(view[full:])

    def _frame(self, data) -> None:
        packed = self.zstd.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.pending:
            self._frame(bytes(self.pending))
        index = self.zstd.compress(json.dumps(self.ids).encode() + b"\n" + np.array(self.ends, "<u8").tobytes())
        self.out.write(struct.pack("<II", _SKIPPABLE, len(index) + 4) + index + struct.pack("<I", len(index)))
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, _SEEK_MAGIC)
        self.out.write(struct.pack("<II", _SEEK_SKIPPABLE, len(table)) + table)


class ShardReader:
    """Random access to a shard through a seekable binary file object."""

    def __init__(self, file):
        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        size = file.seek(0, io.SEEK_END)
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != _SEEK_MAGIC:
            raise ValueError("no seek table")
        start = size - 9 - 12 * n
        table = np.frombuffer(self._at(start, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.sums = table[:, 2]
        self.packed = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.plain = np.concatenate([[0], np.cumsum(table[:, 1])])
        (length,) = struct.unpack("<I", self._at(start - 12, 4))
        ids, ends = self.zstd.decompress(self._at(start - 12 - length, length)).split(b"\n", 1)
        self.ids, self.ends = json.loads(ids), np.frombuffer(ends, "<u8").astype(np.int64)
        self.read_frames = 0
        self._last: tuple[int, bytes] = (-1, b"")

    def _at(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        if self._last[0] != k:
            data = self.zstd.decompress(self._at(int(self.packed[k]), int(self.packed[k + 1] - self.packed[k])))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} is damaged")
            self.read_frames += 1
            self._last = (k, data)
        return self._last[1]

    def document(self, i: int) -> bytes:
        a, b = int(self.ends[i - 1]) if i else 0, int(self.ends[i])
        first, last = np.searchsorted(self.plain, [a, max(a, b - 1)], side="right") - 1
        if a == b:
            return b""
        parts = [self.frame(k) for k in range(int(first), int(last) + 1)]
        at = a - int(self.plain[first])
        return parts[0][at : at + b - a] if len(parts) == 1 else b"".join(parts)[at : at + b - a]


class WordEncoder:
    """Ids by the tokenizers library, asked once for each different word.

    Exact for tokenizers that drop white space before merging and merge runs of letters apart from marks:
    no id spans a blank, or a letter and the mark behind it, and normalisation (composition, lower case)
    never looks across either.  Words of letters are asked for many at a time in one text and told apart
    by the ids that end words.  A stretch between blanks that is a word with ASCII marks behind it is put
    together from the two; they hold no letter, so no added token.  Equal stretches of a call are looked up
    once.  What is kept is bounded by ``most`` and holds no string over 64 characters.
    A tokenizer that does not say so in its settings is asked for whole texts.
    """

    MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str, most: int = 1_200_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.known: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.whole = not self._splits(json.loads(self.tokenizer.to_str()))

    @staticmethod
    def _splits(says: dict) -> bool:
        """Whether the settings are those that the short cuts are exact for."""
        norm, pre, model = says.get("normalizer") or {}, says.get("pre_tokenizer") or {}, says.get("model") or {}
        steps = [(x.get("type"), x.get("content")) for x in norm.get("normalizers", [norm])]
        cuts = [x for x in pre.get("pretokenizers", [pre]) if x.get("type") == "Split"]
        tail = "|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
        return (
            steps == [("NFC", None), ("Replace", " "), ("Lowercase", None)] and len(cuts) == 1 and cuts[0].get("pattern") == {"Regex": "'s" + tail} and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") is True
            and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not any(any(c.isspace() for c in x["content"]) or x["lstrip"] or x["rstrip"] for x in says.get("added_tokens", []))
        )

    def _ask(self, some: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def _ask_words(self, words: list[str]) -> None:
        for at in range(0, len(words), 400):
            some = words[at : at + 400]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if cut.size == len(some) and cut[-1] == ids.size:
                data, to = ids.tobytes(), (4 * cut).tolist()
                self.known.update(zip(some, [data[a:b] for a, b in zip([0, *to], to)]))
            else:
                self.known.update(zip(some, self._ask(some)))

    def _ids(self, stretches: list[str]) -> list[bytes]:
        """Ids of different stretches without blanks."""
        known, marks = self.known, self.MARKS
        out = list(map(known.get, stretches))
        at = [i for i, x in enumerate(out) if x is None]
        words, tails, ask, rest = [], [], set(), set()
        for i in at:
            w = stretches[i]
            word, tail = w.rstrip(marks), ""
            # words of Latin letters encode like their lower-case forms
            if word.isalpha() and len(word) <= 64 and (word.isascii() or max(word) < "\u0180"):
                if len(word) < len(w):
                    tail = w[len(word) :]
                    if tail not in known:
                        rest.add(tail)
                word = word.lower()
                if word not in known:
                    ask.add(word)
            else:
                word = w
                rest.add(w)
            words.append(word)
            tails.append(tail)
        self._ask_words(list(ask))
        rest = list(rest)
        for k in range(0, len(rest), 5000):
            known.update(zip(rest[k : k + 5000], self._ask(rest[k : k + 5000])))
        for i, word, tail in zip(at, words, tails):
            out[i] = known[word] + known[tail] if tail else known[word]
        for w in rest:
            if len(w) > 64:
                del known[w]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids."""
        if self.whole:
            return self._ask(texts)
        texts = [x.replace("\n", " ") for x in texts]
        if len(texts) == 1:
            return [b"".join(self._encode([x])[0] for x in _parts(texts[0]))]
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known.clear()
        split = pc.split_pattern(pa.array(texts, pa.string()), " ")
        dealt = split.flatten().dictionary_encode()
        # as one string, cut at line ends, of which no stretch has any: faster than one by one
        different = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(dealt.dictionary)], pa.int32()), dealt.dictionary), "\n")[0].as_py().split("\n")
        pieces, code = self._ids(different), dealt.indices.to_numpy()
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        first, n = np.cumsum(size) - size, size[code]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = np.frombuffer(b"".join(pieces), "<u4")[np.arange(ends[-1]) + np.repeat(first[code] - ends[:-1], n)]
        cut = ends[split.offsets.to_numpy()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cut, cut[1:])]


def _parts(text: str) -> Iterator[str]:
    """The text in parts that end at blanks, which no id spans."""
    at = 0
    while len(text) - at > PART:
        to = text.find(" ", at + PART)
        if to < 0:
            break
        yield text[at:to]
        at = to
    yield text[at:]


def _encoder(path: str) -> WordEncoder:
    return kept(path, lambda: WordEncoder(path))


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> list[tuple[int, str, int, int]]:
    """Write all texts as shards below ``folder``; returns (shard, file, documents, ids) of each, in order.

    ``shards``: by default as many as the bytes of all texts fill.
    """
    spark = docs.sparkSession
    ship(spark)
    kept = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))
    if shards is None:
        size = kept.agg(F.sum(F.octet_length("_text") + 8)).first()[0] or 0
        shards = max(1, -(-size // min(max(LEAST_SHARD, size // MOST_SHARDS), GREATEST_SHARD)))
    if not isinstance(kept.schema["_id"].dataType, T.IntegralType | T.StringType | T.NullType):
        raise TypeError(f"ids of type {kept.schema['_id'].dataType.simpleString()} cannot stand in the index")
    dealt = kept.repartitionByRange(shards, F.col("_id"), F.xxhash64("_text")).sortWithinPartitions("_id", F.xxhash64("_text"), "_text")
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])
    arrow, end = to_arrow_schema(schema), np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        task = TaskContext.get()
        own, name = f"{root}/.attempt-{task.taskAttemptId()}", f"shard-{task.partitionId():06d}.zst"
        writer = None
        for batch in batches:
            for part, texts in slices(batch, 1):
                if writer is None:
                    out = files.open_output_stream(own)
                    writer = ShardWriter(out)
                for i, ids in zip(part.column(0).to_pylist(), _encoder(tokenizer_path).encode(texts)):
                    writer.add(i, ids + end)
        if writer is not None:
            writer.close()
            out.close()
            files.move(own, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([len(writer.ids)], pa.int64()), pa.array([writer.total // 4], pa.int64())], schema=arrow)

    return sorted(tuple(r) for r in dealt.mapInArrow(run, schema).collect())


def read_token_files(spark: SparkSession, manifest: list[tuple[int, str, int, int]], id_type: T.DataType, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the shards; ``start`` counts the ids of all before it."""
    ship(spark)
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    arrow, rows, before = to_arrow_schema(schema), [], 0
    for _, file, _, n in manifest:
        rows.append((file, before))
        before += n
    files = spark.createDataFrame(rows, "file string, before long").repartition(max(1, len(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, path = _open(file)
                with store.open_input_file(path) as f:
                    shard = ShardReader(f)
                    sizes = np.diff(np.concatenate([[0], shard.ends])) // 4
                    starts = first + np.concatenate([[0], np.cumsum(sizes)[:-1]])
                    for a in range(0, len(shard.ids), READ):
                        b = min(a + READ, len(shard.ids))
                        columns = (shard.ids[a:b], starts[a:b], sizes[a:b], [zlib.crc32(shard.document(i)) for i in range(a, b)])
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, arrow)], schema=arrow)

    return files.mapInArrow(run, schema)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(docs, shared_dir(spark), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, manifest, docs.schema["doc_id"].dataType)
