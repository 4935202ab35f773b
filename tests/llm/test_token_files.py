import io
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import zstandard
from tokenizers import Tokenizer

from tests.llm.helpers import docs, write_docs
from tests.llm.test_tokens import texts
from tidewatch.llm import token_files as F


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def test_stretches_encode_as_whole_texts(library):
    own = F.WordEncoder(P.path("word_bpe_49k.json"), most=100)
    odd = ["A <|endoftext|>b <|startoftext|>", "é ́x ΑΣ Σ", "İ İ a b c\td\r\ne", "x" * 500, *texts(1500, seed=9)]
    for at in range(0, len(odd), 50):
        some = odd[at : at + 50]
        want = [np.array(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in some]
        assert own.encode(some) == want


def test_words_with_marks_and_long_texts(library):
    own = F.WordEncoder(P.path("word_bpe_49k.json"), most=1000)
    marks = [w + m for w in ("Word", "naïve", "İx", "ﬁn", "ж", "x1", "'s", "a'", "startoftext", "<|endoftext", "e\u0301") for m in (",", ".***", "!!", "'", "''", "|>", "'s", ".'t", "=\u0338", "-" * 70)]
    stretch = "no" * 300_000 + "\n"
    odd = [" ".join(marks), *marks, "one, Two  three.\n" * 40_000, stretch + "b c", stretch.strip(), " " * 600_000, "\n" * 3]
    for some in (odd, *([x] for x in odd)):
        want = [np.array(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in some]
        assert own.encode(some) == want
    assert max(map(len, own.known)) <= 64


def test_file_format(monkeypatch):
    monkeypatch.setattr(F, "FRAME_BYTES", 64)
    data = [np.arange(n, dtype="<u4").tobytes() for n in (1, 0, 3, 100, 2, 16, 16, 500)]
    out = io.BytesIO()
    w = F.ShardWriter(out)
    for i, d in enumerate(data):
        w.add(None if i == 2 else i, d)
    w.close()
    file, at, plain = out.getvalue(), 0, []
    while at < len(file):  # every frame can be told from the file alone
        magic, size = np.frombuffer(file[at : at + 8], "<u4")
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            at += 8 + int(size)
        else:
            one = zstandard.ZstdDecompressor().decompressobj()
            plain.append(one.decompress(file[at:]))
            at = len(file) - len(one.unused_data)
    assert b"".join(plain) == b"".join(data)
    r = F.ShardReader(io.BytesIO(out.getvalue()))
    assert r.ids == [0, 1, None, 3, 4, 5, 6, 7] and [r.document(i) for i in range(8)] == data
    r = F.ShardReader(io.BytesIO(out.getvalue()))
    assert r.document(4) == data[4] and r.read_frames <= 2
    broken = bytearray(out.getvalue())
    r.sums[0] ^= 1
    with pytest.raises(ValueError):
        F.ShardReader.frame(r, 0)
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        F.ShardReader(io.BytesIO(bytes(broken)))


def test_query(spark, tmp_path, library):
    t = [None, "", *texts(80, seed=4)]
    t.append(t[-1])
    ids = [7 * i % len(t) for i in range(len(t))]
    want, start = {}, 0
    by_id = dict(zip(ids, t))
    for i in sorted(by_id):
        x = np.array([*library.encode(by_id[i] or "", add_special_tokens=False).ids, 2], "<u4")
        want[i] = (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    got = F.op4_token_files(spark, write_docs(spark, tmp_path, t, ids)).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want and len(got) == len(t)


def test_ties_nulls_and_empty(spark, tmp_path):
    path = P.path("word_bpe_49k.json")
    same = docs(spark, ["b a", "a", "a", "c"], [5, 5, 5, None])
    m = F.write_token_files(same, f"file://{tmp_path}", path, 2)
    got = F.read_token_files(spark, m, same.schema["doc_id"].dataType).collect()
    assert sorted((r.start, r.doc_id) for r in got)[0] == (0, None) and len(got) == 4
    assert F.write_token_files(docs(spark, []), f"file://{tmp_path}/e", path, 2) == []
    assert F.read_token_files(spark, [], same.schema["doc_id"].dataType).count() == 0
