import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken

from tests.llm.helpers import docs, write_docs
from tidewatch.llm import byte_bpe, token_counts
from tidewatch.llm.byte_bpe import PrefixTable, coder, encode_documents, op7_byte_bpe
from tidewatch.llm.token_counts import count_tokens, op1_token_counts, transducer

ODD = ["", " ", "\n", "\n's", "\n 's", " 's", "'s't", "''s", "'re've'll", "don't I'll", "<s> </s> <unk> <|endoftext|>", "a" * 3000, " " * 500, "你好" * 300, "ab " * 4000, "\x00x"]


def texts(n, seed=1):
    r = random.Random(seed)
    letters = list("abcdeththeion  \n\t'srevlmd.,!?0129éàß▁你好吗的日本語のΣς\U0001f600 　\x1ć<s>")
    return ODD + ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(n)]


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def ranks():
    r = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=r, special_tokens={})


@pytest.mark.parametrize("chunk", [None, 1, 7, 100])
def test_counts_and_ids_equal_the_libraries_for_any_chunking(pieces, ranks, chunk):
    t = texts(800, seed=chunk or 0)
    assert transducer(P.path("piece_bpe_32k.model")).counts(t, chunk).tolist() == [len(x) for x in pieces.encode(t, num_threads=1)]
    ids, at = coder(P.path("byte_bpe_multi_50k.tiktoken")).encode(t)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [ranks.encode_ordinary(x) for x in t]


def test_prefix_table_appends_and_edits(ranks):
    machine = coder(P.path("byte_bpe_multi_50k.tiktoken")).machine
    r, data = random.Random(2), b"the thonerin that eratha ouwhea blendthing"
    table = PrefixTable(machine, data)
    for _ in range(60):
        at = r.randrange(len(data))
        gone, put = r.randrange(3), bytes(r.choices(b"thonerig", k=r.randrange(4)))
        data = data[:at] + put + data[at + gone :]
        table.replace(at, gone, put)
        assert table.tokens() == PrefixTable(machine, data).tokens()
        k = r.randrange(len(data))
        assert table.tokens(k) == PrefixTable(machine, data[:k]).tokens()


def test_an_edit_computes_little_anew():
    machine = coder(P.path("byte_bpe_multi_50k.tiktoken")).machine
    data = b"the" * 2000
    table = PrefixTable(machine, data)
    assert table.replace(3000, 1, b"x") <= 1 + 4 * machine.longest
    assert table.tokens() == PrefixTable(machine, data[:3000] + b"x" + data[3001:]).tokens()


@pytest.mark.parametrize("slice_", [1, 5, 40])
def test_long_texts_in_parts(pieces, ranks, slice_, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLICE", slice_)
    monkeypatch.setattr(token_counts, "SLICE", slice_)
    own = coder(P.path("byte_bpe_multi_50k.tiktoken"))
    for x in texts(300, seed=slice_):
        parts = list(byte_bpe.parts(x, slice_))
        assert "".join(parts) == x
        assert [i for some in own.each([x]) for ids in some for i in ids.tolist()] == ranks.encode_ordinary(x)
        assert transducer(P.path("piece_bpe_32k.model")).counts([x]).tolist() == [len(pieces.encode(x))]


def test_memory_does_not_grow_with_a_text():
    """A text of 50 million characters, in a process of its own that may take little more than the tables and the text."""
    import subprocess
    import sys

    code = r"""
import hashlib, resource, sys
import public_tokenizers as P
from tidewatch.llm.byte_bpe import coder
from tidewatch.llm.token_counts import transducer
own, other = coder(P.path("byte_bpe_multi_50k.tiktoken")), transducer(P.path("piece_bpe_32k.model"))
for x in ("the one\n thing 12 " * 20, "the one thing " * 3_600_000):
    plain = hashlib.sha256()
    n = 0
    for ids in next(iter(own.each([x]))) if len(x) > 250_000 else iter([own.encode([x])[0]]):
        plain.update(own.decode(ids.tolist()))
        n += ids.size
    assert plain.digest() == hashlib.sha256(x.encode()).digest() and n
    other.counts([x])
    rss = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
    first = rss if len(x) < 1000 else first
print(rss - first)
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=900)
    assert got.returncode == 0, got.stderr
    assert float(got.stdout) < 350  # of which the text and its bytes 150


def test_queries(spark, tmp_path, pieces, ranks):
    t = [None, "", *texts(60)]
    t.append(t[-1])
    folder = write_docs(spark, tmp_path, t)
    got = {r.doc_id: r for r in op1_token_counts(spark, folder).collect()}
    for i, x in enumerate(t):
        n = len(pieces.encode(x or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((x or "").encode()), n, n > 4096)
    got = {r.doc_id: r for r in op7_byte_bpe(spark, folder).collect()}
    for i, x in enumerate(t):
        ids = ranks.encode_ordinary(x or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((x or "").encode()).hexdigest()


def test_empty_table_and_ties(spark):
    assert count_tokens(docs(spark, []), P.path("piece_bpe_32k.model")).count() == 0
    twice = encode_documents(docs(spark, ["a b", "a b", None], [4, 4, None]), P.path("byte_bpe_multi_50k.tiktoken")).collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in twice) == [(0, 0), (4, 2), (4, 2)]
