import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leafmill.llm import byte_bpe, packing, pieces, storage, token_files

EDGE = ["", "  a  b\n\nc ", " x", "x ", "\n", "a\nb", "a \n b", "it's 's a", "don't\tgo", "é̈ Σας", "<|endoftext|> hi", " ", "a\r\nb", "\n\nab cd", "1234 56 &*(", "a\u0085b c", "日本語 テスト", "a" * 3000]
RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
CODEC = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = CODEC.encoder()


def test_perfect_hash():
    assert sorted(CODEC.table.find(k) for k in RANKS) == list(range(len(RANKS)))
    assert CODEC.table.find(b"no such entry") == -1
    assert byte_bpe.PerfectHash([]).find(b"x") == -1


def test_bpe_edges():
    for text, ids in zip(EDGE, ENCODER.encode(EDGE)):
        own = np.frombuffer(ids, "<u4").tolist()
        assert own == LIBRARY.encode_ordinary(text)
        assert CODEC.decode(own) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab .,\n\t'sté1ß "), max_size=40))
def test_bpe_as_library(text):
    assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == LIBRARY.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abQ .,\n\t'sté1ß "), max_size=40))
def test_pieces_as_library(text):
    for name, keep_space in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        if name not in TOKENIZERS:
            t = Tokenizer.from_file(public_tokenizers.path(name))
            TOKENIZERS[name] = t, pieces.library_encoder.__wrapped__(public_tokenizers.path(name), keep_space)
        t, own = TOKENIZERS[name]
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


TOKENIZERS: dict = {}


def test_memory_forgets_and_learns():
    memory = pieces.Memory(most=3)
    for batch in ({"a", "b"}, {"c", "d"}, {"a", "e"}, {"f"}, {"a"}):
        for x in memory.missing(batch):
            memory.young[x] = x
        assert batch <= memory.young.keys()
    assert len(memory.young) <= 6


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32), st.data())
def test_packing_bits(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, (1 << bits) - 1), max_size=50)), "<u4")
    raw = token_files.pack(ids, bits)
    assert len(raw) == -(-len(ids) * bits // 8)
    for start in range(0, len(ids) + 1, 7):
        assert token_files.unpack(raw, bits, start, len(ids) - start).tolist() == ids[start:].tolist()


def test_ids_that_do_not_fit():
    for bits in (3, 8, 16, 17):
        with pytest.raises(ValueError):
            token_files.pack(np.array([0, 1 << bits], "<u4"), bits)
    assert pieces.vocabulary_of(public_tokenizers.path("byte_bpe_50k.json")) == 50_257


def test_block_random_access():
    docs = [np.arange(n, dtype="<u4").tobytes() for n in (3, 0, 9)]
    block = token_files.Block(token_files.write_block(docs, token_files.bits_for(50_257), 12))
    assert (block.bits, block.first, block.n_ids) == (16, 12, 12)
    assert [block.doc(k).tolist() for k in range(3)] == [[0, 1, 2], [], list(range(9))]


ROWS = [(4, "b c", "x"), (2, None, "y"), (9, "", None), (2, "Hello World " * 2000, "z"), (None, "q", "z")]


def test_token_files(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, start string")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for table, n in ((docs, 5), (docs.limit(0), 0)):
        path = storage.new_path(spark, "test_files")
        token_files.write_token_files(table, path, public_tokenizers.path("byte_bpe_50k.json"), 50_257, partitions=3)
        got = sorted(token_files.token_digests(token_files.read_token_files(spark, path)).collect(), key=lambda r: r.start)
        assert len(got) == n
    path = storage.new_path(spark, "test_files")
    token_files.write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 50_257, partitions=3)
    got = sorted(token_files.token_digests(token_files.read_token_files(spark, path)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 2, 2, 4, 9]
    at = 0
    texts = {(None, "q"), (2, ""), (2, "Hello World " * 2000), (4, "b c"), (9, "")}
    want = {(d, zlib.crc32(np.array(t.encode(x, add_special_tokens=False).ids + [0], "<u4").tobytes())) for d, x in texts}
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert {(r.doc_id, r.ids_crc32) for r in got} == want


def test_packing(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, length string")
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    assert all(r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and len(r.ids) == r.length for r in got)
    for d, x in ((4, "b c"), (9, ""), (None, "q")):
        mine = sorted((r for r in got if r.doc_id == d), key=lambda r: r.start)
        assert sum((list(r.ids) for r in mine), []) == t.encode(x, add_special_tokens=False).ids + [1]
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.doc_tokens == sum(m.length for m in mine) for r in mine)
        assert [r.start for r in mine] == [sum(m.length for m in mine[:i]) for i in range(len(mine))]
    assert packing.lengths(4096 + 5) == [2048, 2048, 4, 1]
    assert packing.pack_documents(docs.limit(0), public_tokenizers.path("word_bpe_49k.json"), end_id=1).collect() == []


def test_bpe_documents(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, ids string")
    got = byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    digest = lambda x: hashlib.sha256(x).hexdigest()
    want = [(d or -1, LIBRARY.encode_ordinary(x or ""), x or "") for d, x, _ in ROWS]
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in got) == sorted((d, len(i), digest(",".join(map(str, i)).encode()), digest(x.encode()), tuple(i)) for d, i, x in want)
    assert byte_bpe.encode_documents(docs.limit(0), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect() == []
