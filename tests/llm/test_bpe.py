import struct

import public_tokenizers
import pytest
import tiktoken

from pressgauge.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={}
    )


def test_ids_equal_the_reference_and_decode(odd_docs, reference, texts_of):
    rows = bpe.encode_decode(odd_docs, PATH, public_tokenizers.PATTERN).collect()
    want = []
    for doc_id, text in texts_of(odd_docs):
        ids = reference.encode_ordinary(text)
        want.append((doc_id, len(ids), struct.pack(f"<{len(ids)}I", *ids), text.encode()))
    got = [(r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_single_texts(reference):
    codec = bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    for text in ("a" * 5_000, " " * 300 + "x", "<|endoftext|> <unk> ▁", "don't we'LL", "İŉẞ", "\n\n\n a\r\n"):
        ids = reference.encode_ordinary(text)
        assert codec.encode(text) == struct.pack(f"<{len(ids)}I", *ids)
        assert codec.decode(codec.encode(text)) == text.encode()


def test_cache_generations(monkeypatch, prose, reference):
    monkeypatch.setattr(bpe, "CACHED", 3)
    codec = bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    for seed in range(5):
        text = prose(seed, 40)
        assert codec.encode(text) == struct.pack(f"<{len(reference.encode_ordinary(text))}I", *reference.encode_ordinary(text))


def test_no_rows(no_docs):
    assert bpe.token_digests(no_docs, PATH, public_tokenizers.PATTERN).collect() == []


def test_ranks_with_gaps_are_refused():
    with pytest.raises(ValueError):
        bpe.serialise_model({b"a": 0, b"b": 2})
