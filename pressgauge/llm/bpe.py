"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

The rank file (one base64 token and its rank a line) becomes a sentencepiece BPE model without
any training: every byte is one character of a private alphabet, a token is the string of its
bytes' characters, and its score is its negative rank, so the merge that sentencepiece prefers is
the one of lowest rank, leftmost first. The normaliser is the identity. The text is cut into
pre-tokens by the tokenizer's pattern, each is encoded alone, and decoding looks the bytes of
every id up again.

A pre-token that is itself in the vocabulary is that one token, whether or not merges lead to it.
Null text is the empty text: no tokens, no bytes. Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.llm.common import doc_text, map_arrow, strings

# Fixed values of the sentencepiece model file: piece types and model type.
NORMAL, UNKNOWN, BPE = 1, 2, 2
# The character of byte b is chr(FIRST_CHAR + b): letters of two UTF-8 bytes, none of them a space.
FIRST_CHAR = 0x100
# A task keeps the ids of up to twice so many pre-tokens, those used of late.
CACHED = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    """A protobuf field: a length and bytes, or an integer."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def byte_string(token: bytes) -> str:
    return "".join([chr(FIRST_CHAR + b) for b in token])


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model file: <unk> is piece 0, the token of rank r is piece r + 1.

    Ranks must run from 0 without gaps.
    """
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0 to n - 1")
    pieces = [_field(1, b"<unk>") + _field(3, UNKNOWN)]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        score = b"\x15" + struct.pack("<f", -float(rank))  # field 2, a float
        pieces.append(_field(1, byte_string(token).encode()) + score + _field(3, NORMAL))
    trainer = _field(3, BPE) + _field(4, len(pieces)) + _field(40, 0)
    # -1 as a 64-bit varint: no begin, end or padding piece
    trainer += b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes single texts; made once in a task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self._split = regex.compile(pattern).findall
        self._ranks = ranks
        self._model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self._bytes = [token for token, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self._chars = [chr(FIRST_CHAR + b) for b in range(256)]
        self._known: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}

    def _learn(self, pre_tokens: list[str]) -> None:
        """Adds the ids of pre-tokens that are not known yet."""
        if len(self._known) > CACHED:
            self._before, self._known = self._known, {}
        known, before, unseen = self._known, self._before, []
        for pre_token in set(pre_tokens).difference(known):
            if pre_token in before:
                known[pre_token] = before[pre_token]
            elif (rank := self._ranks.get(pre_token.encode())) is not None:
                known[pre_token] = struct.pack("<I", rank)
            else:
                unseen.append(pre_token)
        spelled = ["".join(map(self._chars.__getitem__, x.encode())) for x in unseen]
        for pre_token, ids in zip(unseen, self._model.encode(spelled, num_threads=1) if unseen else [], strict=True):
            known[pre_token] = struct.pack(f"<{len(ids)}I", *[i - 1 for i in ids])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pre_tokens = self._split(text)
        self._learn(pre_tokens)
        return b"".join(map(self._known.__getitem__, pre_tokens))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self._bytes.__getitem__, struct.unpack(f"<{len(packed) // 4}I", packed)))


def encode_decode(docs: DataFrame, path: str, pattern: str, decoded: bool = True, *more: str) -> DataFrame:
    """doc_id, `more`, n_tokens, ids (binary: little-endian unsigned 32-bit integers) and, unless left out,
    decoded (binary: the bytes that the ids stand for). One row for each row; nothing is shuffled.

    The rank file is read on the driver and broadcast; its size is the vocabulary's, whatever the data.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def work(rows: pa.RecordBatch, codec: Codec) -> dict:
        ids = [codec.encode(text) for text in strings(rows["text"])]
        found = {k: rows[k] for k in keys} | {
            "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids": pa.array(ids, pa.binary()),
        }
        if decoded:
            found["decoded"] = pa.array([codec.decode(x) for x in ids], pa.binary())
        return found

    keys = ["doc_id", *more]
    rows = doc_text(docs, *more)
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", n_tokens bigint, ids binary"
    return map_arrow(rows, schema + ", decoded binary" * decoded, work, setup=lambda: Codec(ranks.value, pattern))


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the decoded bytes."""
    return encode_decode(docs, path, pattern).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
