"""Byte-level BPE through a sentencepiece model that is written directly from a rank file.

The rank file maps byte strings to ranks. Each becomes a piece of printable letters, one letter a byte,
scored by its negative rank, so the model's best-score-first merges are the merges of the ranks. The
model's normaliser is the identity and nothing is escaped. Texts are cut by the published pattern, every
match is encoded alone, and decoding maps each id back to its bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoloom.llm.common import Memo, free, named

# A single space before a character that is no space always opens a new match, so texts may be cut there
# and each cut remembered. Python's class of spaces holds all that the pattern's does.
CUT = re.compile(r" (?=\S)")


def byte_letters() -> list[str]:
    """A printable letter for each byte: itself where it is printable, else the next letter from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(data: bytes) -> list[bytes]:
    """Tokens in rank order from the lines ``base64 rank``."""
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in data.splitlines() if line.strip()))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must count up from 0")
    return [token for _, token in pairs]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value) -> bytes:
    """One field of a protocol buffer: an integer, a float, or bytes."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


# Fixed values of the model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_KIND, KIND_UNKNOWN = 1, 2, 3, 2
MODEL_KIND, KIND_BPE = 3, 2
NORMALIZER_NAME, DUMMY_PREFIX, TRIM_SPACES, ESCAPE_SPACES = 1, 3, 4, 5


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model with these pieces; the unknown piece that the format wants comes last."""
    letters = byte_letters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(letters[b] for b in token).encode()
        out += _field(PIECES, _field(PIECE_TEXT, piece) + _field(PIECE_SCORE, float(-rank)))
    out += _field(PIECES, _field(PIECE_TEXT, b"<unk>") + _field(PIECE_SCORE, 0.0) + _field(PIECE_KIND, KIND_UNKNOWN))
    out += _field(TRAINER, _field(MODEL_KIND, KIND_BPE))
    out += _field(NORMALIZER, _field(NORMALIZER_NAME, b"identity") + _field(DUMMY_PREFIX, 0) + _field(TRIM_SPACES, 0) + _field(ESCAPE_SPACES, 0))
    return bytes(out)


class ByteBpe:
    def __init__(self, data: bytes, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(data)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.tokens))
        letters = byte_letters()
        self.letters = str.maketrans({chr(b): letters[b] for b in range(256)})
        self.whole = {token: struct.pack("<I", rank) for rank, token in enumerate(self.tokens)}
        self.find = regex.compile(pattern).findall
        self.matches = Memo(self._match, 400_000)
        self.spaced = Memo(lambda cut: self._cut(" " + cut), 400_000)

    def _match(self, match: str) -> bytes:
        raw = match.encode()
        if known := self.whole.get(raw):
            return known
        ids = self.model.encode(raw.decode("latin-1").translate(self.letters))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _cut(self, cut: str) -> bytes:
        return b"".join(map(self.matches.__getitem__, self.find(cut)))

    def encode(self, text: str) -> bytes:
        first, *rest = CUT.split(text)
        return self._cut(first) + b"".join(map(self.spaced.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple, ByteBpe] = {}


def codec(data: bytes, pattern: str) -> ByteBpe:
    """The codec of a rank file, built once in each Python worker."""
    key = (hashlib.sha1(data).digest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = ByteBpe(data, pattern)
    return _CODECS[key]


def encode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids of every whole text as little-endian unsigned 32-bit integers.

    ``ranks`` is the content of a rank file, read once by the caller. Null texts are empty and get no
    ids; all columns stay, repeated rows too. ``out`` must be a new name.
    """
    @F.arrow_udf("binary")
    def ids_of(texts: pa.Array) -> pa.Array:
        work = codec(ranks, pattern).encode
        return pa.array([work(t or "") for t in texts.to_pylist()], pa.binary())

    return docs.withColumn(out, ids_of(named(text)))


def decode(df: DataFrame, ranks: bytes, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for. Null ids are empty."""
    @F.arrow_udf("binary")
    def bytes_of(column: pa.Array) -> pa.Array:
        work = codec(ranks, pattern).decode
        return pa.array([work(x or b"") for x in column.to_pylist()], pa.binary())

    return df.withColumn(out, bytes_of(named(ids)))


def tokens(docs: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text and decode its ids: key, n_tokens, ids, ids_sha256, decoded_sha256."""
    ids, back = free(docs.select(named(key), named(text)), "ids", "decoded")
    both = decode(encode(docs.select(named(key), named(text)), ranks, pattern, text, ids), ranks, pattern, ids, back)
    return both.select(named(key), (F.octet_length(named(ids)) / 4).cast("long").alias("n_tokens"), named(ids).alias("ids"), F.sha2(named(ids), 256).alias("ids_sha256"),
                       F.sha2(named(back), 256).alias("decoded_sha256"))


def digests(docs: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same without the ids themselves."""
    return tokens(docs, ranks, pattern, key, text).drop("ids")
