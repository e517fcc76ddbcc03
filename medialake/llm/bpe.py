"""Byte-level BPE through a sentencepiece model written straight from a rank file.

Every token of the vocabulary becomes a piece: its bytes are mapped to one
character each and its score is the negative rank, so the library's merge loop
(always the adjacent pair whose union scores highest, leftmost first) is the
rank-driven merge loop of byte-level BPE. Normalisation is the identity.
Encoding goes pre-token by pre-token; decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, row_slices, texts
from .tokens import pieces

CACHE_PIECES = 800_000
#: Byte b is written as the character 0x100 + b: no white space, no control character, one character per byte.
FIRST_CHAR = 0x100
_TO_CHARS = {b: chr(FIRST_CHAR + b) for b in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from a file with lines of base64 and rank."""
    with open(path, "rb") as file:
        ranks = dict(reversed(line.split()) for line in file if line.strip())
    return [base64.b64decode(ranks[b"%d" % k]) for k in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: length-delimited, varint or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def byte_chars(raw: bytes) -> str:
    return "".join(map(_TO_CHARS.__getitem__, raw))


def model_proto(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model with the unknown piece as id 0 and token k as id k + 1."""
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, byte_chars(raw).encode()) + _field(2, float(-rank)) + _field(3, 1) for rank, raw in enumerate(tokens)]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBPE:
    """Encodes texts piece by piece and decodes ids; pieces seen before are looked up."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.tokens))
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, docs: list[str]) -> list[list[int]]:
        """Ids of each text. Pieces are cut where no pre-token can reach across."""
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        split = list(map(pieces, docs))
        found = [list(map(self.known.get, own)) for own in split]
        missing = list(dict.fromkeys(p for own, got in zip(split, found, strict=True) if None in got for p, x in zip(own, got, strict=True) if x is None))
        owner, words = [], []
        for k, piece in enumerate(missing):
            for word in self.split(piece):
                owner.append(k)
                words.append(byte_chars(word.encode()))
        made: list[list[int]] = [[] for _ in missing]
        for k, ids in zip(owner, self.processor.encode(words, num_threads=1) if words else [], strict=True):
            made[k] += ids
        for piece, ids in zip(missing, made, strict=True):
            self.known[piece] = tuple(x - 1 for x in ids)
        whole = itertools.chain.from_iterable
        return [list(whole(got if None not in got else map(self.known.__getitem__, own))) for own, got in zip(split, found, strict=True)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CODERS: dict[tuple[str, str], ByteBPE] = {}


def coder(path: str, pattern: str) -> ByteBPE:
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = ByteBPE(path, pattern)
    return _CODERS[path, pattern]


def encode_column(docs: DataFrame, path: str, pattern: str, text_column: str = "text", ids_column: str = "ids") -> DataFrame:
    """``docs`` with one more column, the ids of its text as an array. A null text has none."""
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_column, T.ArrayType(T.IntegerType()))])

    def encode(batches):
        own = coder(path, pattern)
        for batch in row_slices(batches, text_column):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.encode(texts(batch, text_column)), pa.list_(pa.int32()))], names=schema.names)

    return docs.mapInArrow(encode, schema)


def decode_column(docs: DataFrame, path: str, pattern: str, ids_column: str = "ids", text_column: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that its ids stand for, as a binary column."""
    schema = T.StructType([*docs.schema.fields, T.StructField(text_column, T.BinaryType())])

    def decode(batches):
        own = coder(path, pattern)
        for batch in batches:
            raw = [own.decode(x or []) for x in column(batch, ids_column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=schema.names)

    return docs.mapInArrow(decode, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode and decode every text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    A null or empty text has no ids and decodes to no bytes. Repeated rows give
    repeated rows. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))

    def digest(batches):
        own = coder(path, pattern)
        decimal = [b"%d" % k for k in range(len(own.tokens))].__getitem__
        for batch in row_slices(batches):
            ids = own.encode(texts(batch))
            count = pa.array(np.array([len(x) for x in ids], dtype=np.int64))
            coded = [hashlib.sha256(b" ".join(map(decimal, x))).hexdigest() for x in ids]
            decoded = [hashlib.sha256(own.decode(x)).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), count, pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
