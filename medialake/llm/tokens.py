"""Token-ID files: Parquet list columns in document order, for selective reads.

Ids are written by Spark's Parquet writer as a dictionary-encoded list column
with row groups of a set size; the writer adds page indexes. Counts lie in a
column of their own, so offsets are read without touching the ids.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, fresh_path, row_slices

END_ID = 0
ROW_GROUP_BYTES = 8 << 20
PAGE_BYTES = 256 << 10
#: Distinct pieces of text whose ids a worker remembers.
CACHE_PIECES = 600_000
#: New pieces given to the library as one text.
JOINED_PIECES = 4096
#: Texts encoded at once: rows, and bytes about.
ENCODE_ROWS, ENCODE_BYTES = 4096, 4 << 20

# Unicode's white space, as the pattern of byte-level BPE understands \s (fixed values).
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = re.compile(f"[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+")
# The same as UTF-8: ASCII, and the wider characters by their last bytes after the first ones (fixed values).
_LEADS = b"\t\n\v\f\r "
_ASCII_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_WIDE_BLANK = {(0xC2,): (0x85, 0xA0), (0xE1, 0x9A): (0x80,), (0xE2, 0x80): (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF), (0xE2, 0x81): (0x9F,), (0xE3, 0x80): (0x80,)}


def pieces(text: str) -> list[str]:
    """Cut a text where no pre-token reaches across: before white space that follows a visible character.

    Where all white space is single blanks and line ends between words, plain
    string methods find the same places faster.
    """
    words = text.split()
    gaps = len(words) - 1
    if gaps >= 0 and len(text) - sum(map(len, words)) == gaps == text.count(" ") + text.count("\n") and "\0" not in text:
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
    return _PIECE.findall(text)


def piece_starts(raw: np.ndarray, texts_at: np.ndarray) -> np.ndarray:
    """Byte positions at which the pieces of UTF-8 texts begin, the texts lying one behind the other.

    A piece begins with a text, and with ASCII white space after a visible
    character. Wide white space begins none, which leaves a longer piece.
    """
    blank = _ASCII_BLANK[raw]
    at = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    wide = np.flatnonzero(raw[at - 1] >= 0x80)
    unseen = np.zeros(len(at), dtype=bool)
    for head, tails in _WIDE_BLANK.items():
        spot = wide[at[wide] > len(head)]
        same = np.isin(raw[at[spot] - 1], tails)
        for back, byte in enumerate(reversed(head), start=2):
            same &= raw[at[spot] - back] == byte
        unseen[spot[same]] = True
    begins = np.zeros(len(raw), dtype=bool)
    begins[at[~unseen]] = True
    begins[texts_at[texts_at < len(raw)]] = True
    return np.flatnonzero(begins)


class PieceCache:
    """Little-endian 32-bit ids of pieces of text, encoded once each by the tokenizers library as it comes from its file."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        size = self.tokenizer.get_vocab_size()
        self.widths = np.array([self._width(k) for k in range(size)], dtype=np.int64)

    def _width(self, token: int) -> int:
        """UTF-8 bytes that a token stands for; special tokens stand for their literal, the others have a character a byte."""
        text = self.tokenizer.id_to_token(token)
        added = self.tokenizer.get_added_tokens_decoder()
        return 0 if text is None else len(text.encode()) if token in added else len(text)

    def _learn(self, missing: list[bytes]) -> None:
        """Encode new pieces.

        Those that begin with white space and end visibly are encoded behind one
        another: no pre-token crosses them, and as tokens keep every byte, the
        widths tell where each piece's ids end.
        """
        plain, odd = [], []
        for p in missing:
            (plain if p[0] <= 32 and p[0] in _LEADS and (32 < p[-1] < 128 or p[-1] >= 128 and not p.decode()[-1].isspace()) else odd).append(p)
        for at in range(0, len(plain), JOINED_PIECES):
            part = plain[at : at + JOINED_PIECES]
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join(part).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum(list(map(len, part)))) + 1
            raw, last = ids.tobytes(), 0
            for piece, end in zip(part, (4 * ends).tolist(), strict=True):
                self.known[piece] = raw[last:end]
                last = end
        for piece, got in zip(odd, self.tokenizer.encode_batch_fast([p.decode() for p in odd], add_special_tokens=False), strict=True):
            self.known[piece] = np.array(got.ids, dtype="<u4").tobytes()

    def ids(self, found: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces."""
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        self._learn([p for p in found if p not in self.known])
        return list(map(self.known.__getitem__, found))

    def encode(self, docs: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind one another, each closed by the end id, and how many each text has.

        Distinct pieces are found by Arrow's dictionary encoding over the text
        bytes; ids of all pieces are then gathered by position.
        """
        docs = docs.cast(pa.string()).fill_null("")
        _, offsets, data = docs.buffers()
        edges = np.frombuffer(offsets, dtype=np.int32)[docs.offset : docs.offset + len(docs) + 1].astype(np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)[edges[0] : edges[-1]] if data is not None else np.empty(0, dtype=np.uint8)
        edges = edges - edges[0]
        starts = piece_starts(raw, edges[:-1])
        cuts = pa.array(np.append(starts, len(raw)).astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, cuts.buffers()[1], pa.py_buffer(raw)]).dictionary_encode()
        made = self.ids(coded.dictionary.to_pylist()) + [np.array([end_id], dtype="<u4").tobytes()]
        lengths = np.array([len(x) // 4 for x in made], dtype=np.int64)
        places = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        closes = np.searchsorted(starts, edges[1:])  # the end id follows a text's last piece
        order = np.insert(coded.indices.to_numpy().astype(np.int64), closes, len(made) - 1)
        own = lengths[order]
        ends = np.cumsum(own)
        spots = np.repeat(places[order] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)
        last = closes + np.arange(len(closes))
        return np.frombuffer(b"".join(made), dtype="<u4")[spots], np.diff(ends[last], prepend=0)


_CACHES: dict[str, PieceCache] = {}


def piece_cache(path: str) -> PieceCache:
    if path not in _CACHES:
        _CACHES[path] = PieceCache(path)
    return _CACHES[path]


def write_token_files(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = END_ID, compression: str = "zstd") -> str:
    """Encode all texts and write ``(doc_id, n_tokens, ids)`` in ascending order of id; return the directory.

    The rows are dealt out in ranges of the id and sorted within each, so file
    ``part-00000`` holds the smallest ids and so on. Null ids come first, equal
    ids are ordered by their text. A null text counts as the empty one: its
    tokens are the end id alone. Texts are encoded as the library's plain call
    does: the literal of a special token becomes that token.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def encode(batches):
        cache = piece_cache(tokenizer_path)
        for batch in row_slices(batches, rows=ENCODE_ROWS, room=ENCODE_BYTES):
            ids, counts = cache.encode(column(batch, "text"), end_id)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(counts), pa.ListArray.from_arrays(offsets, pa.array(ids.view(np.int32)))], names=["doc_id", "n_tokens", "ids"])

    path = fresh_path(spark, "tokens")
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    (
        ordered.mapInArrow(encode, "doc_id long, n_tokens long, ids array<int>")
        .write.option("compression", compression)
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.dictionary.page.size", 1 << 20)
        .parquet(path)
    )
    return path


def read_tokens(spark, path: str, ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, file, row`` of token files, in file order, with the ids unless left out.

    Without ids, only the two small columns are read. ``row`` numbers the
    documents of a file from 0.
    """
    kinds = "doc_id long, n_tokens long" + ", ids array<int>" * ids
    rows = spark.read.schema(kinds).parquet(path)
    return rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def file_number(file: Column) -> Column:
    return F.regexp_extract(file, r"part-(\d+)[^/]*$", 1).try_cast("long")


def file_bases(spark, path: str) -> DataFrame:
    """For each token file the ids of all files before it: one row per file meets in one task.

    Files come by the number in their names, which has five digits or more.
    """
    totals = read_tokens(spark, path, ids=False).groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy(file_number(F.col("file")), "file").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def with_start(rows: DataFrame, path: str) -> DataFrame:
    """Adds ``start``, the ids before each document, to rows with ``file``, ``row`` and ``n_tokens``."""
    within = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("own", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return own.join(file_bases(rows.sparkSession, path), "file").withColumn("start", F.col("base") + F.col("own")).drop("base", "own")


def token_index(spark, path: str) -> DataFrame:
    """``file, row, doc_id, n_tokens, start`` of token files, from the count columns alone."""
    return with_start(read_tokens(spark, path, ids=False), path)


def token_digest(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files written."""

    def digest(batches):
        for batch in batches:
            ids = column(batch, "ids")
            flat = ids.flatten().cast(pa.int32()).to_numpy().astype("<u4")
            ends = np.cumsum(np.array(pc.list_value_length(ids)))
            raw = memoryview(flat.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "file"), column(batch, "row"), column(batch, "doc_id"), column(batch, "n_tokens"), pa.array(crc, pa.int64())], names=["file", "row", "doc_id", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).select("file", "row", "doc_id", "n_tokens", "ids")
    crcs = rows.mapInArrow(digest, "file string, row long, doc_id long, n_tokens long, ids_crc32 long")
    return with_start(crcs, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def tokenize(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write token files for ``docs``, read them back, and return ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before; it includes their end ids.
    Empty input gives no rows. Other columns are not looked at.
    """
    path = write_token_files(docs, tokenizer_path, id_column, text_column)
    return token_digest(docs.sparkSession, path)
