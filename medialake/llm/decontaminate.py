"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

The grams of the benchmark are hashed into a sorted set that is broadcast; a
task scans the token windows of its documents against it in numpy and verifies
every hit word for word. A benchmark above :data:`BLOCK_BYTES` is taken in
blocks of that size, each scanned over all documents, so the broadcast is
bounded whatever the benchmark's size.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, free_name, gram_hashes, mix, row_slices, seeds, stored, text_bytes

WINDOW = 13
#: Benchmark text that is collected and broadcast at once.
BLOCK_BYTES = 16 << 20

#: On lower-cased UTF-8; bytes from 0x80 on belong to characters that are all word characters.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cases A-Z (and nothing else) and finds the words."""
    return _WORD.findall(raw.lower())


class GramSet:
    """All windows of some benchmark items, by length, with the items that have them."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.owners: dict[tuple[bytes, ...], list[str]] = {}
        owners = defaultdict(set)
        for item_id, raw in items:
            words = words_of(raw)
            k = min(window, len(words))
            for at in range(len(words) - k + 1) if k else ():
                owners[tuple(words[at : at + k])].add("" if item_id is None else str(item_id))
        self.owners = {gram: sorted(ids) for gram, ids in owners.items()}
        for gram in self.owners:
            for word in gram:
                self.vocabulary.setdefault(word, len(self.vocabulary) + 1)
        self.codes = seeds(len(self.vocabulary) + 1, 31)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in {len(gram) for gram in self.owners}:
            ids = np.array([[self.vocabulary[w] for w in gram] for gram in self.owners if len(gram) == k])
            hashes = np.unique(np.concatenate([gram_hashes(self.codes[row], k) for row in ids]))
            table = np.zeros(1 << max(12, int(len(hashes) * 16).bit_length()), dtype=bool)
            table[(hashes & np.uint64(len(table) - 1)).astype(np.int64)] = True
            self.by_length[k] = hashes, table

    def scan(self, docs: list[list[bytes]]) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """For each document with verified hits: word ranges and the items they come from."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for words in docs for w in (*words, b"")], dtype=np.int64)  # b"" keeps texts apart
        first = np.cumsum([0] + [len(words) + 1 for words in docs])
        found: dict[int, tuple[list[tuple[int, int]], set[str]]] = defaultdict(lambda: ([], set()))
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for k, (hashes, table) in self.by_length.items():
            if len(ids) < k:
                continue
            at = np.flatnonzero(known[k:] - known[:-k] == k)  # all words occur in the benchmark
            if not len(at):
                continue
            value = np.zeros(len(at), dtype=np.uint64)
            with np.errstate(over="ignore"):
                for q, factor in enumerate(seeds(k, 4321)):
                    value += self.codes[ids[at + q]] * factor
                value = mix(value)
            maybe = table[(value & np.uint64(len(table) - 1)).astype(np.int64)]
            at, value = at[maybe], value[maybe]
            at = at[hashes[np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)] == value]
            for position in at.tolist():
                doc = int(np.searchsorted(first, position, side="right")) - 1
                start = position - int(first[doc])
                if items := self.owners.get(tuple(docs[doc][start : start + k])):
                    found[doc][0].append((start, start + k))
                    found[doc][1].update(items)
        return found


def _blocks(benchmark: DataFrame, id_column: str, text_column: str):
    """The benchmark in blocks of bounded size, each collected when its turn comes."""
    items = benchmark.select(F.col(id_column).cast("string").alias("i"), F.coalesce(F.col(text_column), F.lit("")).alias("t"))
    size = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield k == n - 1, [(r.i, r.t.encode()) for r in part.collect()]


_MEASURES = (("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string"), ("contaminated", "boolean"))


def _scan(docs: DataFrame, benchmark: DataFrame, text_column: str, id_column: str, item_text: str, window: int, finish, schema: T.StructType) -> DataFrame:
    """Scan ``docs`` against all blocks; ``finish(batch, words, ranges, items)`` makes the rows of the last one."""
    names = docs.columns
    at, whose = free_name(names, "__ranges"), free_name(names, "__items")
    now, first = docs, True
    for last, items in _blocks(benchmark, id_column, item_text):
        grams = docs.sparkSession.sparkContext.broadcast(GramSet(items, window))

        def step(batches, grams=grams, first=first, last=last):
            for batch in row_slices(batches, text_column):
                words = [words_of(x) for x in text_bytes(batch, text_column)]
                found = grams.value.scan(words)
                ranges = [found[k][0] if k in found else [] for k in range(len(words))]
                owners = [found[k][1] if k in found else set() for k in range(len(words))]
                if not first:
                    for k, (r, o) in enumerate(zip(column(batch, at).to_pylist(), column(batch, whose).to_pylist(), strict=True)):
                        ranges[k] = ranges[k] + list(zip(r[::2], r[1::2], strict=True))
                        owners[k] = owners[k] | set(o)
                rows = batch.select(names)
                if last:
                    yield finish(rows, words, ranges, owners)
                else:
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns, pa.array([[x for ab in r for x in ab] for r in ranges], pa.list_(pa.int32())), pa.array([sorted(o) for o in owners], pa.list_(pa.string()))],
                        schema=pa.schema([*rows.schema, pa.field(at, pa.list_(pa.int32())), pa.field(whose, pa.list_(pa.string()))]),
                    )

        more = T.StructType([*docs.schema.fields, T.StructField(at, T.ArrayType(T.IntegerType())), T.StructField(whose, T.ArrayType(T.StringType()))])
        now = now.mapInArrow(step, schema if last else more)
        now, first = now if last else stored(now, "decontaminate"), False
    return now


def _covered(n: int, ranges: list[tuple[int, int]]) -> np.ndarray:
    steps = np.zeros(n + 1, dtype=np.int64)
    for a, b in ranges:
        steps[a] += 1
        steps[b] -= 1
    return np.cumsum(steps)[:n] > 0


def _measure(words: list[bytes], ranges: list[tuple[int, int]], items: set[str]) -> tuple:
    hit = int(_covered(len(words), ranges).sum()) if ranges else 0
    return len(words), hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hit > 0 and 20 * hit >= len(words)


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_column: str = "text", id_column: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Columns ``keep`` of every document, with how much of it repeats the benchmark.

    Adds n_words, n_hit, n_items, items_sha256 and contaminated. A null or empty
    text has no words and is clean. Items without words have no windows; items
    are told apart by their id (null counts as an empty id), so repeated items
    count once. Repeated documents give repeated rows. Without documents there
    are no rows, without items every document is clean. Kept columns may have
    any names but those that are added.
    """
    text = free_name(keep, "__text")
    taken = docs.select(*keep, F.col(text_column).alias(text))
    fields = [f for f in taken.schema.fields if f.name != text]
    schema = T.StructType([*fields, *[T.StructField(n, T._parse_datatype_string(t)) for n, t in _MEASURES]])

    def finish(batch, words, ranges, owners):
        rows = [_measure(*x) for x in zip(words, ranges, owners, strict=True)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([*[column(batch, f.name) for f in fields], *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names=schema.names)

    return _scan(taken, benchmark, text, id_column, item_text, window, finish, schema)


def _without(raw: bytes, ranges: list[tuple[int, int]]) -> str:
    places = [m.span() for m in _WORD.finditer(raw.lower())]
    hit = _covered(len(places), ranges)
    out, at = [], 0
    for (a, b), gone in zip(places, hit.tolist(), strict=True):
        if gone:
            out.append(raw[at:a])
            at = b
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text_column: str = "text", id_column: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without its contaminated documents, or (``mode="spans"``) without the repeated words.

    All columns are kept as they are, whatever their names. Clean documents come
    back unchanged; null texts stay null. Without documents there are no rows,
    without items all documents stay.
    """

    def finish(batch, words, ranges, owners):
        if mode == "documents":
            clean = [not _measure(*x)[4] for x in zip(words, ranges, owners, strict=True)]
            return batch.filter(pa.array(clean, pa.bool_()))
        at = batch.schema.get_field_index(text_column)
        old = batch.column(at).to_pylist()
        new = [_without(t.encode(), r) if r else t for t, r in zip(old, ranges, strict=True)]
        return batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    if mode not in ("documents", "spans"):
        raise ValueError("mode is documents or spans")
    return _scan(docs, benchmark, text_column, id_column, item_text, window, finish, docs.schema)
