"""Substring dedup: an FM-index per shard over wavelet-coded words, streamed for matching statistics.

A window of thirteen words is removed from a document when it also starts in a
document with a smaller id. The corpus is cut into shards by content, so that
equal windows always meet: every window is filed under the smallest hash among
its word k-grams (its anchor), and neighbouring windows with one anchor travel
as one segment. Anchors that only one text has cannot hold a repeat and are left
behind before any text moves. Each shard indexes its distinct segments in a
compressed FM-index; backward search over the wavelet matrix gives, for every
segment position, how far the words before it match, and every interval of at
least thirteen words reports the smallest document that holds it. The windows
of an anchor with very many words around it are filed one by one under all
their thirteen words instead, where the smallest document is a plain minimum.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, column, gram_hashes, keyed_anew, row_slices, stored, text_bytes

WINDOW = 13
#: Words in the k-grams whose smallest hash is a window's anchor.
ANCHOR_WORDS = 4
#: Words in one FM-index; a shard with more is indexed block by block.
BLOCK_WORDS = 400_000
#: Words around one anchor that still make a part of one shard; beyond, its windows are filed singly.
ANCHOR_LIMIT = 20_000
#: Windows searched at once.
SEARCH_WINDOWS = 100_000


class WaveletMatrix:
    """Rank over a sequence of small integers: one bit vector a level, packed in 64-bit words with running counts."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.n, self.levels = len(symbols), max(1, int(size - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bits = (now >> level & 1).astype(np.uint8)
            packed = np.packbits(np.pad(bits, (0, -len(bits) % 64 + 64)), bitorder="little").view("<u8")
            counts = np.zeros(len(packed) + 1, dtype=np.int32)
            np.cumsum(np.bitwise_count(packed), out=counts[1:])
            self.words.append(packed)
            self.counts.append(counts)
            self.zeros.append(int(self.n - counts[-1]))
            now = np.concatenate([now[bits == 0], now[bits == 1]])
        every = np.arange(size)
        self.origin = self._descend(every, np.zeros(size, dtype=np.int64))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][block] + np.bitwise_count(self.words[level][block] & mask)

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            ones = self._ones(level, at)
            bit = symbols >> (self.levels - 1 - level) & 1
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._descend(symbols, at) - self.origin[symbols]


def suffix_order(text: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes of ``text`` in order, by doubling; suffixes equal over ``longest`` symbols stay in order of position."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], np.diff(text[order]) != 0]))
    h = 1
    while h < longest and rank[order[-1]] < n - 1:
        second = np.concatenate([rank[h:] + 1, np.zeros(min(h, n), dtype=np.int64)])[:n]
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        h *= 2
    return order


class FMIndex:
    """Segments of word hashes with an owner each; finds the smallest owner of any window."""

    def __init__(self, segments: list[np.ndarray], owners: np.ndarray) -> None:
        self.alphabet = np.unique(np.concatenate(segments))
        lengths = np.array([len(s) + 1 for s in segments])
        ends = np.cumsum(lengths) - 1
        codes = np.searchsorted(self.alphabet, np.concatenate(segments)) + len(segments)
        text = np.empty(int(lengths.sum()), dtype=np.int64)
        inside = np.ones(len(text), dtype=bool)
        inside[ends] = False
        text[inside] = codes
        text[ends] = np.arange(len(segments))  # a separator of its own ends every segment
        order = suffix_order(text, int(lengths.max()))
        owner = np.repeat(owners, lengths)[order]
        last = text[order - 1]
        last = np.where(last < len(segments), 0, last - len(segments) + 1)  # separators are one symbol in the transform
        self.size = len(self.alphabet) + 1
        counts = np.bincount(last, minlength=self.size)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.tree, self.owner = WaveletMatrix(last, self.size), owner

    def encode(self, words: np.ndarray) -> np.ndarray:
        """Symbols of word hashes, 0 for words that the index lacks."""
        at = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == words, at + 1, 0)

    def matching(self, words: np.ndarray, ends: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics: for each end position the number of words before it, up to ``longest``, that occur as one run.

        Also the interval of the suffix order that holds the run. All positions
        step backwards together; those whose interval empties drop out.
        """
        symbols = self.encode(words)
        low, high = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), self.tree.n, dtype=np.int64)
        length, alive = np.zeros(len(ends), dtype=np.int64), np.arange(len(ends))
        for step in range(longest):
            c = symbols[ends[alive] - 1 - step]
            a, b = self.tree.rank(np.concatenate([c, c]), np.concatenate([low[alive], high[alive]])).reshape(2, -1) + self.before[c]
            on = (c > 0) & (a < b)
            alive = alive[on]
            low[alive], high[alive] = a[on], b[on]
            length[alive] = step + 1
            if not len(alive):
                break
        return length, low, high

    def smallest_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest owner in each interval; intervals of runs of one length are equal or disjoint."""
        start, back = np.unique(low, return_inverse=True)
        stop = np.zeros(len(start), dtype=np.int64)
        stop[back] = high
        cuts = np.stack([start, stop], axis=1).ravel()
        padded = np.concatenate([self.owner, [np.iinfo(np.int64).max]])
        return np.minimum.reduceat(padded, cuts)[::2][back]


def window_owners(segments: list[np.ndarray], owners: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each segment, the smallest owner of each of its windows among all segments.

    The segments are indexed in blocks of bounded size, and all of them are
    streamed against every block.
    """
    out = [np.full(len(s) - window + 1, np.iinfo(np.int64).max, dtype=np.int64) for s in segments]
    sizes = np.array([len(s) for s in segments])
    block = np.cumsum(sizes) // BLOCK_WORDS
    for k in range(int(block[-1]) + 1):
        own = np.flatnonzero(block == k)
        if not len(own):
            continue
        index = FMIndex([segments[i] for i in own], owners[own])
        at = 0
        while at < len(segments):
            upto = at + 1
            total = len(out[at])
            while upto < len(segments) and total + len(out[upto]) <= SEARCH_WINDOWS:
                total += len(out[upto])
                upto += 1
            words = np.concatenate(segments[at:upto])
            first = np.cumsum([0] + [len(s) for s in segments[at:upto]])
            ends = np.concatenate([np.arange(a + window, b + 1) for a, b in zip(first[:-1], first[1:], strict=True)])
            length, low, high = index.matching(words, ends, window)
            hit = length >= window
            got = np.full(len(ends), np.iinfo(np.int64).max, dtype=np.int64)
            if hit.any():
                got[hit] = index.smallest_owner(low[hit], high[hit])
            for i, part in zip(range(at, upto), np.split(got, np.cumsum([len(out[i]) for i in range(at, upto)])[:-1]), strict=True):
                np.minimum(out[i], part, out=out[i])
            at = upto
    return out


def anchors(words: Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (text, anchor, first window, windows); windows count from the text's first word."""
    empty = np.empty(0, dtype=np.int64)
    n = len(words.hashes)
    if n < window:
        return empty, empty.astype(np.uint64), empty, empty
    low = gram_hashes(words.hashes, ANCHOR_WORDS)
    left, width = window - ANCHOR_WORDS + 1, 1
    while width < left:  # sliding minimum by doubling
        step = min(width, left - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    at = np.flatnonzero(words.doc[: n - window + 1] == words.doc[window - 1 :])  # inside one text
    if not len(at):
        return empty, empty.astype(np.uint64), empty, empty
    value, doc = low[at], words.doc[at]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])])
    starts = np.flatnonzero(new)
    return doc[starts], value[starts], at[starts] - words.first[doc[starts]], np.diff(np.append(starts, len(at)))


def _digest(raw: bytes) -> tuple[int, int]:
    """A 96-bit name as two signed numbers."""
    return struct.unpack("<qi", hashlib.blake2b(raw, digest_size=12).digest())


#: The parts of a text's and of a segment's name, of 64 and 32 bits: two of 10^11 share one with a chance below 10^-6.
TEXT, SEGMENT = ["mark", "mark2"], ["segment", "segment2"]


#: Marks of texts that a task remembers, so that copies beside each other send their anchors once.
SEEN_TEXTS = 200_000


def _anchor_rows(base: DataFrame) -> DataFrame:
    """``anchor, mark, mark2, place`` of the texts; ``place`` packs the first window and the number of windows."""

    def rows(batches):
        seen: set[tuple[int, int]] = set()
        for batch in row_slices(batches):
            marks = [column(batch, c).to_numpy() for c in TEXT]
            raw = text_bytes(batch)
            new = [k for k, m in enumerate(zip(*(m.tolist() for m in marks), strict=True)) if not (m in seen or seen.add(m))]
            if len(seen) > SEEN_TEXTS:
                seen.clear()
            doc, anchor, at, count = anchors(Words([raw[k] for k in new])) if new else (np.empty(0, dtype=np.int64),) * 4
            own = [m[np.array(new, dtype=np.int64)][doc] for m in marks]
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), *map(pa.array, own), pa.array(at << 32 | count)], names=["anchor", *TEXT, "place"])

    return base.select(*TEXT, "text").mapInArrow(rows, "anchor long, mark long, mark2 long, place long")


def _segments(found: DataFrame) -> DataFrame:
    """The segments of texts at given places, with their words as 64-bit hashes.

    A segment of a hot anchor is given window by window, each named and anchored
    by the digest of its words, which it does not carry.
    """

    def rows(batches):
        for batch in row_slices(batches):
            words = Words(text_bytes(batch))
            out: tuple[list, ...] = ([], [], [], [], [], [], [], [], [])
            for k, (*whose, places) in enumerate(zip(*(column(batch, c).to_pylist() for c in ("key", *TEXT, "doc_id", "places")), strict=True)):
                own = words.hashes[words.first[k] : words.first[k + 1]]
                for p in places:
                    at, count = p["place"] >> 32, p["place"] & 0xFFFFFFFF
                    if p["hot"]:
                        for i in range(at, at + count):
                            name = _digest(own[i : i + WINDOW].tobytes())
                            for c, v in zip(out, (*whose, i, name[0], *name, b""), strict=True):
                                c.append(v)
                        continue
                    raw = own[at : at + count + WINDOW - 1].tobytes()
                    for c, v in zip(out, (*whose, at, p["anchor"], *_digest(raw), raw), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out[:8]], pa.array(out[8], pa.binary())], names=["key", *TEXT, "doc_id", "at", "anchor", *SEGMENT, "words"])

    return found.select("key", *TEXT, "doc_id", "places", "text").mapInArrow(rows, "key long, mark long, mark2 long, doc_id long, at long, anchor long, segment long, segment2 long, words binary")


def _search(distinct: DataFrame) -> DataFrame:
    """Index and search the shards: ``segment, segment2, owners`` (64-bit, one per window).

    A single window without words has met all its equals by name already.
    """

    def solve(held):
        *names, ids, words = zip(*held, strict=True)
        owners = window_owners([np.frombuffer(w, dtype=np.uint64) for w in words], np.array(ids, dtype=np.int64))
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in names], pa.array([x.tobytes() for x in owners], pa.binary())], names=[*SEGMENT, "owners"])

    def rows(batches):
        held, size, last = [], 0, None
        for batch in batches:
            single = pc.equal(pc.binary_length(column(batch, "words")), 0)
            alone = batch.filter(single)
            if alone.num_rows:
                yield pa.RecordBatch.from_arrays([*[column(alone, c) for c in SEGMENT], pa.array([o.tobytes() for o in column(alone, "owner").to_numpy()], pa.binary())], names=[*SEGMENT, "owners"])
            batch = batch.filter(pc.invert(single))
            for anchor, *names, owner, words in zip(*(column(batch, c).to_pylist() for c in ("anchor", *SEGMENT, "owner", "words")), strict=True):
                if size >= BLOCK_WORDS and anchor != last:  # equal windows share an anchor, so shards end between anchors
                    yield solve(held)
                    held, size = [], 0
                held.append((*names, owner, words))
                size += len(words) // 8
                last = anchor
        if held:
            yield solve(held)

    return distinct.select("anchor", *SEGMENT, "owner", "words").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(rows, "segment long, segment2 long, owners binary")


def _repeated(placed: DataFrame) -> DataFrame:
    """Segments with the owners of their windows, reduced to the windows that a smaller document owns."""

    def rows(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for *whose, doc_id, at, owners in zip(*(column(batch, c).to_pylist() for c in ("key", *TEXT, "doc_id", "at", "owners")), strict=True):
                gone = np.flatnonzero(np.frombuffer(owners, dtype=np.int64) < doc_id)
                if len(gone):
                    for c, v in zip(out, (*whose, (gone + at).astype(np.int32).tobytes()), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.binary())], names=["key", *TEXT, "gone"])

    return placed.select("key", *TEXT, "doc_id", "at", "owners").mapInArrow(rows, "key long, mark long, mark2 long, gone binary")


def repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, text, copy, gone`` of all documents.

    ``copy`` says that a smaller document has the very text, ``gone`` packs the
    starts of windows that smaller documents have (32-bit, in no order). The
    text moves once: both uses of it read the same exchange.
    """
    base = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    base = base.select(F.xxhash64("doc_id").alias("key"), F.xxhash64("text").alias("mark"), F.hash("text").cast("long").alias("mark2"), "doc_id", "text")
    known = base.where("doc_id IS NOT NULL").select("key", *TEXT, "doc_id")
    first = known.groupBy(*TEXT).agg(F.min("doc_id").alias("first_id"))
    # keyed anew, so that adaptive execution can split the partition of a text with very many copies
    copies = known.join(keyed_anew(first, "mark"), TEXT).where("doc_id > first_id").select("key", *TEXT, F.lit(True).alias("copy")).distinct()
    # both uses of the anchors read one exchange; no task gathers the rows of an anchor
    every = _anchor_rows(base.where("doc_id IS NOT NULL")).repartition("anchor")
    words = F.sum(F.col("place").bitwiseAND(0xFFFFFFFF) + (WINDOW - 1))
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in TEXT for f in (F.min, F.max)]
    shared = every.groupBy("anchor").agg(*ends, words.alias("words")).where("min_mark <> max_mark OR min_mark2 <> max_mark2").select("anchor", (F.col("words") > ANCHOR_LIMIT).alias("hot"))
    places = every.join(shared.hint("merge"), "anchor").groupBy(*TEXT).agg(F.collect_set(F.struct("place", "anchor", "hot")).alias("places"))
    places = stored(places.join(first, TEXT).select(F.xxhash64("first_id").alias("key"), *TEXT, "places"), "places")
    segments = _segments(places.join(base, ["key", *TEXT]))
    distinct = segments.groupBy("anchor", *SEGMENT).agg(F.min("doc_id").alias("owner"), F.first("words").alias("words"))
    gone = _repeated(segments.select("key", *TEXT, "doc_id", "at", *SEGMENT).join(_search(distinct), SEGMENT))
    gone = gone.groupBy("key", *TEXT).agg(F.collect_list("gone").alias("gone"))
    return base.join(gone, ["key", *TEXT], "left").join(copies, ["key", *TEXT], "left").select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "gone")


def kept_words(raw: bytes, copy: bool, gone: list[bytes] | None, window: int = WINDOW) -> tuple[int, list[bytes]]:
    """How many words a text has and those that stay."""
    words = raw.translate(_BLANKS).split(b" ")
    words = [w for w in words if w]
    if copy and len(words) >= window:
        return len(words), []
    if not gone:
        return len(words), words
    starts = np.frombuffer(b"".join(gone), dtype=np.int32)
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    stay = np.cumsum(steps)[:-1] == 0
    return len(words), [w for w, s in zip(words, stay.tolist(), strict=True) if s]


#: Tab to carriage return become blanks.
_BLANKS = bytes(32 if 9 <= b <= 13 else b for b in range(256))


def drop_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, text`` with the words that stay, joined by single blanks."""

    def rows(batches):
        for batch in row_slices(batches):
            kept = [b" ".join(kept_words(*x)[1]).decode() for x in zip(text_bytes(batch), column(batch, "copy").to_pylist(), column(batch, "gone").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(kept, pa.string())], names=["doc_id", "text"])

    return repeats(docs, id_column, text_column).mapInArrow(rows, "doc_id long, text string")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document ``doc_id, n_words, n_removed, kept_sha256`` after removing repeated windows.

    Windows are judged on the input. Documents with the same id do not remove
    from each other. A null id owns no window and loses none; a null text has no
    words. Repeated rows give repeated rows; texts below thirteen words are kept.
    Other columns are not looked at.
    """

    def rows(batches):
        for batch in row_slices(batches):
            out: tuple[list, list, list] = ([], [], [])
            for x in zip(text_bytes(batch), column(batch, "copy").to_pylist(), column(batch, "gone").to_pylist(), strict=True):
                n, kept = kept_words(*x)
                for c, v in zip(out, (n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return repeats(docs, id_column, text_column).mapInArrow(rows, "doc_id long, n_words long, n_removed long, kept_sha256 string")
