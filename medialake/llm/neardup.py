"""MinHash near-duplicates with an LSH forest of sorted signature orders.

Every distinct set of shingles gets a signature of minimum hashes. A tree of the
forest sorts all sets by the signature read from a place of its own, in ranges
over all tasks, ties by node, so that no run of equal beginnings is one task's.
In a sorted order the sets that share the longest prefix with a set are its
neighbours; these are the first candidates, two a set and tree at most. Sets
that share the first few hashes of a tree form a region. What the neighbours
did not link is paired inside the regions, across the parts linked so far: at
the depth where a region is of moderate size, so dense regions go deeper. Sets
of regions that were dense at the first depth may have near sets elsewhere in
them; they are joined once more, exactly, by a prefix filter over their full
sets. Every candidate is confirmed on the full sets.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, column, components, mix, row_slices, seeds, stored, text_bytes

SHINGLE = 5
THRESHOLD = 0.85
#: Trees of the forest, and how many hashes of the signature lie between the starts of two of them.
TREES, STEP = 20, 6
HASHES = TREES * STEP
#: Hashes that a tree sorts by; beyond its own it reads on in the signature, around its end.
SORTED = 8
#: A region makes at most this many pairs, or :data:`MEMBER_PAIRS` a member, before it is followed to longer prefixes.
REGION_PAIRS, MEMBER_PAIRS = 200, 8
#: Counters of the sketch that orders shingles by frequency: between these powers of two, about four a shingle.
SKETCH_BITS = (16, 26)
#: Counters in one block of the sketch.
BLOCK = 1 << 16


def shallow(percent: int) -> int:
    """The prefix that makes two sets candidates: the longest that sets at the threshold miss in all trees once in a million."""
    fits = [d for d in range(1, STEP + 1) if (1 - (percent / 100) ** d) ** TREES <= 1e-6]
    return max(fits, default=1)


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text by text, and how many each text has."""
    n = len(words.hashes)
    per_doc = np.diff(words.first)
    k = SHINGLE
    if n >= k:
        grams = words.grams(k)
        inside = words.doc[: n - k + 1] == words.doc[k - 1 :]
        doc, value = words.doc[: n - k + 1][inside], grams[inside]
    else:
        doc, value = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    short = np.flatnonzero((per_doc > 0) & (per_doc < k))
    if len(short):  # the whole sequence is the only shingle; its length keeps it apart from others
        whole = []
        for d in short.tolist():
            own = words.hashes[words.first[d] : words.first[d + 1]]
            with np.errstate(over="ignore"):
                whole.append(mix((own * seeds(k, 99)[: len(own)]).sum(keepdims=True) + np.uint64(len(own)))[0])
        doc, value = np.concatenate([doc, short]), np.concatenate([value, np.array(whole, dtype=np.uint64)])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return value[new], np.bincount(doc[new], minlength=len(per_doc))


def signatures(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """:data:`HASHES` minimum hashes of every non-empty set, one row a set."""
    own = counts[counts > 0]
    starts = np.concatenate([[0], np.cumsum(own)[:-1]]).astype(np.int64)
    out = np.empty((len(own), HASHES), dtype=np.uint32)
    factors, shifts = seeds(HASHES, 555), seeds(HASHES, 777)
    with np.errstate(over="ignore"):
        for j in range(HASHES):
            out[:, j] = np.minimum.reduceat((values * factors[j] + shifts[j]) >> np.uint64(32), starts)
    return out


def set_names(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """128-bit names of the sets, as two rows of signed 64-bit halves; 0 for empty sets."""
    names = np.zeros((2, len(counts)), dtype=np.uint64)
    full = np.flatnonzero(counts > 0)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]]).astype(np.int64)
        with np.errstate(over="ignore"):
            names[0, full] = np.add.reduceat(mix(values), starts)
            names[1, full] = np.add.reduceat(mix(values ^ np.uint64(0x5DEECE66D)), starts)
    return names.view(np.int64)


def _set_rows(base: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b, signature``: the set's 128-bit name and its minimum hashes."""

    def rows(batches):
        for batch in row_slices(batches):
            values, counts = shingles(Words(text_bytes(batch), lower=True))
            names = set_names(values, counts)
            signature: list[bytes | None] = [None] * batch.num_rows
            full = np.flatnonzero(counts > 0)
            if len(full):
                for k, row in zip(full.tolist(), signatures(values, counts), strict=True):
                    signature[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(counts.astype(np.int64)), pa.array(names[0]), pa.array(names[1]), pa.array(signature, pa.binary())], names=["doc_id", "n_shingles", "set_a", "set_b", "signature"])

    return base.mapInArrow(rows, "doc_id long, n_shingles long, set_a long, set_b long, signature binary")


def _readings(batch: pa.RecordBatch, depth: int) -> np.ndarray:
    """The first ``depth`` minimum hashes of every set in every tree: sets x trees x depth."""
    sig = np.frombuffer(b"".join(column(batch, "signature").to_pylist()), dtype=np.uint32).reshape(batch.num_rows, HASHES)
    places = (np.arange(TREES)[:, None] * STEP + np.arange(depth)[None, :]) % HASHES
    return sig[:, places]


def _region_names(read: np.ndarray, trees: np.ndarray) -> np.ndarray:
    """64-bit names of the regions that prefixes ``read`` (rows x depth) of ``trees`` belong to."""
    with np.errstate(over="ignore"):
        return mix((read.astype(np.uint64) * seeds(SORTED, 31337)[: read.shape[1]]).sum(axis=1) + seeds(TREES, 4242)[trees]).view(np.int64)


def _order_keys(sets: DataFrame) -> DataFrame:
    """``node, n, key``: for each set and tree, the tree's number and the hashes that it sorts by, as bytes that sort alike."""

    def rows(batches):
        for batch in batches:
            read = np.ascontiguousarray(_readings(batch, SORTED), dtype=">u4")
            keys = np.empty((batch.num_rows, TREES, 1 + 4 * SORTED), dtype=np.uint8)
            keys[:, :, 0] = np.arange(TREES)
            keys[:, :, 1:] = read.view(np.uint8).reshape(batch.num_rows, TREES, 4 * SORTED)
            width = keys.shape[2]
            offsets = pa.array(np.arange(batch.num_rows * TREES + 1, dtype=np.int32) * width)
            packed = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows * TREES, [None, offsets.buffers()[1], pa.py_buffer(keys.tobytes())])
            yield pa.RecordBatch.from_arrays([*[pa.array(np.repeat(column(batch, c).to_numpy(), TREES)) for c in ("node", "n")], packed], names=["node", "n", "key"])

    return sets.select("node", "n", "signature").mapInArrow(rows, "node long, n long, key binary")


#: The region of a row at three depths, the widest first.
REGIONS = ["wide", "middle", "narrow"]


def region_depths(percent: int) -> list[int]:
    """How many hashes the sets of a region share, for each of :data:`REGIONS`."""
    return [shallow(percent), (shallow(percent) + SORTED) // 2, SORTED]


def _neighbours(ordered: DataFrame, depths: list[int]) -> DataFrame:
    """Rows of the sorted orders that have a neighbour in their widest region: ``part, edge, node, n, wide, middle, narrow, mate, mate_n``.

    ``mate`` is the row before, if it shares the first hashes: no set of the
    order shares a longer prefix. The first and the last row of a
    partition are always given (``edge`` 1 and 2), as their neighbours may lie
    in the partitions beside.
    """

    depth = depths[0]

    def rows(batches):
        part = TaskContext.get().partitionId()
        held = None  # the row before, whose follower is not known yet: node, n, key, mate, mate_n, edge

        def out(nodes, sizes, keys, mates, mate_sizes, edges):
            regions = [pa.array(_region_names(keys[:, 1 : 1 + 4 * d].copy().view(">u4"), keys[:, 0].astype(np.int64))) for d in depths]
            absent = mates < 0
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), part, dtype=np.int32)), pa.array(edges), pa.array(nodes), pa.array(sizes), *regions, pa.array(mate_ids(nodes, mates), mask=absent), pa.array(mate_sizes, mask=absent)], names=["part", "edge", "node", "n", *REGIONS, "mate", "mate_n"])

        def mate_ids(nodes, mates):
            return np.where(mates < 0, 0, pool[np.maximum(mates, 0)])

        pool = np.empty(0, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes, sizes = column(batch, "node").to_numpy(), column(batch, "n").to_numpy()
            keys = np.frombuffer(b"".join(column(batch, "key").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
            first = held is None
            if not first:
                nodes, sizes, keys = np.concatenate([held[0], nodes]), np.concatenate([held[1], sizes]), np.concatenate([held[2], keys])
            same = np.zeros(len(nodes) + 1, dtype=bool)  # whether a row is in the region of the row before
            same[1:-1] = (keys[1:, : 1 + 4 * depth] == keys[:-1, : 1 + 4 * depth]).all(axis=1)
            pool = np.concatenate([[held[3] if not first else 0], nodes])
            mates = np.where(same[:-1], np.arange(len(nodes)), -1)  # places in the pool: the row before
            mate_sizes = np.concatenate([[0], sizes[:-1]])
            edges = np.zeros(len(nodes), dtype=np.int32)
            if first:
                edges[0] = 1
            else:
                edges[0] = held[5]
                if held[3] is not None and held[4] >= 0:
                    mates[0], mate_sizes[0] = 0, held[4]
            keep = (same[:-1] | same[1:]) | (edges > 0) | (mates >= 0)
            keep[-1] = False
            if keep.any():
                yield out(nodes[keep], sizes[keep], keys[keep], mates[keep], mate_sizes[keep], edges[keep])
            k = len(nodes) - 1
            held = (nodes[k:], sizes[k:], keys[k:], int(pool[mates[k]]) if mates[k] >= 0 else 0, int(mate_sizes[k]) if mates[k] >= 0 else -1, int(edges[k]))
        if held is not None:
            pool = np.array([held[3]])
            end = (held[0], held[1], held[2], np.array([0 if held[4] >= 0 else -1]), np.array([max(0, held[4])]))
            if held[5]:
                yield out(*end, np.array([1], dtype=np.int32))
            yield out(*end, np.array([2], dtype=np.int32))

    return ordered.mapInArrow(rows, "part int, edge int, node long, n long, wide long, middle long, narrow long, mate long, mate_n long")


def _neighbour_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct neighbours ``a, b`` of one region whose sizes allow the threshold, those across partitions too."""
    ends = rows.where("edge > 0").select("part", "edge", "node", "n", "wide")
    before = Window.orderBy("part", "edge")  # two rows a partition
    across = ends.select("part", "node", "n", "wide", *[F.lag(c).over(before).alias(f"last_{c}") for c in ("part", "node", "n", "wide")])
    across = across.where("part <> last_part AND wide = last_wide").select("node", "n", F.col("last_node").alias("mate"), F.col("last_n").alias("mate_n"))
    pairs = rows.where("mate IS NOT NULL").select("node", "n", "mate", "mate_n").unionByName(across)
    near = (F.col("n") * 100 >= F.col("mate_n") * percent) & (F.col("mate_n") * 100 >= F.col("n") * percent) & (F.col("node") != F.col("mate"))
    return pairs.where(near).select(F.greatest("node", "mate").alias("a"), F.least("node", "mate").alias("b")).distinct()


def _set_bytes(base: DataFrame) -> DataFrame:
    """``node, values``: the sorted distinct shingle hashes of the texts whose set has the name asked for, packed."""

    def rows(batches):
        for batch in row_slices(batches):
            values, counts = shingles(Words(text_bytes(batch), lower=True))
            named = set_names(values, counts)
            asked = (named[0] == column(batch, "set_a").to_numpy()) & (named[1] == column(batch, "set_b").to_numpy())
            raw = memoryview(values.tobytes())
            ends = np.cumsum(counts) * 8
            packed = [bytes(raw[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "node"), pa.array(packed, pa.binary())], names=["node", "values"]).filter(pa.array(asked))

    return base.mapInArrow(rows, "node long, values binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""

    def rows(batches):
        last, known = None, None
        for batch in batches:
            keep = []
            for b, x, y in zip(column(batch, "b").to_pylist(), column(batch, "x").to_pylist(), column(batch, "y").to_pylist(), strict=True):
                if b != last:
                    last, known = b, np.frombuffer(y, dtype=np.uint64)
                own = np.frombuffer(x, dtype=np.uint64)
                small, large = (own, known) if len(own) <= len(known) else (known, own)
                if 100 * len(small) < percent * len(large):
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                keep.append(100 * both >= percent * (len(own) + len(known) - both))
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("values").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("values").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(rows, "a long, b long")


def _sketch(held: DataFrame, bits: int) -> np.ndarray:
    """How many of the sets have shingles of each slot (a hash's first ``bits`` bits), up to 255.

    A count is never too low for a shingle. Tasks count their own sets and send
    blocks of counters, which are summed as they stream by.
    """
    blocks = max(1, (1 << bits) // BLOCK)

    def count(batches):
        table = np.zeros(blocks * BLOCK, dtype=np.uint8)
        for batch in batches:
            for raw in column(batch, "values").to_pylist():
                slot, n = np.unique(np.frombuffer(raw, dtype=np.uint64) >> np.uint64(64 - bits), return_counts=True)
                slot = slot.astype(np.int64)
                table[slot] = np.minimum(table[slot] + n, 255)
        parts = [(k, part) for k, part in enumerate(table.reshape(blocks, BLOCK)) if part.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for _, p in parts], pa.binary())], names=["block", "counts"])

    def total(batches):
        last, held = None, None
        for batch in batches:
            for block, raw in zip(column(batch, "block").to_pylist(), column(batch, "counts").to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(raw), dtype=np.uint8).astype(np.int64)
                if block == last:
                    held = np.minimum(held + own, 255)
                    continue
                if last is not None:
                    yield one(last, held)
                last, held = block, own
        if last is not None:
            yield one(last, held)

    def one(block, counts):
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(counts.astype(np.uint8).tobytes(), 1)], pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    summed = held.select("values").mapInArrow(count, schema).repartition("block").sortWithinPartitions("block").mapInArrow(total, schema)
    out = np.zeros((blocks, BLOCK), dtype=np.uint8)
    for r in summed.collect():  # at most 2**SKETCH_BITS[1] bytes
        out[r.block] = np.frombuffer(zlib.decompress(r.counts), dtype=np.uint8)
    return out.ravel()


def _rare_shingles(held: DataFrame, percent: int) -> DataFrame:
    """``node, label, n, shingle, behind``: the rarest shingles of sets, and how many that others may share come after each.

    Two sets of a similarity of at least the threshold share one of the
    ``n - ceil(threshold * n) + 1`` shingles that come first in either, under
    any one order of all shingles. The order is by the sketch's count, then by
    hash. A shingle with a count of 1 is in one set only, so it takes its place
    in the order but needs no row, and a set with too few others is near none.
    """
    shingled = held.agg(F.sum(F.length("values") / 8).alias("n")).first().n or 0
    bits = min(SKETCH_BITS[1], max(SKETCH_BITS[0], int(4 * shingled).bit_length()))
    shared = held.sparkSession.sparkContext.broadcast(_sketch(held, bits))

    def rows(batches):
        table, empty = shared.value, np.empty(0, dtype=np.int64)
        for batch in batches:
            out: tuple[list, ...] = ([empty], [empty], [empty], [empty], [empty])
            for node, label, raw in zip(column(batch, "node").to_pylist(), column(batch, "label").to_pylist(), column(batch, "values").to_pylist(), strict=True):
                own = np.frombuffer(raw, dtype=np.uint64)
                seen = table[(own >> np.uint64(64 - bits)).astype(np.int64)]
                common, least = np.flatnonzero(seen > 1), -(-percent * len(own) // 100)
                if len(common) < least:
                    continue
                order = common[np.lexsort((own[common], seen[common]))]
                first = order[: len(common) - least + 1]
                m = len(first)
                for c, v in zip(out, (np.full(m, node), np.full(m, label), np.full(m, len(own)), own[first].view(np.int64), len(common) - 1 - np.arange(m)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["node", "label", "n", "shingle", "behind"])

    return held.select("node", "label", "values").mapInArrow(rows, "node long, label long, n long, shingle long, behind long")


def _across(shared: DataFrame, key: str, columns: list[str], near: Column | None = None) -> DataFrame:
    """Pairs of different parts that share a key; the largest part of a key needs no pairs of its own.

    ``shared`` has ``key, main, node, label`` and ``columns``; the two sides of a
    pair have them as ``xa`` and ``xb``.
    """
    side = lambda s: [F.col("node").alias(s), F.col("label").alias(f"l{s}"), *[F.col(c).alias(f"{c}{s}") for c in columns]]
    rest = shared.where("label <> main").select(key, *side("a"))
    every = shared.select(key, "main", *side("b"))
    wanted = F.expr("la <> lb AND (lb = main OR a < b)")
    pairs = rest.join(every, key).where(wanted if near is None else wanted & near)
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _open_keys(tagged: DataFrame, key: str) -> DataFrame:
    """``key, main, work, size``: keys with more than one part, the largest of these, and how many pairs they ask for at most."""
    parts = tagged.groupBy(key, "label").agg(F.count("*").alias("n"))
    sizes = parts.groupBy(key).agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    return sizes.select(key, F.col("main.label").alias("main"), ((F.col("size") - F.col("main.n")) * F.col("size")).alias("work"), "size")


def _region_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Pairs across the parts of regions, each at the first depth where it is of moderate size; the sets of regions that were not at once.

    ``rows`` has ``node, label`` and the regions of a set in each order where it
    has company. Pairs are complete for widest regions of moderate size. Larger
    ones are followed to longer prefixes, where the nearer sets remain together;
    the sets that were in one are returned, as longer prefixes may part sets
    that are near enough (None without such a region).
    """
    out = dense = None
    for key in REGIONS:
        sizes = stored(_open_keys(rows, key).withColumn("most", F.greatest(F.lit(REGION_PAIRS), F.col("size") * MEMBER_PAIRS)), "sizes")
        open_ = stored(rows.join(sizes, key), "regions")
        pairs = _across(open_.where("work <= most"), key, [])
        out = pairs if out is None else out.unionByName(pairs)
        rows = open_.where("work > most").select("node", "label", *REGIONS)
        if rows.isEmpty():
            break
        dense = stored(rows.select("node").distinct(), "dense") if dense is None else dense
    return out.distinct(), dense


def _rare_pairs(held: DataFrame, percent: int) -> DataFrame:
    """All pairs of different parts of the sets ``held(node, label, values)`` that share a rarest shingle and can be similar enough.

    The first shingle that two sets share in the common order leaves room for
    one more than come after it in either; where that stays below the overlap
    that the threshold asks for, the pair cannot be near by this shingle.
    """
    rare = stored(_rare_shingles(held, percent), "rare")
    sizes = stored(_open_keys(rare, "shingle").select("shingle", "main"), "sizes")
    shared = stored(rare.join(sizes, "shingle"), "rare")
    room = (F.least("behinda", "behindb") + 1) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    return _across(shared, "shingle", ["n", "behind"], (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent) & room)


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels(node, label)`` after joining the parts that ``links`` connect; a label is the smallest node of its part."""
    if links.isEmpty():
        return labels
    side = lambda s: labels.select(F.col("node").alias(s), F.col("label").alias(f"l{s}"))
    both = links.join(side("a"), "a").join(side("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    roots = components(both, "components").withColumnRenamed("node", "label")
    return stored(labels.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document ``doc_id, n_shingles, component_id, kept``.

    Sets are the distinct five-word shingles of the lower-cased text; shorter
    texts have their whole sequence as the only one. Sets with a Jaccard
    similarity of ``threshold`` (whole hundredths) or more are linked;
    ``component_id`` is the smallest reachable id. A null or empty text has no
    shingles and is linked with nothing. Repeated rows share a component; rows
    that have one id and different texts count by the one of them whose set has
    the smallest name. A null id is kept and has no component. An empty table
    gives no rows. Other columns are not looked at.
    """
    percent = round(100 * threshold)
    base = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    described = stored(_set_rows(base), "signatures")
    full = described.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # equal sets are one node, named by their smallest document
    named = full.groupBy("doc_id").agg(F.min(F.struct("set_a", "set_b")).alias("s"))
    named = stored(named.select("doc_id", "s.set_a", "s.set_b"), "named")
    names = stored(named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node")), "names")
    own = full.select(F.col("doc_id").alias("node"), "set_a", "set_b", F.col("n_shingles").alias("n"), "signature")
    sets = stored(own.join(names, ["set_a", "set_b", "node"], "left_semi").dropDuplicates(["set_a", "set_b", "node"]), "sets")

    ordered = _order_keys(sets).repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    rows = stored(_neighbours(ordered, region_depths(percent)), "orders")
    first = stored(_neighbour_pairs(rows, percent), "pairs")
    regions = rows.select("node", *REGIONS).distinct()

    wanted = stored(regions.select("node").distinct().join(sets.select("node", "set_a", "set_b"), "node"), "wanted")
    # one plan at every size: the sets of a large table are never small enough to be sent to all texts
    values = stored(_set_bytes(base.withColumnRenamed("doc_id", "node").join(wanted.hint("merge"), "node")).dropDuplicates(["node"]), "shingles")
    labels = wanted.select("node", F.col("node").alias("label"))  # every set is a part of its own
    labels = _relabelled(labels, stored(_confirmed(first, values, percent), "links"))

    later, dense = _region_pairs(stored(regions.join(labels, "node"), "regions"))
    later = stored(later.join(first, ["a", "b"], "left_anti"), "pairs")
    labels = _relabelled(labels, stored(_confirmed(later, values, percent), "links"))
    if dense is not None:
        held = stored(values.join(labels.join(dense, "node", "left_semi"), "node"), "dense")
        last = stored(_rare_pairs(held, percent), "pairs")
        labels = _relabelled(labels, stored(_confirmed(last, values, percent), "links"))

    parts = names.join(labels, "node", "left").select("set_a", "set_b", F.coalesce("label", "node").alias("component_id"))
    linked = named.join(stored(parts, "parts"), ["set_a", "set_b"]).select("doc_id", "component_id")
    out = described.select("doc_id", "n_shingles").join(linked, "doc_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one with the smallest id; all columns as they are.

    Rows that repeat an id stay or go together; rows with a null id stay, and so
    do documents without words. An empty table stays empty.
    """
    judged = near_duplicates(docs, id_column, text_column, threshold)
    gone = judged.where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_column] == gone["__gone"], "left_anti")
