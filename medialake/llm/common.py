"""Helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python task holds decoded at once; Arrow batches are cut to this.
SLICE_ROWS = 256
#: ... or fewer, so that a slice of long texts stays near this many bytes.
SLICE_BYTES = 1 << 20

_MASK = (1 << 64) - 1


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is missing in local mode (tests, a laptop) a temporary
    folder is made once and kept in the session's settings; a cluster without it
    is an error, as other machines would not see such a folder.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("medialake.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("medialake.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, **options) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor later costs no recomputation.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_slices(batches: Iterable[pa.RecordBatch], column: str = "text", rows: int = SLICE_ROWS, room: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that neither rows nor text bytes (but for one long text) pass the bounds by much."""
    for batch in batches:
        size = max(1, batch.num_rows)
        mean = batch.column(batch.schema.get_field_index(column)).nbytes / size
        step = int(max(1, min(rows, room // max(1.0, mean))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores before it until no column is called so."""
    known = {name.lower() for name in taken}
    while wanted.lower() in known:
        wanted = f"_{wanted}"
    return wanted


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The strings of a column; null becomes the empty text."""
    return [x if x is not None else "" for x in column(batch, name).to_pylist()]


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 of a column's strings; null becomes the empty text."""
    return [x if x is not None else b"" for x in column(batch, name).cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the well-known splitmix step), on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` odd 64-bit constants derived from ``salt``."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


_BASE = int(seeds(1, 77)[0])
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    got = _POWERS.get(name)
    if got is None or len(got) < n:
        size = max(n, 1 << 20)
        got = np.full(size, base, dtype=np.uint64)
        got[0] = 1
        with np.errstate(over="ignore"):
            got = np.multiply.accumulate(got)
        _POWERS[name] = got
    return got[:n]


class Words:
    """The words of a batch of texts as 64-bit hashes, without a Python object per word.

    ``hashes`` holds all words in order, ``doc`` the text that each belongs to,
    ``first`` the index of each text's first word (one more entry at the end),
    ``start``/``end`` the byte positions in ``buffer``.
    """

    #: Blank and the five control characters from tab to carriage return.
    SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])

    def __init__(self, items: list[bytes], lower: bool = False) -> None:
        self.buffer = buffer = b" ".join(items) + b" "
        raw = np.frombuffer(buffer, dtype=np.uint8)
        table = seeds(256, 1234)
        if lower:
            table = table.copy()
            table[65:91] = table[97:123]
        space = self.SPACE[raw]
        flips = np.flatnonzero(np.diff(space, prepend=True, append=True))
        self.start, self.end = flips[::2], flips[1::2]
        with np.errstate(over="ignore"):
            sums = np.empty(len(raw) + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum(table[raw] * _powers("up", _BASE, len(raw)), out=sums[1:])
            self.hashes = mix((sums[self.end] - sums[self.start]) * _powers("down", _INVERSE, len(raw) + 1)[self.start])
        edges = np.cumsum([0] + [len(x) + 1 for x in items])
        self.first = np.searchsorted(self.start, edges)
        self.doc = np.repeat(np.arange(len(items)), np.diff(self.first))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all runs of ``k`` words, one per word position that has one; runs may cross texts."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        return gram_hashes(self.hashes, k)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for q, factor in enumerate(seeds(k, 4321)):
            out += hashes[q : q + n] * factor
        return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def keyed_anew(sums: DataFrame, key: str) -> DataFrame:
    """``sums``, one row a key, without the partitioning that its aggregate left.

    A join of it with the rows of the keys then exchanges both sides, so that
    adaptive execution can split the partition of a key with very many rows.
    """
    return sums.withColumn(key, -(-F.col(key)))


def components(edges: DataFrame, label: str) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, root)`` with the smallest node as root.

    Alternates large-star and small-star steps, which need a number of rounds
    that is logarithmic in the number of nodes. Each round is written to the
    shared folder, so neither lineage nor driver memory grows with the graph.
    Grouping keys are pre-aggregated and joins are left to the adaptive
    planner, which splits the partition of a very large star.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = keyed_anew(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "u")
        large = stored(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), label)
        low2 = keyed_anew(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low2.select("u", F.col("m").alias("v"))).distinct()
        now = stored(small, label)
        state = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.sum("v").alias("s")).first()
        if state == before or not state.n:
            return stored(now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node"), label)
        before = state
