"""Sharding by rendezvous hashing of stable record keys, in DataFrame functions only.

A record scores every shard with a hash of its key and the shard's number; the
shard with the lowest ``-ln(u) / weight`` wins. A further shard can only win
records for itself, so growing the layout moves no record between old shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAW = "key"
#: Rows that one slot range holds on average.
RANGE_ROWS = 20_000


def uniform(key: Column, shard: Column) -> Column:
    """A number in (0, 1) from the first 48 bits of md5(key#shard). A null key counts as an empty one."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("#"), shard.cast("string")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The number of the shard that ``key`` goes to, among ``len(weights)`` shards.

    Shards of weight 0 get nothing; a tie goes to the lower number.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights are at least 0 and not all 0")
    scores = [F.struct((-F.log(uniform(key, F.lit(k))) / F.lit(float(w))).alias("score"), F.lit(k).alias("shard")) for k, w in enumerate(weights) if w > 0]
    return F.array_min(F.array(*scores))["shard"]


def with_slots(rows: DataFrame, shard: str, order: list[str], ranges: int) -> DataFrame:
    """Number the rows of each shard from 0 without a gap, as column ``slot``.

    Rows are dealt out by shard and a hash of ``order``; each such range is
    numbered by itself and moved by what the ranges before it hold, so no task
    sees a whole shard.
    """
    dealt = rows.withColumn("__range", F.pmod(F.xxhash64(*order), F.lit(ranges)).cast("int"))
    own = Window.partitionBy(shard, "__range").orderBy(*order)
    before = Window.partitionBy(shard).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy(shard, "__range").agg(F.count("*").alias("__n")).select(shard, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    numbered = dealt.withColumn("__own", F.row_number().over(own) - 1)
    return numbered.join(base, [shard, "__range"]).withColumn("slot", F.col("__base") + F.col("__own")).drop("__range", "__own", "__base")


def shard_documents(docs: DataFrame, shards: int = 8, weights: list[float] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Put all documents into shards: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the text's UTF-8 bytes plus 1 (a null text has none, and the
    checksum of no bytes). Equal ids always share a shard, null ids one of their
    own kind; equal texts under different ids need not. Repeated rows are placed
    one by one. ``grown_shard`` is the shard under one shard more of weight 1
    (the mean weight, if weights are given). Other columns are not looked at.
    """
    weights = weights or [1.0] * shards
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    placed = rows.select(
        "*",
        F.lit(LAW).alias("law"),
        rendezvous(F.col("doc_id"), weights).cast("int").alias("shard"),
        rendezvous(F.col("doc_id"), [*weights, sum(weights) / len(weights)]).cast("int").alias("grown_shard"),
    )
    ranges = max(1, -(-docs.count() // (RANGE_ROWS * len(weights))))
    out = with_slots(placed, "shard", ["doc_id", "text_crc32", "size"], ranges)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
