"""Mixing sources to target weights, in DataFrame functions only.

The words of a source, its documents one behind the other, are cut into blocks
of a fixed length. Every output shard draws how many of its slots each source
fills (a multinomial draw with the targets as chances); what a source was drawn
beyond its quota goes to sources that were drawn too rarely, so that totals
meet the targets. The draws of a source are numbered, a pseudorandom
permutation of its blocks turns numbers into blocks, once through all blocks
before any comes again, and blocks and draws are joined by index.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WEIGHTS = (1.0, 2.0, 3.0)
#: How often a word can be taken at most.
REPEATS = 3
#: Words in a block.
BLOCK_WORDS = 128
#: Slots of an output shard, more where there would be over MOST_SHARDS of them.
SHARD_SLOTS, MOST_SHARDS = 1024, 1 << 16
#: Rounds of a permutation.
ROUNDS = 32

_WORD = r"[^\x20\x09-\x0D]+"


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], label: str) -> DataFrame:
    """``rows`` with the sums of columns over all rows before them in ``order``, and ``at``, which rises in that order.

    Rows are sorted by ranges; each range is summed by itself and moved by what
    the ranges before it hold, so no task sees all rows.
    """
    sorted_rows = stored(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), label).withColumn("range", F.shiftright("at", 33))
    own = Window.partitionBy("range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = sorted_rows.groupBy("range").agg(*[F.sum(c).alias(f"t_{n}") for n, c in sums.items()])
    base = totals.select("range", *[F.coalesce(F.sum(f"t_{n}").over(before), F.lit(0)).alias(f"b_{n}") for n in sums])
    own_sums = sorted_rows.withColumns({f"o_{n}": F.coalesce(F.sum(c).over(own), F.lit(0)) for n, c in sums.items()})
    out = own_sums.join(base, "range")
    return out.withColumns({n: F.col(f"b_{n}") + F.col(f"o_{n}") for n in sums}).drop("range", *[f"{x}_{n}" for n in sums for x in "bo"])


def shuffled(x: Column, n: Column, *key: Column) -> Column:
    """The place of ``x`` in a pseudorandom permutation of 0 to ``n`` - 1 that ``key`` names.

    Swap-or-not rounds: a round pairs every number with its mirror image about a
    random point and swaps the pair or not, by a random bit. Each round is a
    permutation whatever ``n`` is.
    """

    def step(now: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(*key, r), n) - now, n)
        swap = F.pmod(F.xxhash64(*key, r, F.greatest(now, mirror)), F.lit(2)) == 1
        return F.when(swap, mirror).otherwise(now)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), x.cast("long"), step)


def water_level(sources: DataFrame, total: int) -> float:
    """The words for a weight of 1 at which all targets, each stopping at REPEATS times its source's size, sum up to ``total``.

    Starts with equal shares of the weight; while a source stops, its excess is
    shared anew. A round is one aggregate; levels only rise, so it ends.
    """
    level, stops = 0.0, F.col("source_size") * float(REPEATS)
    while True:
        full = stops < F.col("weight") * level
        spent, weight = sources.agg(F.sum(F.when(full, stops)), F.sum(F.when(~full, F.col("weight")))).first()
        now = (total - (spent or 0.0)) / weight if weight else level
        if now <= level:
            return level
        level = now


@dataclasses.dataclass
class Mix:
    """``documents(at, doc_id, mark, size, place, source, source_size, target, offset)``, ``sources``, ``draws(shard, slot, place, epoch, block)``."""

    documents: DataFrame
    sources: DataFrame
    draws: DataFrame
    block_words: int


def measured(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).cast("string").alias("source"), F.xxhash64(text).alias("mark"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("size"))


def source_table(rows: DataFrame, weights: Sequence[float], block_words: int) -> DataFrame:
    """One row for each source: place, source, source_size, before (sizes of the sources before it), weight, target, blocks, quota.

    Sources come by code point, null last, and ``weights`` repeat in that order.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = running(sums, [F.col("source").asc_nulls_last()], {"place": F.lit(1), "before": F.col("source_size")}, "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    placed = stored(placed.withColumn("weight", weight), "mix-sources")
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    target = F.least(F.col("source_size") * float(REPEATS), F.col("weight") * water_level(placed, total))
    blocks = F.ceil(F.col("source_size") / block_words)
    quota = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * F.col("blocks"))).otherwise(0).cast("long")
    return stored(placed.withColumn("target", target).withColumn("blocks", blocks).withColumn("quota", quota).drop("at"), "mix-sources")


def draw_slots(sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """``shard, slot, place, epoch, block`` for every slot of the output; each source fills ``quota`` of them.

    A slot throws a number below the sum of quotas and falls to the source in
    whose interval it lies: the counts of a shard are a multinomial draw.
    Intervals are cut at multiples of a width, so slots find them by an equal
    key. The draws of a source beyond its quota are handed over, in order, to
    the sources that lack some.
    """
    spark = sources.sparkSession
    placed = stored(running(sources.where("quota > 0"), [F.col("place")], {"low": F.col("quota")}, "mix-quotas"), "mix-quotas")
    slots, n_sources = placed.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    size = max(shard_slots, -(-slots // MOST_SHARDS))
    width = max(1, -(-slots // (4 * max(1, n_sources))))
    intervals = placed.select("place", "low", (F.col("low") + F.col("quota")).alias("high")).withColumn("cut", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))))
    thrown = spark.range(slots).select(F.expr(f"id div {size}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, slots))).alias("u")).withColumn("cut", F.expr(f"u div {width}"))
    counts = stored(thrown.join(intervals, "cut").where("u >= low AND u < high").groupBy("shard", "place").agg(F.count("*").alias("n")), "mix-counts")

    drawn = counts.groupBy("place").agg(F.sum("n").alias("drawn"))
    totals = placed.select("place", "quota", "blocks").join(drawn, "place", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    over, under = F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)), F.greatest(F.col("quota") - F.col("drawn"), F.lit(0))
    totals = stored(running(totals, [F.col("place")], {"over": over, "under": under}, "mix-totals").drop("at"), "mix-totals")

    earlier = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    others = Window.partitionBy("shard").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    begun = counts.select("shard", "place", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"), F.coalesce(F.sum("n").over(others), F.lit(0)).alias("slots_before"))
    each = begun.select("shard", "place", "first", "slots_before", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("t")).select(
        "shard", "place", (F.col("slots_before") + F.col("t")).alias("rank"), (F.col("first") + F.col("t")).alias("draw")
    )
    each = each.join(totals, "place")
    kept = each.where("draw < quota").select("shard", "rank", "place", "blocks", "draw")
    spare = each.where("draw >= quota").select("shard", "rank", (F.col("over") + F.col("draw") - F.col("quota")).alias("gift"))
    wanted = totals.where("quota > drawn").select("place", "blocks", "drawn", F.posexplode(F.sequence(F.col("under"), F.col("under") + F.col("quota") - F.col("drawn") - 1)).alias("k", "gift"))
    given = spare.join(wanted, "gift").select("shard", "rank", "place", "blocks", (F.col("drawn") + F.col("k")).alias("draw"))

    epoch, in_shard = F.expr("draw div blocks"), F.least(F.lit(size), F.lit(slots) - F.col("shard") * size)
    return kept.unionByName(given).select(
        "shard",
        shuffled(F.col("rank"), in_shard, F.lit(seed + 1), F.col("shard")).alias("slot"),
        "place",
        epoch.alias("epoch"),
        shuffled(F.expr("draw % blocks"), F.col("blocks"), F.lit(seed + 2), F.col("place"), epoch).alias("block"),
    )


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 13, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source"
) -> Mix:
    """Which blocks of which source fill the slots of the output's shards, as many words as ``docs`` have.

    Words are runs of characters other than blank, tab and line ends; a null or
    empty text has none. A null source is a source of its own, the last one.
    Documents of a source come by id (null first), then by a hash of the text;
    rows that agree in both are alike and stand one behind the other, each
    counted by itself. No word is taken more than REPEATS times: a source's
    blocks are gone through in whole before any comes again, and its quota ends
    at REPEATS rounds. Targets are met up to a block or two. The same rows give
    the same mix, however they are partitioned. An empty table, or one without
    words, gives an empty mix. Other columns are not looked at.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights are above 0")
    rows = stored(measured(docs, id_column, text_column, source_column), "mix-words")
    sources = source_table(rows, weights, block_words)
    named = rows.join(sources.select(F.col("source").alias("s"), "place", "source_size", "target", "before"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = running(named, [F.col("place"), F.col("doc_id"), F.col("mark"), F.col("size")], {"words": F.col("size")}, "mix-documents")
    documents = stored(placed.withColumn("offset", F.col("words") - F.col("before")).drop("words", "before"), "mix-documents")
    return Mix(documents, sources, draw_slots(sources, shard_slots, seed), block_words)


def _cuts(size: int) -> Column:
    """For every block that a document reaches into: the block, and its first and last word there, as positions in the document."""
    cut = F.sequence(F.expr(f"offset div {size}"), F.expr(f"(offset + size - 1) div {size}"))
    return F.transform(
        cut,
        lambda b: F.struct(b.alias("block"), F.greatest(b * size - F.col("offset"), F.lit(0)).alias("start"), F.least((b + 1) * size - F.col("offset"), F.col("size")).alias("end")),
    )


def block_spans(mix: Mix) -> DataFrame:
    """Which words of which documents make up the blocks: ``place, block, at, doc_id, start, end``."""
    return mix.documents.where("size > 0").select("place", "at", "doc_id", F.inline(_cuts(mix.block_words)))


def mixed_spans(mix: Mix) -> DataFrame:
    """The mix as spans of documents: ``shard, slot, place, epoch, block, at, doc_id, start, end``; the spans of a slot are in order of ``at``."""
    return mix.draws.join(block_spans(mix), ["place", "block"])


def mixed_texts(mix: Mix, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The mix as text: ``shard, slot, source, epoch, block, n_words, text``, words joined by one blank.

    A document is cut into words once; a block's pieces meet in one row, which holds no more than a block.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    own = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("m"), text.alias("body")).dropDuplicates(["id", "m"])
    known = mix.documents.where("size > 0").join(own, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("m")))
    words = F.array(F.regexp_extract_all("body", F.lit(_WORD), F.lit(0)))  # bound once, as a variable of the outer function
    cut = F.transform(words, lambda w: F.transform(_cuts(mix.block_words), lambda c: F.struct(c["block"].alias("block"), F.slice(w, (c["start"] + 1).cast("int"), (c["end"] - c["start"]).cast("int")).alias("words"))))
    pieces = known.select("place", "source", "at", F.inline(cut[0]))
    blocks = pieces.groupBy("place", "source", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words"))
    return mix.draws.join(blocks, ["place", "block"]).select("shard", "slot", "source", "epoch", "block", F.size("words").alias("n_words"), F.array_join("words", " ").alias("text"))


def taken_words(mix: Mix) -> DataFrame:
    """For every document what the mix takes of it: ``doc_id, size, source_size, target, taken``."""
    taken = mixed_spans(mix).groupBy("at").agg(F.sum(F.col("end") - F.col("start")).alias("words"))
    return mix.documents.join(taken, "at", "left").select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"))
