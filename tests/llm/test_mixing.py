"""Mixing against a plain recomputation of targets, draws and spans."""

import collections
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from medialake.llm import mixing

SCHEMA = "doc_id long, text string, source string, target string, place int, at long, block string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    names = ["src0"] * 12 + ["b", "B", "ä", "z", "src1", "日本", None]
    rows = [(i, " ".join(f"w{rng.randrange(999)}" for _ in range(rng.choice([0, 1, 3, 20, 90]))), rng.choice(names)) for i in range(n)]
    rows += [(900, None, "src1"), (901, "", "nothing"), (902, " \t\n", "nothing"), (903, "one", "tiny"), (904, "long " * 9000, "b"), (None, "n u l l", "z"), rows[5], rows[5]]
    rows += [(950, "é x y\x0bz\x1cq", "ä"), (950, "other text", "ä")]
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "clash", 7, 8, "clash") for r in rows], SCHEMA).repartition(parts)


def targets(rows, weights=(1, 2, 3)):
    size = collections.Counter()
    for _, text, source in rows:
        size[source] += len(WORD.findall(text or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sorted(size, key=lambda s: (s is None, (s or "").encode())))}
    total, full = sum(size.values()), set()
    while True:
        free = sum(w for s, w in weight.items() if s not in full)
        level = (total - sum(3 * size[s] for s in full)) / free if free else 0
        over = {s for s in weight if s not in full and 3 * size[s] < level * weight[s]}
        if not over:
            return size, {s: float(3 * size[s]) if s in full else level * weight[s] for s in weight}
        full |= over


def spark_hash(*values, seed=42):
    """Spark's xxhash64 of longs and ints."""
    for kind, v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q" if kind == "l" else "<i", v), seed=seed) & ((1 << 64) - 1)
    return seed - (1 << 64) if seed >> 63 else seed


def swapped(x, n, *key):
    for r in range(mixing.ROUNDS):
        mirror = (spark_hash(*key, ("i", r)) % n - x) % n
        if spark_hash(*key, ("i", r), ("l", max(x, mirror))) % 2 == 1:
            x = mirror
    return x


def test_permutations(spark):
    cases = spark.range(60).select((F.col("id") % 20 + 1).alias("n"), (F.col("id") % 3).alias("k")).distinct()
    each = cases.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    rows = each.withColumn("y", mixing.shuffled(F.col("x"), F.col("n"), F.lit(5), F.col("k"))).collect()
    images = collections.defaultdict(list)
    for r in rows:
        images[r.n, r.k].append(r.y)
        assert r.y == swapped(r.x, r.n, ("i", 5), ("l", r.k))
    assert all(sorted(v) == list(range(n)) for (n, _), v in images.items())
    assert len({tuple(v) for (n, _), v in images.items() if n == 20}) == 3


@pytest.mark.parametrize("parts", [1, 6])
def test_mix(spark, parts):
    rows = corpus()
    mix = mixing.mix_sources(frame(spark, rows, parts), block_words=16, shard_slots=50)
    size, want = targets(rows)
    got = mixing.taken_words(mix)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"] and got.count() == len(rows)
    docs = mix.documents.join(got.select("doc_id", "size", "taken"), ["doc_id", "size"]).collect()
    assert {r.source: r.source_size for r in mix.sources.collect()} == dict(size)
    assert {r.source: pytest.approx(r.target) for r in mix.sources.collect()} == want
    assert all(r.taken <= 3 * r["size"] for r in docs)
    assert sorted(((r.doc_id, r["size"]) for r in got.collect()), key=repr) == sorted(((i, len(WORD.findall(t or ""))) for i, t, _ in rows), key=repr)

    # every draw once, each source's blocks in whole rounds of a permutation
    draws = [(r.place, r.epoch, r.block, r.shard, r.slot) for r in mix.draws.collect()]
    slots = sorted((shard, slot) for *_, shard, slot in draws)
    quota = {r.place: (r.quota, r.blocks) for r in mix.sources.collect()}
    assert len(draws) == sum(q for q, _ in quota.values()) and slots == [(k // 50, k % 50) for k in range(len(draws))]
    for place, (q, blocks) in quota.items():
        own = collections.Counter((e, b) for p, e, b, *_ in draws if p == place)
        assert own == collections.Counter((k // blocks, swapped(k % blocks, blocks, ("i", 15), ("l", place), ("l", k // blocks))) for k in range(q))

    # spans against the blocks of the words laid end to end
    words = collections.defaultdict(list)
    for r in sorted(mix.documents.collect(), key=lambda r: r.at):
        assert r.offset == len(words[r.place])
        words[r.place] += [(r.at, k) for k in range(r["size"])]
    spans = collections.defaultdict(list)
    for r in sorted(mixing.mixed_spans(mix).collect(), key=lambda r: r.at):
        spans[r.shard, r.slot] += [(r.at, k) for k in range(r.start, r.end)]
    for place, _, block, shard, slot in draws:
        assert spans[shard, slot] == words[place][16 * block : 16 * block + 16]
    taken = collections.Counter()
    for place, _, block, *_ in draws:
        taken[place] += len(words[place][16 * block : 16 * block + 16])
    for r in mix.sources.collect():
        assert abs(taken[r.place] - r.target) <= 32
    assert sum(r.taken for r in got.collect()) == sum(taken.values())


def test_texts(spark):
    rows = corpus(2, 150)
    docs = frame(spark, rows)
    mix = mixing.mix_sources(docs, block_words=16, shard_slots=20)
    words = {}
    for i, text, _ in rows:
        found = WORD.findall(text or "")
        words[i, len(found)] = found
    sizes = {r.at: r["size"] for r in mix.documents.collect()}
    want = collections.defaultdict(list)
    for r in sorted(mixing.mixed_spans(mix).collect(), key=lambda r: r.at):
        want[r.shard, r.slot] += words[r.doc_id, sizes[r.at]][r.start : r.end]
    got = {(r.shard, r.slot): r.text for r in mixing.mixed_texts(mix, docs).collect()}
    assert got == {k: " ".join(v) for k, v in want.items()}


def test_reruns_agree_and_odd_tables(spark):
    rows = corpus(3, 200)
    runs = [sorted(map(tuple, mixing.taken_words(mixing.mix_sources(frame(spark, rows, p))).collect()), key=repr) for p in (1, 5)]
    assert runs[0] == runs[1]
    assert mixing.taken_words(mixing.mix_sources(frame(spark, []))).count() == 0
    wordless = mixing.taken_words(mixing.mix_sources(frame(spark, [(1, None, "a"), (2, "", None)]))).collect()
    assert [(r["size"], r.target, r.taken) for r in wordless] == [(0, 0.0, 0)] * 2
    with pytest.raises(ValueError):
        mixing.mix_sources(frame(spark, rows), weights=())


def test_multinomial_counts_vary_by_shard(spark):
    """Counts of a source differ from shard to shard about as multinomial draws do."""
    rows = [(i, "w " * 64, f"s{i % 4}") for i in range(400)]
    mix = mixing.mix_sources(frame(spark, rows), weights=(1,), block_words=8, shard_slots=100)
    counts = [r["count"] for r in mix.draws.groupBy("shard", "place").count().collect()]
    mean = sum(counts) / len(counts)
    variance = sum((c - mean) ** 2 for c in counts) / len(counts)
    assert len(counts) == 4 * 32 and mean == 25 and 9 < variance < 32
