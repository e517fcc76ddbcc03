"""Ranked search against brute force over exact strings."""

import collections
import math
import random
import re

import numpy as np
import pytest

from medialake.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, item_id string, score int, query int", "item_id long, text string, doc_id string, rank int"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, k=10):
    words = [TERM.findall(lowered(t)) for _, t in docs]
    big_n, big_l = sum(bool(w) for w in words), sum(map(len, words))
    counts = [collections.Counter(w) for w in words]
    df = collections.Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), w, c in zip(docs, words, counts):
            m = 100 - 75 + 75 * len(w) * big_n // big_l if big_l else 0
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in TERM.findall(lowered(text)) if c[t])
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def tables(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "é", "straße", "日本語", "x_y", "A1"]
    frequent = vocabulary[:12]
    docs = [(i, " ".join(rng.choice(frequent if rng.random() < 0.5 else vocabulary) for _ in range(rng.choice([1, 3, 30, 200])))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " .,;_\t"), (None, docs[5][1]), (203, docs[5][1]), (204, docs[5][1].upper()), (205, " ".join(vocabulary) * 60), docs[7], docs[7]]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 5, 40])))) for i in range(30)]
    items += [(40, None), (41, ""), (42, "--"), (43, "nowhere found"), (None, docs[5][1]), (44, "w1 W1 w1 w1"), (44, "w1 W1 w1 w1"), (45, " ".join(vocabulary) * 8)]
    return docs, items


def ranked(spark, docs, items, parts=3, **kw):
    d = spark.createDataFrame([(i, t, "clash", 7, 8) for i, t in docs], DOCS).repartition(parts)
    q = spark.createDataFrame([(i, t, "clash", 9) for i, t in items], ITEMS)
    return sorted(map(tuple, ranking.rank_documents(d, q, **kw).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 5])
def test_ranked(spark, parts):
    docs, items = tables()
    assert ranked(spark, docs, items, parts) == brute(docs, items)


def test_batches_and_few_coordinates(spark, monkeypatch):
    """Queries in several batches; sketches so small that bounds are loose."""
    docs, items = tables(2)
    monkeypatch.setattr(ranking, "BATCH_QUERIES", 7)
    assert ranked(spark, docs, items, 1, k=3, coordinates=16) == brute(docs, items, 3)


def test_empty_tables(spark):
    docs, items = tables()
    assert ranked(spark, [], items) == ranked(spark, docs, []) == ranked(spark, [(1, None), (2, "")], items) == []


def test_bounds_hold_and_spare_work():
    """No sketch bounds a score from below it, and most documents are never scored."""
    rng = random.Random(3)
    words = [f"t{i}" for i in range(4000)]
    texts = [" ".join(rng.choices(words, k=80)).encode() for _ in range(600)]
    queries = ranking.Queries([b" ".join(texts[i].split()[:20]) for i in range(0, 600, 60)])
    df = np.zeros(len(queries.hashes), dtype=np.int64)
    for t in texts:
        at, term = queries.find(np.unique(ranking.Terms([t]).hashes))
        df[term] += 1
    search = ranking.Search(queries, df, 600, 600 * 80)
    one = ranking.Slice(texts, 600, 600 * 80, search.places, search.width)
    bounds = one.sketches @ search.lookups
    assert all(one.score(d, *search.queries[q]) <= bounds[d, q] for d in range(600) for q in range(10))
    found = search.best(((list(range(a, a + 100)), texts[a : a + 100]) for a in range(0, 600, 100)), 10)
    assert [x[0][2] for x in found] == list(range(0, 600, 60)) and all(len(x) == 10 for x in found)
    assert search.rescored < 10 * 600 / 3


def test_length_terms_beyond_64_bits():
    assert ranking.damping(np.array([10**9, 3]), 10**10, 10**12).tolist() == [8 * (25 + 75 * 10**9 * 10**10 // 10**12), 8 * 27]
