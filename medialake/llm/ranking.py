"""Ranked lexical search: hashed max-sketches bound scores, exact rescoring in order of falling bounds.

The impact of a term in a document is a whole number that depends on nothing but
its count and the document's length. A document's impacts fold into a sketch of
:data:`COORDINATES` numbers, each the largest impact of the terms hashed to it,
so the weighted sum of a query's coordinates is never below the query's score.
A task takes documents in slices: one matrix product gives the bounds of a slice
for a batch of queries; a query then scores its documents exactly from the
highest bound on, until bounds fall below its tenth best score so far.
Corpus statistics cover all documents and come from a pass before.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, column, fresh_path, row_slices, text_bytes

K = 10
#: Numbers in a sketch, a power of two.
COORDINATES = 1 << 13
#: Queries, and bytes of their texts, that are collected and broadcast at once.
BATCH_QUERIES, BATCH_BYTES = 256, 4 << 20
#: Parts into which a query's best documents of all tasks are dealt before they meet.
SALTS = 32


class Terms(Words):
    """Maximal runs of digits, ASCII letters and characters beyond ASCII, A-Z in lower case."""

    SPACE = ~np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])

    def __init__(self, items: list[bytes]) -> None:
        super().__init__(items, lower=True)


class Queries:
    """The terms of a batch of queries: ``hashes`` sorted, and for each query which of them it has how often."""

    def __init__(self, items: list[bytes]) -> None:
        terms = Terms(items)
        self.hashes = np.unique(terms.hashes)
        places = np.searchsorted(self.hashes, terms.hashes)
        self.terms: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in zip(terms.first[:-1], terms.first[1:], strict=True):
            counts = Counter(places[a:b].tolist())
            at = np.array(sorted(counts), dtype=np.int64)
            self.terms.append((at, np.array([counts[k] for k in at.tolist()], dtype=np.int64)))
        self.filter = np.zeros(1 << max(12, (16 * len(self.hashes)).bit_length()), dtype=bool)
        self.filter[self._low(self.hashes)] = True

    def _low(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(len(self.filter) - 1)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` of terms that a query has, and which term each is."""
        at = np.flatnonzero(self.filter[self._low(hashes)])
        if not len(at):
            return at, at
        term = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        same = self.hashes[term] == hashes[at]
        return at[same], term[same]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def damping(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a document's length adds to the denominators of its impacts: 8 * m."""
    if len(lengths) and int(lengths.max()) * 75 * n_docs < 1 << 62:
        return 8 * (25 + 75 * lengths * n_docs // max(1, n_terms))
    return np.array([8 * (25 + 75 * int(x) * n_docs // max(1, n_terms)) for x in lengths], dtype=np.int64)


class Slice:
    """The documents of a slice as sorted terms with impacts, and their sketches in the coordinates that a batch looks up."""

    def __init__(self, texts: list[bytes], n_docs: int, n_terms: int, places: np.ndarray, width: int) -> None:
        words = Terms(texts)
        self.lengths = np.diff(words.first)
        place = places[(words.hashes & np.uint64(len(places) - 1)).astype(np.int64)]
        used = place >= 0
        hashes, docs = words.hashes[used], words.doc[used]
        order = np.lexsort((hashes, docs))
        hashes, docs, place = hashes[order], docs[order], place[used][order]
        new = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])])) if len(hashes) else np.empty(0, dtype=np.int64)
        counts = np.diff(np.concatenate([new, [len(hashes)]]))
        self.hashes, docs = hashes[new], docs[new]
        self.impacts = 1_000_000_000 * counts // (1000 * counts + damping(self.lengths, n_docs, n_terms)[docs])
        self.first = np.searchsorted(docs, np.arange(len(texts) + 1))
        self.sketches = np.zeros((len(texts), width))
        np.maximum.at(self.sketches.reshape(-1), docs * width + place[new], self.impacts)

    def score(self, doc: int, hashes: np.ndarray, weights: np.ndarray) -> int:
        """The exact score of one document, from its own terms."""
        a, b = self.first[doc], self.first[doc + 1]
        if a == b:
            return 0
        at = np.minimum(np.searchsorted(self.hashes[a:b], hashes), b - a - 1)
        same = self.hashes[a:b][at] == hashes
        return int((self.impacts[a:b][at] * weights)[same].sum())


class Search:
    """A batch of queries with the weights of their terms, ready to meet documents."""

    def __init__(self, queries: Queries, df: np.ndarray, n_docs: int, n_terms: int, size: int = COORDINATES) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        each = np.array([weight(n_docs, int(x)) for x in df], dtype=np.int64)
        self.queries = [(queries.hashes[at], each[at] * times) for at, times in queries.terms]
        coordinates = (queries.hashes & np.uint64(size - 1)).astype(np.int64)
        looked_up = np.unique(coordinates)
        self.places = np.full(size, -1, dtype=np.int64)
        self.places[looked_up] = np.arange(len(looked_up))
        self.width = len(looked_up)
        self.lookups = np.zeros((self.width, len(self.queries)))
        for q, (at, times) in enumerate(queries.terms):
            np.add.at(self.lookups[:, q], self.places[coordinates[at]], (each[at] * times).astype(float))

    def best(self, slices: Iterator[tuple[list, list[bytes]]], k: int) -> list[list[tuple]]:
        """For each query its ``k`` best of the documents that come by: ``(-score, id is not null, id)`` in order.

        Sums of doubles may round where they pass 2^53, so bounds count as a little more than they are.
        """
        top: list[list[tuple]] = [[] for _ in self.queries]
        least = np.ones(len(self.queries))
        self.rescored = 0
        for ids, texts in slices:
            docs = Slice(texts, self.n_docs, self.n_terms, self.places, self.width)
            bounds = docs.sketches @ self.lookups * (1 + 1e-12)
            reach = bounds >= least
            for q in np.flatnonzero(reach.any(axis=0)).tolist():
                maybe = np.flatnonzero(reach[:, q])
                hashes, weights = self.queries[q]
                for doc in maybe[np.argsort(-bounds[maybe, q], kind="stable")].tolist():
                    if bounds[doc, q] < least[q]:
                        break
                    self.rescored += 1
                    score = docs.score(doc, hashes, weights)
                    if score > 0:
                        bisect.insort(top[q], (-score, ids[doc] is not None, ids[doc]))
                        del top[q][k:]
                        if len(top[q]) == k:
                            least[q] = -top[q][-1][0]
        return top


def _slices(batches, id_column: str, text_column: str) -> Iterator[tuple[list, list[bytes]]]:
    for batch in row_slices(batches, text_column):
        yield column(batch, id_column).to_pylist(), text_bytes(batch, text_column)


def statistics(docs: DataFrame, queries: Queries) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms with repeats, and in how many documents each term of the batch occurs."""
    sent = docs.sparkSession.sparkContext.broadcast(queries)

    def count(batches):
        q = sent.value
        df, n_docs, n_terms = np.zeros(len(q.hashes), dtype=np.int64), 0, 0
        for _, texts in _slices(batches, "id", "text"):
            words = Terms(texts)
            n_docs += int((np.diff(words.first) > 0).sum())
            n_terms += len(words.hashes)
            at, term = q.find(words.hashes)
            seen = np.unique(words.doc[at] * len(q.hashes) + term) % max(1, len(q.hashes))
            df += np.bincount(seen, minlength=len(q.hashes))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *some.tolist()], pa.int64()), pa.array([n_docs, n_terms, *df[some].tolist()], pa.int64())], names=["term", "n"])

    counts = {r.term: r.n for r in docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return counts.get(-1, 0), counts.get(-2, 0), np.array([counts.get(k, 0) for k in range(len(queries.hashes))], dtype=np.int64)


def _best_rows(docs: DataFrame, search: Search, k: int) -> DataFrame:
    """``query, doc_id, score``: the best documents of each query, no more than ``k``."""
    sent = docs.sparkSession.sparkContext.broadcast(search)

    def run(batches):
        top = sent.value.best(_slices(batches, "id", "text"), k)
        rows = [(q, x[2], -x[0]) for q, found in enumerate(top) for x in found]
        if rows:
            yield pa.RecordBatch.from_pydict({"query": pa.array([r[0] for r in rows], pa.int32()), "doc_id": [r[1] for r in rows], "score": pa.array([r[2] for r in rows], pa.int64())})

    schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("doc_id", docs.schema["id"].dataType), T.StructField("score", T.LongType())])
    order = F.col("score").desc(), F.col("doc_id").asc_nulls_first()
    found = docs.mapInArrow(run, schema).withColumn("salt", F.spark_partition_id() % SALTS)
    few = found.withColumn("rank", F.row_number().over(Window.partitionBy("query", "salt").orderBy(*order))).where(F.col("rank") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k).select("query", "rank", "doc_id", "score")


def _batches(items: DataFrame) -> Iterator[list[tuple]]:
    """Queries in batches of bounded size; the driver takes a partition at a time."""
    held, room = [], 0
    for row in items.toLocalIterator():
        held.append((row.id, (row.text or "").encode()))
        room += len(held[-1][1])
        if len(held) == BATCH_QUERIES or room >= BATCH_BYTES:
            yield held
            held, room = [], 0
    if held:
        yield held


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K, coordinates: int = COORDINATES, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` best documents for each item: ``item_id, rank, doc_id, score``, scores above 0 only.

    All documents count and are ranked, in whole. Null and empty texts have no
    terms: such items get no rows, such documents are never found. Equal scores
    rank by id, null first; repeated documents rank one by one, and a repeated
    item gets its rows again. Terms are told apart by 64-bit hashes. Empty
    tables give no rows; other columns are not looked at. ``coordinates`` is the
    size of a sketch, a power of two: fewer loosen the bounds, results stay.
    """
    if coordinates < 1 or coordinates & (coordinates - 1):
        raise ValueError("coordinates is a power of two")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    path = fresh_path(spark, "ranked")
    kind = items.schema[item_id].dataType
    names = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item_id", kind)])
    schema = T.StructType([names["item_id"], T.StructField("rank", T.IntegerType()), T.StructField("doc_id", texts.schema["id"].dataType), T.StructField("score", T.LongType())])
    spark.createDataFrame([], schema).write.parquet(path)
    for batch in _batches(items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text"))):
        queries = Queries([text for _, text in batch])
        n_docs, n_terms, df = statistics(texts, queries)
        best = _best_rows(texts, Search(queries, df, n_docs, n_terms, coordinates), k)
        named = spark.createDataFrame([(q, ident) for q, (ident, _) in enumerate(batch)], names)
        best.join(named, "query").select(*schema.names).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
