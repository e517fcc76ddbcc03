"""Toxicity scores: Levenshtein automata over a lexicon trie, weighed by context.

The lexicon is learned from labelled rows: whole words and word beginnings that
toxic documents have and others lack. A word is run through the intersection of
the lexicon trie with the automaton that allows a few edits, built lazily as a
deterministic automaton. A window of words around each hit is scored in numbers:
how closely quotation marks enclose it, how near a verb of reporting is, how
near somebody is addressed. A logistic model over hits and context gives the
score. It is fitted on the labelled rows and on variants of the toxic ones, with
their terms misspelled (still toxic) or quoted (not toxic); hits and address
never lower a score, signs of quotation never raise one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, free_name, row_slices, stored, texts

#: Labelled rows of either class that the lexicon and the model are fitted on.
SAMPLE_ROWS = 5000
#: Weight of a variant of a labelled row beside the row itself.
VARIANT_WEIGHT = 0.5
#: Words before and behind a hit that decide whether it is quoted.
CONTEXT_WORDS = 6
MIN_STEM, MAX_STEM = 4, 7
#: Least log-likelihood ratio of a term, against words that are toxic by chance.
EVIDENCE = 8.5
#: A word near a term says nothing if clean documents have such words more often than toxic ones have the term.
LEAST_TRUST = 0.5
#: Word types whose automaton result a worker remembers.
CACHE_WORDS = 300_000

_WORD = re.compile(r"[^\W_]+(?:['’*@$!][^\W_]+)*")
_OPEN, _CLOSE, _EVEN = "“„«‘", "”»’", "\"“"  # the last ones open and close
# Verbs of reporting and words of address in the four languages of the corpus (fixed values).
REPORTING = frozenset("said says wrote writes quoted called reported claims sagte schrieb zitierte nannte dit écrit cite appelé dijo escribió citó llamó".split())
ADDRESS = frozenset("you your yours du dich dir dein deine ihr euch tu toi te ton ta tes vous votre tú ti tus usted ustedes".split())


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """All lexicon words within their allowed edits, as a lazily built deterministic automaton.

    A state is a set of (trie node, edits so far) closed under skipping trie
    letters; a letter leads to the set reached by matching, replacing or adding.
    """

    def __init__(self, terms: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.terminal: dict[int, int] = {}
        self.limit = [0]
        for index, term in enumerate(terms):
            node = 0
            self.limit[0] = max(self.limit[0], edits_allowed(term))
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.limit.append(0)
                node = self.children[node][c]
                self.limit[node] = max(self.limit[node], edits_allowed(term))
            self.terminal[node] = index
        self.allowed = [edits_allowed(t) for t in terms]
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        todo = list(nodes.items())
        while todo:
            node, edits = todo.pop()
            if nodes[node] != edits or edits + 1 > self.limit[node]:
                continue
            for child in self.children[node].values():
                if edits + 1 <= self.limit[child] and edits + 1 < nodes.get(child, 99):
                    nodes[child] = edits + 1
                    todo.append((child, edits + 1))
        key = frozenset(nodes.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(nodes)
            self.moves.append({})
            hits = [(e, self.terminal[n]) for n, e in nodes.items() if n in self.terminal and e <= self.allowed[self.terminal[n]]]
            self.accepts.append(min(hits) if hits else None)
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        out: dict[int, int] = {}

        def put(node: int, edits: int) -> None:
            if edits <= self.limit[node] and edits < out.get(node, 99):
                out[node] = edits

        for node, edits in self.sets[state].items():
            put(node, edits + 1)
            for letter, child in self.children[node].items():
                put(child, edits + (letter != c))
        self.moves[state][c] = got = self._state(out) if out else -1
        return got

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, index of the term) of the closest term, or None."""
        if len(self.sets) > 50_000:
            self._reset()
        state = self.start
        for c in word:
            got = self.moves[state].get(c)
            state = got if got is not None else self._move(state, c)
            if state < 0:
                return None
        return self.accepts[state]


#: What the logistic model sees. Hits count once per distinct term, so that long documents are not toxic by length;
#: a misspelled one counts by its closeness. Marks and report are how far a document's hits are quoted, its least quoted
#: hit deciding for a term; address is the nearest one.
FEATURES = ("bias", "exact", "stem", "misspelled", "strength", "address", "marks", "report")
PRIOR = np.array([-2.0, 2.0, 2.0, 1.5, 1.0, 0.1, -0.5, -0.5])
#: The sign that a weight may have.
SIGNS = np.array([0, 1, 1, 1, 1, 1, -1, -1])


@dataclass
class Lexicon:
    words: dict[str, float]
    stems: dict[str, float]
    #: Words of stem families and their stems, so that their misspellings are found and count as the family.
    members: dict[str, str] = field(default_factory=dict)
    #: Words near a term that clean documents use: words of their own, no misspellings.
    own: frozenset[str] = frozenset()
    #: Those of them that one sampled document alone has; in that one they are judged as in an unseen one.
    once: frozenset[str] = frozenset()
    #: How far a word near a term speaks for the term: its toxic documents against clean ones that have a near word (1 where none has).
    trust: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.list = [*self.words, *self.members]


@dataclass
class Hit:
    """A word that is a term: its place, the kind of hit, the term, its weight and how close the word is to it."""

    at: int
    kind: str
    term: str
    weight: float
    closeness: float


class Matcher:
    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.automaton = LexiconAutomaton(lexicon.list)
        self.lengths = sorted({len(s) for s in lexicon.stems})
        self.known: dict[str, tuple[str, str, float, float] | None] = {}

    def term(self, word: str) -> tuple[str, str, float, float] | None:
        """(kind of hit, term, weight, closeness) of a lower-cased word."""
        if word in self.lexicon.words:
            return "exact", word, self.lexicon.words[word], 1.0
        for n in self.lengths:
            if word[:n] in self.lexicon.stems and len(word) >= n:
                return "stem", word[:n], self.lexicon.stems[word[:n]], 1.0
        if word in self.lexicon.own:
            return None
        got = self.automaton.match(word)
        if not got:
            return None
        near = self.lexicon.list[got[1]]
        term = self.lexicon.members.get(near, near)
        if self.lexicon.trust.get(term, 1.0) < LEAST_TRUST:
            return None
        weight = self.lexicon.stems[term] if near in self.lexicon.members else self.lexicon.words[term]
        return "misspelled", term, weight, (1.0 - got[0] / (len(near) + 1)) * self.lexicon.trust.get(term, 1.0)

    def hits(self, words: list[str]) -> list[Hit]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, out = self.known, []
        for k, word in enumerate(words):
            try:
                got = known[word]
            except KeyError:
                got = known[word] = self.term(word)
            if got:
                out.append(Hit(k, *got))
        return out

    def features(self, text: str) -> np.ndarray:
        lower = text.lower()
        words = _WORD.findall(lower)
        hits = self.hits(words)
        if not hits:
            return np.array([1.0, *[0.0] * (len(FEATURES) - 1)])
        spans = [m.span() for m in _WORD.finditer(lower)]
        terms: dict[str, dict[str, float]] = {"exact": {}, "stem": {}, "misspelled": {}}
        marks: dict[str, float] = {}
        reports: dict[str, float] = {}
        strength = address = 0.0
        for h in hits:
            quoted, reported, addressed = context(lower, words, spans, h.at)
            terms[h.kind][h.term] = max(h.closeness, terms[h.kind].get(h.term, 0.0))
            marks[h.term] = min(quoted, marks.get(h.term, 1.0))
            reports[h.term] = min(reported, reports.get(h.term, 1.0))
            strength = max(strength, h.weight * h.closeness / 5)
            address = max(address, addressed)
        counts = [np.log1p(sum(terms[kind].values())) for kind in ("exact", "stem", "misspelled")]
        return np.array([1.0, *counts, strength, address, np.mean(list(marks.values())), np.mean(list(reports.values()))])


def _nearness(words: list[str], wanted: frozenset[str], at: int) -> float:
    """1 for a wanted word beside place ``at``, less with distance, 0 beyond the window."""
    best = 0.0
    for k in range(max(0, at - CONTEXT_WORDS), min(len(words), at + CONTEXT_WORDS + 1)):
        if k != at and words[k] in wanted:
            best = max(best, 1.0 - (abs(k - at) - 1) / CONTEXT_WORDS)
    return best


def context(text: str, words: list[str], spans: list[tuple[int, int]], at: int) -> tuple[float, float, float]:
    """(marks, report, address) of the window around word ``at``, each from 0 to 1.

    Marks: an open quotation before the word and its end behind, each worth a
    half, less with the distance in words. Report and address: the nearest verb
    of reporting and the nearest word of address.
    """
    a, b = max(0, at - CONTEXT_WORDS), min(len(words), at + CONTEXT_WORDS + 1)
    opened = closed = 0.0
    for k in range(at, a - 1, -1):  # the gaps before word k, nearest first
        gap = text[spans[k - 1][1] if k else 0 : spans[k][0]]
        found = _last_mark(gap)
        if found:
            opened = 1.0 - (at - k) / (CONTEXT_WORDS + 1) if found == "open" else 0.0
            break
    for k in range(at, b):
        gap = text[spans[k][1] : spans[k + 1][0] if k + 1 < len(words) else len(text)]
        found = _first_mark(gap)
        if found:
            closed = 1.0 - (k - at) / (CONTEXT_WORDS + 1) if found == "close" else 0.0
            break
    return (opened + closed) / 2 if opened and closed else 0.0, _nearness(words, REPORTING, at), _nearness(words, ADDRESS, at)


def _last_mark(gap: str) -> str | None:
    """Whether the last quotation mark between two words opens (stands before a word) or closes."""
    for k in range(len(gap) - 1, -1, -1):
        c = gap[k]
        if c in _OPEN or c in _EVEN + "'" and k == len(gap) - 1:
            return "open"
        if c in _CLOSE or c in _EVEN:
            return "close"
    return None


def _first_mark(gap: str) -> str | None:
    """Whether the first quotation mark behind a word closes (stands behind text) or opens."""
    for k, c in enumerate(gap):
        if c in _CLOSE or c in _EVEN + "'" and (k == 0 or gap[:k].strip(".,;:!?") == ""):
            return "close"
        if c in _OPEN or c in _EVEN:
            return "open"
    return None


def misspelled(word: str) -> str:
    """``word`` with one letter left out, doubled or replaced, by the word itself."""
    seed = zlib.crc32(word.encode())
    k, way = 1 + seed % max(1, len(word) - 1), (seed >> 8) % 3
    if way == 0:
        return word[:k] + word[k + 1 :]
    if way == 1:
        return word[:k] + word[k - 1] + word[k:]
    return word[:k] + ("x" if word[k : k + 1] != "x" else "z") + word[k + 1 :]


def variants(matcher: Matcher, text: str) -> list[tuple[str, int]]:
    """Variants of a toxic text with their labels: its terms misspelled, in quotation marks, behind a verb of reporting, and both."""
    lower = text.lower()
    spans = [m.span() for m in _WORD.finditer(lower)]
    places = [spans[h.at] for h in matcher.hits([lower[a:b] for a, b in spans]) if h.kind != "misspelled"]

    def rewritten(new) -> str:
        out, at = [], 0
        for a, b in places:
            out += [lower[at:a], new(lower[a:b])]
            at = b
        return "".join([*out, lower[at:]])

    if not places:
        return []
    verb = sorted(REPORTING)[zlib.crc32(lower.encode()) % len(REPORTING)]
    made = [(rewritten(lambda w: f'"{w}"'), 0), (rewritten(lambda w: f"{verb} {w}"), 0), (rewritten(lambda w: f'{verb} "{w}"'), 0)]
    wrong = rewritten(lambda w: misspelled(w) if edits_allowed(w) else w)
    return [*made, (wrong, 1)] if matcher.hits(_WORD.findall(wrong)) else made


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 5, is 0. A null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled documents of each class, in order of a hash of the id: ``text, y``.

    Rows with a null label or id, and those set aside by :func:`held_out`, are
    not in it. An id labelled twice is taken with its higher label.
    """
    known = labels.select(F.col(id_column).alias("i"), F.col(label_column).cast("int").alias("y")).where("i IS NOT NULL AND y IS NOT NULL").groupBy("i").agg(F.max("y").alias("y"))
    known = known.where(~held_out(F.col("i")))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    chosen = docs.select(F.col(id_column).alias("i"), F.col(text_column).alias("text"))
    return chosen.join(F.broadcast(picked), "i").select("text", "y")  # at most 2 * rows ids


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Terms whose documents are toxic far more often than others are, from counts made by Spark."""

    def terms(batches):
        for batch in row_slices(batches):
            counts = {y: (Counter(), Counter()) for y in (0, 1)}
            for y, text in zip(column(batch, "y").to_pylist(), texts(batch), strict=True):
                words = set(_WORD.findall(text.lower()))
                counts[y][0].update(words)
                counts[y][1].update({w[:n] for w in words for n in range(MIN_STEM, MAX_STEM + 1) if len(w) > n})
            rows = [(kind, term, n, y) for y, both in counts.items() for kind, c in zip("ws", both, strict=True) for term, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int32())], names=["kind", "term", "n", "y"])

    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n1:
        return Lexicon({}, {})
    counted = sample.mapInArrow(terms, "kind string, term string, n long, y int").groupBy("kind", "term").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    odds = F.log((F.col("a") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("b") + 0.5) / F.lit(n0 + 1.0))
    least = max(3, n1 // 200)
    # evidence: the odds' lower bound, so that rare terms need purer counts
    share = n1 / (n0 + n1)
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / ((F.col("a") + F.col("b")) * p))).otherwise(0.0)
    strong = counted.where(f"a >= {least}").withColumn("w", odds - 1.0 / F.sqrt(F.col("a"))).withColumn("g", part("a", share) + part("b", 1.0 - share))
    best = strong.where(f"w > 3.0 AND g > {EVIDENCE}").orderBy(F.desc("g"), "kind", "term").collect()  # terms of the bounded sample
    stems: dict[str, float] = {}
    for r in sorted((r for r in best if r.kind == "s"), key=lambda r: (len(r.term), r.term)):
        if not any(r.term[:n] in stems for n in range(MIN_STEM, len(r.term))):
            stems[r.term] = float(r.w)
    # a stem that one word explains alone is that word; the others are families of words
    words = {r.term: float(r.w) for r in best if r.kind == "w"}
    support = {r.term: r.a for r in best if r.kind == "s"}
    members: dict[str, str] = {}
    by_word = {r.term: r.a for r in best if r.kind == "w"}
    for stem in list(stems):
        inside = [w for w in words if w.startswith(stem)]
        if any(by_word[w] >= 0.9 * support[stem] for w in inside):
            del stems[stem]
        else:
            for w in inside:
                del words[w]
                members[w] = stem
    return _with_own_words(Lexicon(words, stems, members), counted, by_word | {t: support[t] for t in stems})


def _with_own_words(lexicon: Lexicon, counted: DataFrame, toxic: dict[str, int]) -> Lexicon:
    """``lexicon`` with the words that the automaton takes for misspellings though clean documents of the sample use them.

    ``toxic`` tells how many toxic documents have each term.
    """

    def near(batches):
        matcher = Matcher(lexicon)
        for batch in batches:
            words, b = column(batch, "term").to_pylist(), column(batch, "b").to_pylist()
            found = [(w, got[1], n) for w, n in zip(words, b, strict=True) if (got := matcher.term(w)) and got[0] == "misspelled"]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["word", "term", "b"])

    clean = counted.where("kind = 'w' AND b > 0 AND b >= a").select("term", "b").mapInArrow(near, "word string, term string, b long").collect()  # words of the bounded sample
    beside = Counter()
    for r in clean:
        beside[r.term] += r.b
    return Lexicon(lexicon.words, lexicon.stems, lexicon.members, frozenset(r.word for r in clean), frozenset(r.word for r in clean if r.b == 1), {t: toxic[t] / (toxic[t] + n) for t, n in beside.items()})


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def matcher(self) -> Matcher:
        return Matcher(self.lexicon)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(features @ self.weights, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, **columns) -> Model:
    """Learn lexicon and weights from a bounded sample of labelled rows.

    Only one short vector per sampled row reaches the driver. Without toxic
    rows the lexicon is empty and every text gets the same low score.
    """
    sample = stored(labelled_sample(docs, labels, rows=rows, **columns), "toxicity-sample")  # several passes over a few rows, not over all texts
    lexicon = learn_lexicon(sample)
    if not lexicon.words and not lexicon.stems:
        return Model(lexicon, PRIOR)

    unseen = replace(lexicon, own=lexicon.own - lexicon.once)

    def vectors(batches):
        matcher = Matcher(unseen)
        for batch in row_slices(batches):
            out = []
            for text, label in zip(texts(batch), column(batch, "y").to_pylist(), strict=True):
                out.append((matcher.features(text).tolist(), label, 1.0))
                if label:
                    out += [(matcher.features(t).tolist(), y, VARIANT_WEIGHT) for t, y in variants(matcher, text)]
            kinds = (pa.list_(pa.float64()), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["x", "y", "w"])

    got = sample.mapInArrow(vectors, "x array<double>, y int, w double").toPandas()
    x, y, w = np.array(got["x"].tolist()), got["y"].to_numpy(dtype=float), got["w"].to_numpy(dtype=float)
    return Model(lexicon, _logistic(x, y, w))


def _logistic(x: np.ndarray, y: np.ndarray, row_weights: np.ndarray) -> np.ndarray:
    """Weights of highest posterior within :data:`SIGNS`, by Newton steps on the weights that are free to move."""
    low, high = np.where(SIGNS > 0, 0.0, -np.inf), np.where(SIGNS < 0, 0.0, np.inf)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((row_weights * (np.logaddexp(0, z) - y * z)).sum() + 0.25 * ((w - PRIOR) ** 2).sum())

    weights = PRIOR.copy()
    for _ in range(200):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (row_weights * (p - y)) + 0.5 * (weights - PRIOR)
        free = ~(((weights <= low) & (gradient > 0)) | ((weights >= high) & (gradient < 0)))
        if not free.any():
            break
        own = x[:, free]
        step = np.zeros_like(weights)
        step[free] = np.linalg.solve((own * (row_weights * p * (1 - p))[:, None]).T @ own + 0.5 * np.eye(int(free.sum())), gradient[free])
        rate, now = 1.0, loss(weights)
        while rate > 1e-6 and loss(np.clip(weights - rate * step, low, high)) > now:
            rate /= 2
        moved = np.clip(weights - rate * step, low, high)
        done = np.abs(moved - weights).max() < 1e-6
        weights = moved
        if done:
            break
    return weights


def _scorer(model: Model):
    cached: list[Matcher] = []

    def score(items: list[str]) -> np.ndarray:
        if not cached:
            cached.append(model.matcher())
        return model.score(np.array([cached[0].features(t) for t in items]).reshape(len(items), len(FEATURES)))

    return score


def toxicity_scores(docs: DataFrame, model: Model, keep: list[str], text_column: str = "text") -> DataFrame:
    """Columns ``keep`` of every document, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    A null or empty text has no hits and gets the score of the bias alone.
    Repeated rows give repeated rows, equal texts equal scores. An empty table
    gives no rows. Other columns are not looked at, whatever their names.
    """
    own_text = free_name(keep, "text")
    rows = docs.select(*keep, F.col(text_column).alias(own_text))
    fields = rows.schema.fields[:-1]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        own = _scorer(shared.value)
        for batch in row_slices(batches, own_text):
            got = own(texts(batch, own_text))
            yield pa.RecordBatch.from_arrays([*[column(batch, f.name) for f in fields], pa.array(got, pa.float64()), pa.array((got >= 0.5).astype(np.int32))], names=schema.names)

    return rows.mapInArrow(score, schema)


def drop_toxic(docs: DataFrame, model: Model, text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without documents that score ``threshold`` or more; all columns as they are.

    Null and empty texts stay, repeated rows go or stay together, an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches):
        own = _scorer(shared.value)
        for batch in row_slices(batches, text_column):
            yield batch.filter(pa.array(own(texts(batch, text_column)) < threshold))

    return docs.mapInArrow(clean, docs.schema)
