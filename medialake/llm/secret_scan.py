"""Secret scans: patterns, and a character convolutional network over all candidates.

Three patterns give the base findings. The network looks at every token that
could be a credential with the text around it, a long one through overlapping
windows of which the highest score counts. It is trained, in numpy, on the
distinct secrets that the patterns label among the other candidates of all
documents; half of the rows go without their surroundings, so that the
secret's own characters have to tell. Tasks train on a part of the rows each, and
their weights are averaged after every round. Scores are calibrated on all candidates
held back, and the threshold is the highest that still recalls the wanted share of
their secrets from their own characters alone. What it accepts beside the base findings becomes a span of the
kind ``learned``.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, free_name, row_slices, stored, texts

#: Windows that a task trains on between two averages, about.
PART = 32_768
#: Windows that a network has to see, which sets the rounds, and the bounds of these.
SEEN, ROUNDS = 64_000, (2, 10)
#: Scores held back are counted in steps of this part of a logit.
STEP = 1 / 256
#: Share of held-back findings that the threshold must recall.
RECALL = 0.98
#: Share of held-back candidates without a finding that may reach the lower end of the threshold's range.
CLEAN_REACH = 0.001
#: Fewer labelled findings than this cannot be learned from.
LEAST_FINDINGS = 20

KINDS = ("assign", "access", "hex", "learned")
# The contract's patterns (fixed values); letters of the keyword are ASCII in either case.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a run is taken whole, so short runs need not match first
_TOKEN = re.compile(r"[A-Za-z0-9+/_.-]{8,}={0,2}")
#: A capital, a digit or a sign behind the first character: no plain word.
_NO_WORD = re.compile(r".[A-Z0-9+/_.=-]")
#: Letters alone make a candidate from this length on.
LONG_WORD = 20


def base_findings(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches, by start and then kind; positions are code points."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda f: (f[1], KINDS.index(f[0])))


def secrets_of(text: str) -> list[tuple[int, int]]:
    """The secrets inside the base findings: the assigned value, or the whole match."""
    out = [m.span(2) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    return out + [(a, b) for kind, a, b in base_findings(text) if kind != "assign"]


def candidates(text: str) -> list[tuple[int, int]]:
    """All tokens of 8 and more characters that are no plain words, and very long words; signs at their ends do not count."""
    out = []
    for m in _TOKEN.finditer(text):
        token = m[0].rstrip(".-")
        if len(token) >= 8 and (len(token) >= LONG_WORD or _NO_WORD.search(token)):
            out.append((m.start(), m.start() + len(token)))
    return out


BEFORE, INSIDE, BEHIND = 20, 44, 8
LENGTH = BEFORE + INSIDE + BEHIND
#: Printable ASCII as itself, one code for all other characters, one for a line end, 0 beyond the text.
_CODE = {chr(c): c - 30 for c in range(32, 127)} | {"\n": 1}
ALPHABET = 98


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """Spans of at most :data:`INSIDE` characters that cover a candidate, each half over the one before."""
    if end - start <= INSIDE:
        return [(start, end)]
    return [(a, a + INSIDE) for a in range(start, end - INSIDE, INSIDE // 2)] + [(end - INSIDE, end)]


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Character codes of one window with its surroundings; the parts have fixed places."""
    out = np.zeros(LENGTH, dtype=np.int16)
    for at, part in ((BEFORE - min(BEFORE, start), text[max(0, start - BEFORE) : start]), (BEFORE, text[start:end]), (BEFORE + INSIDE, text[end : end + BEHIND])):
        for k, c in enumerate(part):
            out[at + k] = _CODE.get(c, ALPHABET - 1)
    return out


def bare(codes: np.ndarray) -> np.ndarray:
    """The codes without the surroundings."""
    out = np.zeros_like(codes)
    out[BEFORE : BEFORE + INSIDE] = codes[BEFORE : BEFORE + INSIDE]
    return out


#: Alphabets and lengths in which a found secret is shown once more (the usual ones of keys and tokens).
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_SHAPES = ((_LETTERS + _LETTERS.upper() + "0123456789", 20), (_LETTERS + _LETTERS.upper() + "0123456789", 36), (_LETTERS + _LETTERS.upper() + "0123456789-_", 32), (_LETTERS + "0123456789", 28))


def shapes(token: str) -> list[str]:
    """A found secret's characters drawn anew from other alphabets, by a hash of it, twice from each; every second form has a short prefix."""
    out = []
    for k, (alphabet, size) in enumerate(_SHAPES * 2):
        raw = hashlib.sha512(f"{k}:{token}".encode()).digest()
        body = "".join(alphabet[b % len(alphabet)] for b in raw[:size])
        lead = "".join(_LETTERS[b % 26] for b in raw[40 : 42 + raw[42] % 3])
        out.append(body if raw[43] % 2 else f"{lead}{'_' if raw[44] % 2 else ''}{body}")
    return out


class CharCNN:
    """Embedding, one convolution over characters, maximum over each part, one output."""

    WIDTH, EMBED, FILTERS = 5, 10, 24
    PARTS = ((0, BEFORE), (BEFORE, BEFORE + INSIDE), (BEFORE + INSIDE, LENGTH))

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.3, (ALPHABET, self.EMBED)),
            "conv": rng.normal(0, (2 / (self.WIDTH * self.EMBED)) ** 0.5, (self.WIDTH * self.EMBED, self.FILTERS)),
            "bias": np.zeros(self.FILTERS),
            "out": rng.normal(0, 0.1, len(self.PARTS) * self.FILTERS),
            "shift": np.zeros(1),
        }

    def _forward(self, codes: np.ndarray):
        half = self.WIDTH // 2
        padded = np.pad(codes, ((0, 0), (half, half)))
        window = np.lib.stride_tricks.sliding_window_view(padded, self.WIDTH, axis=1)  # rows, places, width
        x = self.p["embed"][window].reshape(len(codes), LENGTH, -1)
        hidden = np.maximum(x @ self.p["conv"] + self.p["bias"], 0)
        best = [hidden[:, a:b].argmax(axis=1) + a for a, b in self.PARTS]
        pooled = np.concatenate([np.take_along_axis(hidden, at[:, None, :], axis=1)[:, 0] for at in best], axis=1)
        return window, x, best, pooled, pooled @ self.p["out"] + self.p["shift"]

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(codes[k : k + 512])[4] for k in range(0, len(codes), 512)] or [np.empty(0)])

    def train(self, codes: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 3e-3, seed: int = 11, weights: tuple[float, float] | None = None) -> None:
        """Adam on the weighted log loss, a row weighing what its class does; without ``weights`` both classes weigh the same."""
        rng = np.random.default_rng(seed)
        other, own = weights or (0.5 * len(y) / max(1, (y == k).sum()) for k in (0, 1))
        weight = np.where(y == 1, own, other)
        first, second, step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
                window, x, best, pooled, z = self._forward(codes[rows])
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows] / len(rows)
                grads = {"out": pooled.T @ error, "shift": np.array([error.sum()])}
                back = np.where(pooled > 0, error[:, None] * self.p["out"], 0).reshape(len(rows), len(self.PARTS), self.FILTERS)
                grads["conv"], grads["bias"], grads["embed"] = np.zeros_like(self.p["conv"]), back.sum(axis=(0, 1)), np.zeros_like(self.p["embed"])
                for part, at in enumerate(best):
                    spots = np.take_along_axis(x, at[:, :, None], axis=1)  # rows, filters, inputs
                    grads["conv"] += np.einsum("rfi,rf->if", spots, back[:, part])
                    into = (back[:, part][:, :, None] * self.p["conv"].T[None]).reshape(len(rows), self.FILTERS, self.WIDTH, self.EMBED)
                    np.add.at(grads["embed"], window[np.arange(len(rows))[:, None], at], into)
                step += 1
                for k, g in grads.items():
                    g = g + 1e-4 * self.p[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)


@dataclass
class Scanner:
    """A network, its calibration ``sigmoid(slope * logit + shift)`` and the threshold on that."""

    network: CharCNN | None
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 1.1
    #: The share of held-back secrets that the threshold recalls.
    recall: float = 0.0

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.network.logits(codes) + self.shift, -30, 30)))

    def find(self, items: list[str]) -> list[list[tuple[str, int, int]]]:
        """All spans of each text: base findings and accepted candidates that touch none of them."""
        out, asked, codes = [], [], []
        for k, text in enumerate(items):
            base = base_findings(text)
            out.append(base)
            if self.network is None:
                continue
            for a, b in candidates(text):
                if not _touches(base, a, b):
                    own = windows(a, b)
                    asked.append((k, a, b, len(codes)))
                    codes += [encode(text, *w) for w in own]
        if asked:
            best = np.maximum.reduceat(self.probability(np.array(codes)), [at for *_, at in asked])
            for (k, a, b, _), p in zip(asked, best.tolist(), strict=True):
                if p >= self.threshold:
                    out[k] = [*out[k], ("learned", a, b)]
        return [sorted(spans, key=lambda f: (f[1], KINDS.index(f[0]))) for spans in out]


def _touches(base: list[tuple[str, int, int]], a: int, b: int) -> bool:
    return any(s < b and a < e for _, s, e in base)


def _platt(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit of the labels on the logits, which occur ``n`` times, lightly held to 1 and 0; steps are halved while they do not lower the loss."""
    w, x = np.array([1.0, 0.0]), np.stack([z, np.ones_like(z)], axis=1)

    def loss(w: np.ndarray) -> float:
        return float((n * np.logaddexp(0, -(2 * y - 1) * (x @ w))).sum() + 0.5 * ((w - [1.0, 0.0]) ** 2).sum())

    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - y)) + (w - [1.0, 0.0])
        step, now = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(2), g), loss(w)
        while loss(w - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
    return max(float(w[0]), 1e-3), float(w[1])


#: Kinds of labelled windows: of other candidates, of found secrets, of their characters in other alphabets.
OTHER, FOUND, FORM = 0, 1, 2
_LABELLED = "token long, codes binary, kind int"


def _token(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little", signed=True)


def _labelled(text: str) -> set[tuple[int, bytes, int]]:
    """``(token, codes, kind)`` of a text's candidates, with their surroundings and without; every form of a secret also where some other candidate of the text stands."""
    out = set()

    def add(kind: int, token: str, codes: np.ndarray) -> None:
        out.add((_token(token), codes.astype(np.uint8).tobytes(), kind))

    base, around = base_findings(text), []
    for a, b in candidates(text):
        if not _touches(base, a, b):
            for w in windows(a, b):
                codes = encode(text, *w)
                around.append(codes)
                add(OTHER, text[a:b], codes)
                add(OTHER, text[a:b], bare(codes))
        word = text[a:b].upper()
        if word != text[a:b]:
            add(OTHER, text[a:b], encode(word, 0, min(len(word), INSIDE)))
    for a, b in secrets_of(text):
        for w in windows(a, b):
            codes = encode(text, *w)
            add(FOUND, text[a:b], codes)
            add(FOUND, text[a:b], bare(codes))
        for k, form in enumerate(shapes(text[a:b])):
            codes = encode(form, 0, min(len(form), INSIDE))
            add(FORM, text[a:b], codes)
            if around:
                put = around[(_token(text[a:b]) + k) % len(around)].copy()
                put[BEFORE : BEFORE + INSIDE] = codes[BEFORE : BEFORE + INSIDE]
                add(FORM, text[a:b], put)
    return out


def _codes(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=np.uint8).reshape(-1, LENGTH).astype(np.int16)


def _trained(rows: DataFrame, parts: int, rounds: int, weights: tuple[float, float]) -> CharCNN:
    """A network trained in rounds: every part goes on from the same weights, whose means by rows start the next round."""
    network, context = CharCNN(), rows.sparkSession.sparkContext
    names, own = list(network.p), F.pmod(F.xxhash64("codes"), F.lit(parts)).alias("part")
    divided = rows.select(own, "codes", (F.col("kind") != OTHER).cast("int").alias("y"))

    def going_on(given, k: int):
        def go_on(key, part):
            order = sorted(zip(part["codes"].to_pylist(), part["y"].to_pylist(), strict=True))  # as they come is chance
            model = CharCNN()
            model.p = {n: v.copy() for n, v in given.value.p.items()}
            model.train(_codes([c for c, _ in order]), np.array([y for _, y in order]), epochs=1, seed=11 + 1000 * k + key[0].as_py() % 1000, weights=weights)
            flat = np.concatenate([model.p[n].ravel() for n in names]) * len(order)
            return pa.table({"at": pa.array(range(len(flat)), pa.int32()), "v": pa.array(flat), "n": pa.array([len(order)] * len(flat), pa.int64())})

        return go_on

    for k in range(rounds):
        go_on = going_on(context.broadcast(network), k)
        made = divided.groupBy("part").applyInArrow(go_on, "at int, v double, n long")
        flat, at = np.array([r.v for r in made.groupBy("at").agg((F.sum("v") / F.sum("n")).alias("v")).orderBy("at").collect()]), 0
        for n in names:
            size = network.p[n].size
            network.p[n] = flat[at : at + size].reshape(network.p[n].shape)
            at += size
    return network


def _counted(scores: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Steps of logits, ascending, and how many scores lie in each."""
    rows = scores.groupBy(F.floor(F.col("z") / STEP).alias("z")).agg(F.count("*").alias("n")).orderBy("z").collect()
    return np.array([r.z for r in rows], dtype=float) * STEP, np.array([r.n for r in rows], dtype=float)


def _at_share(z: np.ndarray, n: np.ndarray, share: float) -> float:
    """The step of the score below which this share of all lies."""
    return float(z[min(len(z) - 1, int(np.searchsorted(np.cumsum(n), np.floor(share * n.sum()), side="right")))])


def train_scanner(docs: DataFrame, text_column: str = "text", recall: float = RECALL) -> Scanner:
    """Train on the candidates of all documents.

    The secrets inside base findings are the labelled ones, candidates that no
    finding touches the others; distinct windows are stored once. Three tenths of
    the candidates, with all their windows, are held back for calibration and
    threshold, which read counts of their scores. The driver sees weights and
    counts only. With too few secrets there is no network and scans return base
    findings alone.
    """

    def label(batches):
        for batch in row_slices(batches):
            out = sorted(set().union(*map(_labelled, texts(batch))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.int32()))], names=["token", "codes", "kind"])

    found = docs.select(F.col(text_column).alias("text")).mapInArrow(label, _LABELLED)
    rows = stored(found.groupBy("token", "codes").agg(F.max("kind").alias("kind")), "windows")
    held = F.pmod("token", F.lit(10)) >= 7
    counts = {(r.kind, r.held): (r.n, r.tokens) for r in rows.groupBy("kind", held.alias("held")).agg(F.count("*").alias("n"), F.count_distinct("token").alias("tokens")).collect()}
    total = lambda kinds, which, k: sum(counts.get((kind, h), (0, 0))[k] for kind in kinds for h in which)
    if min(total([kind], (False, True), 1) for kind in (OTHER, FOUND)) < LEAST_FINDINGS or not total([FOUND], [True], 0):
        return Scanner(None)
    others, secrets = total([OTHER], [False], 0), total([FOUND, FORM], [False], 0)
    n = others + secrets
    parts = -(-n // PART)
    rounds = int(np.clip(-(-SEEN * parts // n), *ROUNDS))
    network = _trained(rows.where(~held), parts, rounds, (0.5 * n / max(1, others), 0.5 * n / max(1, secrets)))
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def score(batches):
        for batch in batches:
            codes = _codes(batch.column(1).to_pylist())
            z = np.clip(shared.value.logits(codes), -100, 100)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(codes[:, :BEFORE].any(axis=1)), pa.array(z, pa.float64())], names=["token", "kind", "placed", "z"])

    scores = stored(rows.where(held).mapInArrow(score, "token long, kind int, placed boolean, z double"), "scores")
    bins = [_counted(scores.where(F.col("kind") == kind)) for kind in (OTHER, FOUND)]
    z, n = (np.concatenate([b[k] for b in bins]) for k in (0, 1))
    slope, shift = _platt(z + STEP / 2, np.repeat([0.0, 1.0], [len(b[0]) for b in bins]), n)
    scanner = Scanner(network, slope, shift)
    # a held-back secret counts by its best window, as in a scan, and without the surroundings by which the patterns know it
    best, clean = (_counted(scores.where(which).groupBy("token").agg(F.max("z").alias("z"))) for which in ((F.col("kind") == FOUND) & ~F.col("placed"), F.col("kind") == OTHER))
    if not len(best[0]):
        return Scanner(None)
    shaped = _counted(scores.where(F.col("kind") == FORM))
    probability = lambda z: float(1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30))))
    highest = probability(min(_at_share(*x, 1 - recall) for x in (best, shaped) if len(x[0])))
    reached = probability(_at_share(*clean, 1 - CLEAN_REACH) + STEP) if len(clean[0]) else 0.0
    odds = lambda p: float(np.log(np.clip(p, 1e-9, 1 - 1e-9) / (1 - np.clip(p, 1e-9, 1 - 1e-9))))
    scanner.threshold = min(highest, float(1 / (1 + np.exp(-(odds(highest) + odds(reached)) / 2)))) if reached < highest else highest
    scanner.recall = float(sum(n for z, n in zip(*best, strict=True) if probability(z + STEP) >= scanner.threshold) / best[1].sum())
    return scanner


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def scan(docs: DataFrame, scanner: Scanner, keep: list[str], text_column: str = "text") -> DataFrame:
    """Columns ``keep``, ``n_assign, n_access, n_hex, base_sha256, spans`` of every document.

    A null or empty text has no spans. Repeated rows give repeated rows, equal
    texts equal spans. An empty table gives no rows. Other columns are not
    looked at, whatever their names.
    """
    own_text = free_name(keep, "text")
    rows = docs.select(*keep, F.col(text_column).alias(own_text))
    fields = rows.schema.fields[:-1]
    more = [T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")] + [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")]
    schema = T.StructType([*fields, *more])
    shared = docs.sparkSession.sparkContext.broadcast(scanner)

    def find(batches):
        for batch in row_slices(batches, own_text):
            out = []
            for spans in shared.value.find(texts(batch, own_text)):
                base = [s for s in spans if s[0] != "learned"]
                out.append((*[sum(s[0] == kind for s in base) for kind in KINDS[:3]], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*[column(batch, f.name) for f in fields], *[pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]], names=schema.names)

    return rows.mapInArrow(find, schema)


def _masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, scanner: Scanner, text_column: str = "text", length_column: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``[SECRET]`` in its text; all other columns and rows as they are.

    ``length_column``, if named, gets the new number of characters of changed
    texts. Null texts stay null, an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scanner)

    def mask(batches):
        for batch in row_slices(batches, text_column):
            at = batch.schema.get_field_index(text_column)
            old = batch.column(at).to_pylist()
            new = [t if t is None or not spans else _masked(t, spans) for t, spans in zip(old, shared.value.find([t or "" for t in old]), strict=True)]
            out = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            if length_column is not None:
                spot = batch.schema.get_field_index(length_column)
                sizes = [len(b) if a != b else n for a, b, n in zip(old, new, batch.column(spot).to_pylist(), strict=True)]
                out = out.set_column(spot, batch.schema.field(spot), pa.array(sizes, batch.schema.field(spot).type))
            yield out

    return docs.mapInArrow(mask, docs.schema)
