"""Repair of conversation structure by the cheapest edits, with Four-Russians block tables.

A conversation is a string of symbols, one for each row (its role's initial, and
whether it must go or is truncated). What the rest of a conversation still costs
from each of four states of the pattern ``(s?(ua)+)?`` is a vector of four costs.
Less its smallest entry it takes few values, so for every vector and every block
of :data:`BLOCK` symbols the vector before the block is looked up in a table.
Conversations are run through block by block from their end; the edits are then
read off from the start, each block expanded backward from the vector behind it,
so that of equally cheap edits the least in ASCII is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import column

#: Symbols in a block.
BLOCK = 4
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3

# States: nothing yet, after system, after user, after assistant. Symbols: 0 must
# go, 1 + 2 * initial + truncated for the initials s, u, a and others, 9 none.
INITIALS = "sua"
SYMBOLS, NONE = 10, 9
_KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
_NEXT = (2, 2, 3, 2)  # where a user or assistant turn leads that is put in or renamed
ROLES = {2: "user", 3: "assistant"}
#: Lines between repaired turns.
LINE = b"\n"


def _with_inserts(costs: list[int]) -> list[int]:
    """Costs from each state if turns may be put in first. Three rounds reach every state."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[_NEXT[s]]) for s, c in enumerate(costs)]
    return costs


def moves(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """``(edit, cost, next state)`` of all ways to take a row, in ASCII order of the edits."""
    if symbol == NONE:
        return [("", 0, state)]
    out = [("D", DELETE, state)]
    if symbol:
        initial, more = divmod(symbol - 1, 2)
        if (state, initial) in _KEPT:
            out.append(("K", more * TRUNCATED, _KEPT[state, initial]))
        out.append(("R", REROLE + more * TRUNCATED, _NEXT[state]))
    return out


def before(symbol: int, costs: list[int]) -> list[int]:
    """Costs from each state before a row, by those behind it."""
    taken = [min(cost + costs[to] for _, cost, to in moves(symbol, s)) for s in range(4)]
    return taken if symbol == NONE else _with_inserts(taken)


class BlockTables:
    """Transitions of normalised cost vectors for every block of symbols, and expanded blocks once they were met."""

    def __init__(self, size: int = BLOCK) -> None:
        self.size = size
        far = 1 << 20
        end = _with_inserts([0, far, far, 0])
        self.vectors: list[tuple[int, ...]] = [tuple(end)]
        known = {self.vectors[0]: 0}
        after, added = [], []
        for vector in self.vectors:  # grows while it is gone through
            for symbol in range(SYMBOLS):
                new = before(symbol, list(vector))
                low = min(new)
                rest = tuple(x - low for x in new)
                if rest not in known:
                    known[rest] = len(self.vectors)
                    self.vectors.append(rest)
                after.append(known[rest])
                added.append(low)
        one, cost = (np.array(x, dtype=np.int32).reshape(-1, SYMBOLS) for x in (after, added))
        self.to, self.cost = one, cost
        for _ in range(size - 1):  # a symbol is put before the blocks so far
            self.cost = (self.cost[:, None, :] + cost[self.to].transpose(0, 2, 1)).reshape(len(one), -1)
            self.to = one[self.to].transpose(0, 2, 1).reshape(len(one), -1)
        self.places = SYMBOLS ** np.arange(size - 1, -1, -1)
        self._expanded: dict[tuple[int, int, int], tuple[str, int]] = {}

    def expand(self, code: int, behind: int, state: int) -> tuple[str, int]:
        """The edits of one block entered in ``state``, and the state behind it."""
        key = code, behind, state
        if key not in self._expanded:
            symbols = [code // int(p) % SYMBOLS for p in self.places]
            costs = [list(self.vectors[behind])]
            for symbol in reversed(symbols):
                costs.append(before(symbol, costs[-1]))
            costs.reverse()
            edits = []
            for at, symbol in enumerate(symbols):
                while True:
                    left = costs[at][state]
                    ways = [*moves(symbol, state), ("I", INSERT, _NEXT[state])] if symbol != NONE else moves(symbol, state)
                    edit, cost, to = min((e, c, t) for e, c, t in ways if c + (costs[at] if e == "I" else costs[at + 1])[t] == left)
                    edits.append(edit)
                    state = to
                    if edit != "I":
                        break
            self._expanded[key] = "".join(edits), state
        return self._expanded[key]

    def solve(self, symbols: bytes | np.ndarray) -> tuple[int, str]:
        """The least cost of a conversation, and of the cheapest edits the least in ASCII."""
        codes = np.frombuffer(symbols, dtype=np.uint8) if isinstance(symbols, bytes | bytearray) else symbols
        full = np.full(-(-len(codes) // self.size) * self.size, NONE, dtype=np.int64)
        full[: len(codes)] = codes
        blocks = (full.reshape(-1, self.size) @ self.places).tolist()
        behind, vector, cost = [], 0, 0
        for code in reversed(blocks):
            behind.append(vector)
            cost += int(self.cost[vector, code])
            vector = int(self.to[vector, code])
        state, edits = 0, []
        for code in blocks:
            more, state = self.expand(code, behind.pop(), state)
            edits.append(more)
        while state in (1, 2):
            edits.append("I")
            state = _NEXT[state]
        return cost + self.vectors[vector][0], "".join(edits)


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows ``conv_id, turn, role, text, copies`` of damaged conversations, by the checksum of ``conv_id:turn``.

    Of twenty rows one is dropped (no copies), one emptied, one loses its ends of
    sentences, one is repeated and one set to user. Nulls count as one blank.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.encode(F.concat(filled(conv), F.lit(":"), filled(turn)), "UTF-8")), F.lit(20))
    return turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.when(kind == 4, "user").otherwise(filled(role)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(filled(text), "[.!?]", "")).otherwise(filled(text)).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


_BLANKS = " \t\n\v\f\r"
#: Order of a conversation's rows; the digest stands for the text.
ORDER = ("conv_id", "known", "turn", "role", "mark")


def _slim(rows: DataFrame) -> DataFrame:
    """Equal rows as one, without their texts: what an edit script depends on."""
    ending = F.substring(F.rtrim("text", F.lit(_BLANKS)), -1, 1)
    equal = (
        rows.select("conv_id", F.col("turn").isNotNull().alias("known"), "turn", "role", F.md5("text").alias("mark"), "copies", (ending == "").alias("blank"), (~ending.isin(".", "!", "?")).alias("cut"))
        .groupBy("conv_id", "known", "turn", "role", "mark")
        .agg(F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    )
    seen = equal.where("copies > 0").groupBy("conv_id", "role", "mark").agg(F.min(F.struct("known", "turn")).alias("seen"))
    seen = seen.select(*[F.col(c).alias(f"s_{c}") for c in ("conv_id", "role", "mark")], "seen")
    same = F.col("conv_id").eqNullSafe(F.col("s_conv_id")) & (F.col("role") == F.col("s_role")) & (F.col("mark") == F.col("s_mark"))
    first = F.coalesce(F.struct("known", "turn").eqNullSafe(F.col("seen")), F.lit(False))
    initial = F.coalesce(*[F.when(F.substring("role", 1, 1) == c, k) for k, c in enumerate(INITIALS)], F.lit(3))
    return equal.join(seen, same, "left").select("conv_id", "known", "turn", "role", "mark", "copies", "blank", "cut", first.alias("first"), initial.cast("int").alias("initial"))


def _by_conversation(rows: DataFrame, *more: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in (*ORDER[:1], *more, *ORDER[1:])])


STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_STATS = ", ".join(f"{c} long" for c in STATS)
_LEGAL = np.zeros(16, dtype=bool)
_LEGAL[[4 * 0 + 1, 4 * 1 + 2, 4 * 2 + 1]] = True


class _Conversation:
    """What is known of one conversation while its rows come by: one byte for each row, and counts."""

    def __init__(self, ident) -> None:
        self.ident, self.symbols = ident, bytearray()
        self.low = self.high = self.turn = self.initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, copies: int, blank: bool, cut: bool, first: bool, initial: int) -> None:
        if not copies:
            return
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
            self.turns += 1
        if blank:
            self.blank += copies
        else:
            self.duplicate += copies - first
            self.truncated += first and cut
        if self.initial is not None:
            self.illegal += not _LEGAL[4 * self.initial + initial]
        self.illegal += copies - 1  # a role beside itself
        self.initial = initial
        if first and not blank:
            self.symbols.append(1 + 2 * initial + cut)
            copies -= 1
        self.symbols += bytes(copies)

    def row(self, tables: BlockTables) -> tuple:
        cost, audit = tables.solve(self.symbols)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.ident, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


_OUT_ROWS, _OUT_BYTES = 4096, 4 << 20


def _streamed(rows: DataFrame, make, fields: str) -> DataFrame:
    """``mapInArrow`` with ``make(batches)``, a generator of tuples ``(conv_id, ...)``; ``fields`` are the other columns."""
    schema = T.StructType([rows.schema["conv_id"], *T._parse_datatype_string(fields).fields])
    arrow = to_arrow_schema(schema)

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = [], 0
        for row in make(batches):
            held.append(row)
            room += sum(len(x) for x in row[1:] if isinstance(x, str))
            if len(held) >= _OUT_ROWS or room >= _OUT_BYTES:
                yield _batch(held, arrow)
                held, room = [], 0
        if held:
            yield _batch(held, arrow)

    return rows.mapInArrow(batches_of, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def edit_scripts(rows: DataFrame) -> DataFrame:
    """Faults and cheapest edits of each conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``.

    ``rows`` are ``conv_id, turn, role, text, copies``, as :func:`damage` gives
    them. Rows come by turn (null first); those of one turn by role, then by the
    MD5 of the text. Rows with a null conv_id are one conversation. A
    conversation without rows (no copies) has zeros and no edits.
    A task holds one byte for each row of the conversation that it is at, as
    its script has one character for each; texts are not brought here.
    """

    def scripts(batches):
        tables, now = BlockTables(), None
        for batch in batches:
            values = [column(batch, c).to_pylist() for c in ("conv_id", "turn", "copies", "blank", "cut", "first", "initial")]
            for ident, *row in zip(*values, strict=True):
                if now is None or now.ident != ident:
                    if now is not None:
                        yield now.row(tables)
                    now = _Conversation(ident)
                now.add(*row)
        if now is not None:
            yield now.row(tables)

    return _streamed(_by_conversation(_slim(rows)), scripts, _STATS + ", audit string")


def _with_scripts(rows: DataFrame, scripts: DataFrame) -> DataFrame:
    """Each conversation's script, then its rows in order."""
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    head = scripts.select("conv_id", F.lit(True).alias("known"), none("turn", rows.schema["turn"].dataType), none("role", "string"), none("mark", "string"), none("text", "string"), F.lit(0).cast("long").alias("copies"), *STATS, "audit", F.lit(0).alias("part"))
    body = rows.where("copies > 0").select("conv_id", F.col("turn").isNotNull().alias("known"), "turn", "role", F.md5("text").alias("mark"), "text", "copies", *[none(c, "long") for c in STATS], none("audit", "string"), F.lit(1).alias("part"))
    return _by_conversation(head.unionByName(body), "part")


class _Replay:
    """Carries out a script over the rows of a conversation as they come by."""

    def __init__(self, audit: str) -> None:
        self.edits, self.at, self.state = audit, 0, 0

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.at += 1
            self.state = _NEXT[self.state]
            yield "I", ROLES[self.state], ""

    def turns(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """What a row becomes: turns put in before it, and itself unless deleted."""
        yield from self.inserts()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            self.state = _KEPT[self.state, INITIALS.index(role[0])]
            yield edit, role, text
        elif edit == "R":
            self.state = _NEXT[self.state]
            yield edit, ROLES[self.state], text


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Runs conversations through their scripts: ``(conv_id, stats, turn)`` for every turn, with turn None at the end of each."""
    names = ("conv_id", "part", "role", "text", "copies", "audit", *STATS)
    replay, ident, stats = None, None, ()
    for batch in batches:
        for conv, part, role, text, copies, audit, *more in zip(*[column(batch, c).to_pylist() for c in names], strict=True):
            if part == 0:
                if replay is not None:
                    yield from ((ident, stats, x) for x in (*replay.inserts(), None))
                replay, ident, stats = _Replay(audit), conv, (*more, audit)
            else:
                for _ in range(copies):
                    yield from ((ident, stats, x) for x in replay.turns(role, text))
    if replay is not None:
        yield from ((ident, stats, x) for x in (*replay.inserts(), None))


def repaired_turns(rows: DataFrame, scripts: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, place`` (from 0) ``, edit`` (K, R or I) ``, role, text``.

    Kept and renamed rows keep their texts, even if truncated. Rows stream by in
    order; no conversation is held.
    """

    def turns(batches):
        place = 0
        for ident, _, x in _replayed(batches):
            if x is None:
                place = 0
            else:
                yield ident, place, *x
                place += 1

    return _streamed(_with_scripts(rows, scripts), turns, "place long, edit string, role string, text string")


def repair_digests(rows: DataFrame, scripts: DataFrame) -> DataFrame:
    """The scripts with ``repaired_sha256``, of the repaired turns as lines ``role:text``, fed turn by turn."""

    def digests(batches):
        digest, line = hashlib.sha256(), b""
        for ident, stats, x in _replayed(batches):
            if x is None:
                yield ident, *stats, digest.hexdigest()
                digest, line = hashlib.sha256(), b""
            else:
                digest.update(line + f"{x[1]}:{x[2]}".encode())
                line = LINE

    return _streamed(_with_scripts(rows, scripts), digests, _STATS + ", audit string, repaired_sha256 string")


def repair_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Damages conversations, then reports their faults, the cheapest repair and its digest, one row for each ``conv_id``.

    Nulls in role and text count as one blank, so a null text is a blank row.
    Empty tables give no rows; very long texts are hashed as they pass; other
    columns are not looked at.
    """
    rows = damage(turns, conv, turn, role, text)
    return repair_digests(rows, edit_scripts(rows))
