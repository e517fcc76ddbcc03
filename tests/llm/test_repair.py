"""Repair of conversations against a plain search for the cheapest edits."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from medialake.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, copies int, mark string, known string"


def cheapest(rows):
    """``rows`` are (initial, gone, cut); the least (cost, edits) that give (s?(ua)+)?, edits in ASCII order."""
    leads = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    renamed = {"": "u", "s": "u", "a": "u", "u": "a"}
    best = {"": (0, "")}

    def inserted(best):
        out = dict(best)
        for _ in range(3):
            for state, (cost, edits) in list(out.items()):
                new = cost + 3, edits + "I"
                if new < out.get(renamed[state], (10**9,)):
                    out[renamed[state]] = new
        return out

    for initial, gone, cut in rows:
        now = {}
        for state, (cost, edits) in inserted(best).items():
            ways = [("D", 4, state)]
            if not gone:
                ways += [("K", 3 * cut, leads[state, initial])] if (state, initial) in leads else []
                ways += [("R", 3 + 3 * cut, renamed[state])]
            for edit, more, to in ways:
                new = cost + more, edits + edit
                if new < now.get(to, (10**9,)):
                    now[to] = new
        best = now
    best = inserted(best)
    return min(best[s] for s in ("", "a") if s in best)


def brute(table):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in table:
        rows = convs[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, marks, n = set(), [], collections.Counter()
        for _, role, text in rows:
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            marks.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = cheapest(marks)
        lines, last, at = [], "", 0
        for edit in audit:
            _, role, text = rows[at] if edit != "I" else (0, "", "")
            at += edit != "I"
            if edit in "RI":
                role = "assistant" if last == "u" else "user"
            if edit != "D":
                lines.append(f"{role}:{text}")
                last = role[:1]
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def table(seed=1):
    rng = random.Random(seed)
    rows = []
    for conv in range(150):
        for turn in range(rng.randrange(1, 14)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "student", "", None, "User"])
            text = rng.choice(["Yes.", "No!", "cut off", "Why? \n", "", " \t\r\n", None, f"é{turn}.", "a ", "x. "])
            rows.append((conv, rng.choice([turn, turn, turn, 3 * turn, None]), role, text))
    rows += [(None, k, "user" if k % 2 == 0 else "assistant", f"t{k}.") for k in range(9)]
    rows += [(500, 1, "user", "long " * 40_000), (500, 2, "assistant", "y" * 100_000 + "."), (501, -4, "user", "Hi."), (501, 7, "assistant", "Hi.")]
    rows += [rows[3], rows[3], rows[-1]]
    rows += [(600, k, "user", "same.") for k in range(40)]
    dropped = next(k for k in range(1000) if zlib.crc32(f"700:{k}".encode()) % 20 == 0)
    return [*rows, (700, dropped, "user", "Gone.")]


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 9, "clash", "clash") for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("parts", [1, 7])
def test_repair(spark, parts):
    rows = table()
    got = repair.repair_conversations(frame(spark, rows, parts))
    assert got.columns == ["conv_id", *repair.STATS, "audit", "repaired_sha256"]
    want = brute(rows)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert (700, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in want


def test_turns_are_those_of_the_digest(spark):
    damaged = repair.damage(frame(spark, table(2)))
    scripts = repair.edit_scripts(damaged)
    lines = collections.defaultdict(list)
    for r in sorted(repair.repaired_turns(damaged, scripts).collect(), key=lambda r: r.place):
        assert r.place == len(lines[r.conv_id])
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for r in repair.repair_digests(damaged, scripts).collect():
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines[r.conv_id]).encode()).hexdigest()


def test_empty_table(spark):
    assert repair.repair_conversations(frame(spark, [])).count() == 0


@pytest.mark.parametrize("size", [1, 2, 4])
def test_blocks(size):
    """Every short string of symbols, and long ones, whatever the length of a block."""
    tables, rng = repair.BlockTables(size), random.Random(4)
    strings = [[a, b, c] for a in range(9) for b in range(9) for c in range(9)] + [[rng.randrange(9) for _ in range(rng.randrange(30))] for _ in range(500)]
    for symbols in strings:
        rows = [("suax"[(x - 1) // 2] if x else "u", x == 0, bool(x) and (x - 1) % 2 == 1) for x in symbols]
        assert tables.solve(bytes(symbols)) == cheapest(rows)
    assert len(tables.vectors) < 100 and tables.to.shape == (len(tables.vectors), 10**size)


def test_rows_come_in_many_batches(spark):
    """A conversation of more rows than an Arrow batch holds."""
    rows = [(1, k, ("user", "assistant")[k % 2], f"t{k}.") for k in range(25_000)] + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        assert sorted(map(tuple, repair.repair_conversations(frame(spark, rows)).collect()), key=repr) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
