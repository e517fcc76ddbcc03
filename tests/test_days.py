"""Day tables: filters spare old files, compaction changes no result, replays and expiry work across it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from medialake.sources.days import DayTable
from medialake.sources.scratch import fresh_path

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id string, occurred_at timestamp, n int"


def rows(spark, ids, day, n=0):
    return spark.createDataFrame([(f"e{i}", START + dt.timedelta(days=day, minutes=i % 900), n) for i in ids], SCHEMA)


def state(table, **kw):
    return sorted((r.event_id, r.n) for r in table.read(**kw).collect())


@pytest.fixture()
def table(spark):
    out = DayTable(spark, fresh_path(spark, "days"), SCHEMA, "occurred_at", ident="event_id", blocks=8)
    for day in range(3):
        for part in range(3):
            out.put(rows(spark, range(100 * day + 10 * part, 100 * day + 10 * part + 10), day), f"b{day}{part}")
    return out


def test_new_ids_open_no_stored_file(spark, table, monkeypatch):
    opened = []
    real = DayTable.read
    monkeypatch.setattr(DayTable, "read", lambda self, *a, **kw: opened.append((a, kw)) or real(self, *a, **kw))
    assert table.stored_before(rows(spark, range(5000, 5040), 2), START).count() == 0 and opened == []
    again = table.stored_before(rows(spark, [105, 106, 7777], 2), START)
    assert sorted(r.event_id for r in again.collect()) == ["e105", "e106"]
    assert opened[0][0][2] == [dt.date(2024, 1, 2)]  # one day of three
    assert table.stored_before(rows(spark, range(100, 110), 1), START, but="b10").count() == 0  # a batch does not meet itself
    assert table.stored_before(rows(spark, [5], 0), START + dt.timedelta(days=1)).count() == 0  # before the horizon


def test_filters_have_every_id(spark, table):
    for i in (0, 29, 110, 215):
        assert dt.date(2024, 1, 1 + i // 100) in table.days_with(rows(spark, [i], 0), START)
    assert len(table.days_with(rows(spark, range(9000, 9200), 0), START)) <= 2


def test_compaction(spark, table):
    before = state(table)
    assert table.compact(dt.date(2024, 1, 3)) == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)] and table.compact(dt.date(2024, 1, 3)) == []
    assert state(table) == before
    table.put(rows(spark, range(10), 0, n=5), "b00")  # a batch of a joined day again: the same rows, which stay hidden
    assert state(table) == before
    assert table.stored_before(rows(spark, range(10), 0), START, but="b00").count() == 0
    table.put(rows(spark, range(40, 45), 0), "late")
    with_late = sorted(before + [(f"e{i}", 0) for i in range(40, 45)])
    assert state(table) == with_late
    table.vacuum()
    assert state(table) == with_late and table._names(f"{table.path}/day=2024-01-01", "batch=") == ["late"]
    assert table.compact(dt.date(2024, 1, 2)) == [dt.date(2024, 1, 1)] and state(table) == with_late
    table.vacuum()
    assert state(table) == with_late
    assert state(table, days=[dt.date(2024, 1, 2)]) == sorted((f"e{i}", 0) for i in range(100, 130))
    assert [e for e, _ in state(table, but="late")] == sorted(e for e, _ in before)


def test_expiry_of_joined_days(spark, table):
    table.compact(dt.date(2024, 1, 3))
    table.expire(1, START + dt.timedelta(days=2, hours=1))
    assert {e for e, _ in state(table)} == {f"e{i}" for day in (1, 2) for i in range(100 * day, 100 * day + 30)}
    assert table._names(f"{table.path}/_filters", "day=") == ["2024-01-02", "2024-01-03"]
    table.vacuum()
    assert len(state(table)) == 60


def test_a_table_never_written(spark):
    table = DayTable(spark, fresh_path(spark, "days"), SCHEMA, "occurred_at", ident="event_id")
    assert state(table) == [] and table.stored_before(rows(spark, [1], 0), START).count() == 0 and table.compact(dt.date(2024, 1, 1)) == []
    table.expire(1, START)
    with pytest.raises(Exception, match="occurred_at is missing"):
        table.put(spark.createDataFrame([("a", None, 1)], SCHEMA), "b")
