"""Bucketed tables: only touched files are written again, scans open only files that can match, writers do not overwrite each other."""

import pytest
from pyspark.sql import functions as F

from medialake.sources import pointer
from medialake.sources.buckets import BucketTable
from medialake.sources.scratch import fresh_path
from medialake.sources.tables import Policy

SCHEMA = "k int, name string, at date, n double, tags array<string>"


def rows(spark, low, high, step=1, name="v1"):
    return spark.range(low, high, step).select(
        F.col("id").cast("int").alias("k"), F.concat(F.lit(name), F.lit("-" * 40), F.col("id").cast("string")).alias("name"),
        F.date_add(F.lit("2020-01-01"), F.col("id").cast("int")).alias("at"), F.when(F.col("id") % 5 > 0, F.col("id") / 2).alias("n"), F.array(F.lit("x")).alias("tags"),
    )


@pytest.fixture()
def stored(spark):
    table = BucketTable(spark, fresh_path(spark, "buckets"), SCHEMA, ["k"], buckets=8)
    table.replace(rows(spark, 0, 400))
    return table


def names(table, version=None):
    return {r.file: r.bucket for r in table.files(version).collect()}


def test_upsert_rewrites_touched_buckets_only(spark, stored):
    before = names(stored)
    assert sorted(before.values()) == list(range(8))
    touched = {r[0] for r in spark.createDataFrame([(7,), (1007,)], "k int").select(F.pmod(F.hash("k"), F.lit(8))).collect()}
    source = spark.createDataFrame([(7, "new"), (1007, "more")], "k int, name string")
    stored.upsert(source, {"name": Policy.COALESCE_NONEMPTY})
    after = names(stored)
    assert {f for f, b in before.items() if b not in touched} == {f for f, b in after.items() if f in before}
    assert {b for f, b in after.items() if f not in before} == touched
    now = {r.k: r for r in stored.read().collect()}
    assert len(now) == 401 and now[7].name == "new" and now[7].n == 3.5 and now[1007].name == "more" and now[1007].n is None and now[8].name.startswith("v1")
    assert {r.k for r in stored.read(1).collect()} == set(range(400))  # the old version can still be read


def test_join_exchanges_the_source_only(spark, stored):
    seen = []

    def merge(old, new):
        out = old.join(new.select("k", F.lit(1).alias("there")), "k", "full").select(old.columns)
        seen.append(out._jdf.queryExecution().sparkPlan().toString() + out._jdf.queryExecution().executedPlan().toString())
        return out

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored.change(rows(spark, 0, 300), merge)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = seen[0]
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(k") == 1 and stored.read().count() == 400


def test_other_changes(spark, stored):
    before = names(stored)
    stored.insert_absent(rows(spark, 390, 410).unionByName(rows(spark, 405, 408, name="again")))
    assert before.items() < names(stored).items() and stored.read().count() == 410
    stored.update_from(spark.createDataFrame([(3, 99.0), (5000, 1.0)], "k int, n double"), ["n"])
    assert stored.read().count() == 410 and stored.scan(("k", "=", 3)).first().n == 99.0
    stored.remove(spark.createDataFrame([(3,), (4,)], "k int"))
    assert stored.read().count() == 408
    stored.reset_then_set(spark.createDataFrame([(9, 7.0)], "k int, n double"), ["n"])
    assert [r.k for r in stored.read().where("n IS NOT NULL").collect()] == [9]
    at = stored.version()
    assert stored.upsert(rows(spark, 0, 0)) == at  # nothing to do, no version


def test_scans_open_what_can_match(spark):
    table = BucketTable(spark, fresh_path(spark, "buckets"), SCHEMA, ["k"], buckets=8)
    assert table.read().count() == 0 and table.scan(("k", "=", 1)).count() == 0
    for part in range(4):  # four files a bucket, each with its range of days
        table.insert_absent(rows(spark, 100 * part, 100 * part + 100))
    assert len(names(table)) == 32
    one = table.scan(("k", "=", 123))
    assert [r.k for r in one.collect()] == [123] and len(one.inputFiles()) == 1
    days = table.scan(("at", ">=", "2020-04-20"), ("at", "<", "2020-04-25"))
    assert sorted(r.k for r in days.collect()) == [110, 111, 112, 113, 114] and len(days.inputFiles()) <= 8
    assert table.matching(("at", ">", "2030-01-01")) == [] and table.scan(("at", ">", "2030-01-01")).count() == 0
    assert table.scan(("n", "is", None)).count() == 80 and table.matching(("name", "is", None)) == []
    assert table.scan(("name", ">=", "v1" + "-" * 40 + "99")).count() == table.read().where(F.col("name") >= "v1" + "-" * 40 + "99").count() > 0
    assert len(table.matching(("name", "<=", "v0"))) == 0
    assert table.scan().count() == 400


def test_writers_do_not_overwrite_each_other(spark, stored):
    at = stored.version()

    def merge(old, new):
        stored.upsert(rows(spark, 900, 901))  # another writer comes first
        return old

    with pytest.raises(pointer.ConcurrentWrite):
        stored.change(rows(spark, 0, 1), merge)
    assert stored.version() == at + 1 and stored.read().count() == 401


def test_vacuum_keeps_what_versions_name(spark, stored):
    for n in range(3):
        stored.upsert(rows(spark, n, n + 1, name=f"w{n}"))
    want = sorted(map(str, stored.read().collect()))
    last = set(names(stored)) | set(names(stored, stored.version() - 1))
    gone = stored.vacuum(keep=2)
    assert gone and not last & set(gone) and stored.vacuum(keep=2) == []
    assert sorted(map(str, stored.read().collect())) == want and stored.read(stored.version() - 1).count() == 400


def test_readers_see_old_or_new_documents(spark, monkeypatch):
    """At every step of a write a reader finds all old documents or all new ones."""
    from medialake.sources import readers, tables

    path, seen = fresh_path(spark, "json"), []
    videos = lambda n: spark.range(n).select(F.col("id").cast("string").alias("video_id"))
    look = lambda: seen.append(readers.read_videos(spark, path).count())
    tables.write_json(videos(10), path)
    for step in ("publish", "drop_before"):
        real = getattr(pointer, step)
        monkeypatch.setattr(pointer, step, lambda *a, real=real: (look(), real(*a), look())[1])
    tables.write_json(videos(25).repartition(3), path)
    assert seen == [10, 25, 25, 25]
    monkeypatch.setattr(pointer, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        tables.write_json(videos(3), path)
    look()
    assert seen[-1] == 25


def test_marks_do_not_change(spark, monkeypatch):
    """Of two writers that saw the same state the second fails, even if it looked before the first was done."""
    path = fresh_path(spark, "marks")
    assert pointer.current(spark, path) == (0, None) and pointer.resolve(spark, path) == path
    assert pointer.publish(spark, path, "a", 0) == 1
    with pytest.raises(pointer.ConcurrentWrite):
        pointer.publish(spark, path, "b", 0)
    monkeypatch.setattr(pointer, "numbers", lambda *a: [])
    with pytest.raises(pointer.ConcurrentWrite):
        pointer.publish(spark, path, "b", 0)
    monkeypatch.undo()
    assert pointer.resolve(spark, path) == f"{path}/a" and pointer.publish(spark, path, "b", 1) == 2 and pointer.current(spark, path) == (2, "b")
