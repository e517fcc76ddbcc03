"""Cases that the operators once got wrong."""

import datetime as dt

from pyspark.sql import functions as F

from medialake.functions import text as x
from medialake.operators import aggs, joins
from medialake.plans import studies
from medialake.sources import readers, tables


def test_json_documents_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/videos"
    for n in (100, 7):  # the second replaces the first
        tables.write_json(spark.range(n).select(F.col("id").cast("string").alias("video_id"), F.lit("t").alias("title")).repartition(3), path)
        assert sorted(int(r.video_id) for r in readers.read_videos(spark, path).collect()) == list(range(n))


def test_json_documents_are_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "DOCUMENT_ROWS", 10)
    path = f"file://{tmp_path}/videos"
    tables.write_json(spark.range(95).select(F.col("id").cast("string").alias("video_id")).coalesce(1), path)
    assert readers.read_videos(spark, path).count() == 95
    assert len(list((tmp_path / "videos").glob("documents-*/part-*"))) == 10


def test_equal_titles_stay_rows(spark):
    books = spark.createDataFrame([(0, "genesis", "Gênesis"), (1, "romanos", "Romanos")], "position int, folded string, book string")
    titles = spark.createDataFrame([("a romanos genesis",), ("a romanos genesis",), ("romanosx",), (None,)], "t string")
    got = sorted((r.t or "", r.book or "") for r in joins.match_books(titles, books, "t", "t").collect())
    assert got == [("", ""), ("a romanos genesis", "Gênesis"), ("a romanos genesis", "Gênesis"), ("romanosx", "")]


def test_descendants_of_a_long_chain(spark):
    tree = spark.createDataFrame([(str(i), str(i - 1)) for i in range(1, 56)] + [("0", None), ("x", "55"), ("55", "x")], "id string, parent string")
    got = {r.id: r.level for r in joins.descendants(tree, "id", "parent", "0").collect()}
    assert len(got) == 57 and got["x"] == 56


def test_dates_in_runs(spark):
    cases = {"1-2-03-04": "2003-02-01", "2001/02/03/04": "2001-02-03,2004-03-02", "31.12.1999 e 1/1/20": "1999-12-31,2020-01-01", "40/40/2001": "", "1--2-2003": "", "12_05_1887": "", "2020-13-01": "", "123/4/2001": "", "": ""}
    for raw, want in cases.items():
        assert spark.range(1).select(F.array_join(x.explicit_dates(F.lit(raw)), ",")).first()[0] == want, raw


def test_study_titles(spark):
    cases = {"CTB: Estudo - Fé [x] e obras | CTB 2021": "Fé e obras", "CTB:CTB|Estudo Fé": "Fé", "Estudos da fé": "Estudos da fé", "Fé | CTB 21": "Fé | CTB 21", "CONFERÊNCIA": "CONFERÊNCIA", "[x]": "[x]", "a [] b": "a [] b", "Fé|ctb  1999 ": "Fé"}
    for raw, want in cases.items():
        assert spark.range(1).select(x.clean_study_title(F.lit(raw))).first()[0] == want, raw


def test_groups_without_rows(spark):
    studies, resources = spark.createDataFrame([(1,), (2,)], "study_id long"), spark.createDataFrame([(1,), (1,)], "study_id long")
    assert {r.study_id: r.resource_count for r in aggs.resource_counts(studies, resources).collect()} == {1: 2, 2: 0}
    days = spark.createDataFrame([(dt.date(2024, 1, 7),), (dt.date(2024, 1, 14),), (dt.date(2024, 1, 21),)], "day date")
    why = spark.createDataFrame([(dt.date(2024, 1, 21), "feriado")], "day date, reason string")
    gaps = joins.calendar_gaps(days, days.limit(1), why).orderBy("day").collect()
    assert [(r.day.day, r.reason) for r in gaps] == [(14, None), (21, "feriado")]


def test_bare_addresses(spark):
    html = "see (//a.example.net/x.pdf), [HTTPS://a.example.net/y.mp3] https://a.example.net/y.mp3. https://a.example.net/none <a href='/z.pdf'>z</a> https://b.example.net/z.pdf xhttps://a.example.net/w.pdf <b>null</b>"
    pages = spark.createDataFrame([(1, "https://b.example.net/p", html), (2, "http://b.example.net/", None), (3, "http://b.example.net/", "//a.example.net/x.pdf")], "page_id long, url string, html string")
    links = sorted((r.page_id, r.position, r.is_raw, r.url) for r in studies.extract_links(pages).collect())
    assert links[0] == (1, 1, False, "https://b.example.net/z.pdf")
    assert [u.lower() for _, _, raw, u in links if raw] == ["https://a.example.net/x.pdf", "https://a.example.net/y.mp3", "https://a.example.net/w.pdf", "http://a.example.net/x.pdf"]
    assert [p for _, p, _, _ in links] == [1, 2, 3, 4, 1]
