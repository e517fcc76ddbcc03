"""Likeness of words, and books that stand inside longer words."""

from pyspark.sql import functions as F

from medialake.functions.similar import is_similar
from medialake.operators import joins
from medialake.plans import talks

WORDS = [
    ("romanos", "romanos", True),
    ("romanoss", "romanos", True),
    ("romanosxx", "romanos", False),
    ("oromanos", "romanos", True),
    ("romano", "romanos", True),
    ("ramonos", "romanos", False),
    ("joao1", "joao1", False),
    ("canticodoscanticos", "cantico dos canticos", True),
    ("", "", True),
    ("", "atos", False),
    (None, "atos", None),
]


def test_is_similar(spark):
    rows = spark.createDataFrame(WORDS, "l string, r string, want boolean")
    for row in rows.withColumn("got", is_similar("l", "r")).collect():
        assert row.got == row.want, row
    assert rows.limit(0).select(is_similar("l", "r")).collect() == []


def books(spark):
    return spark.createDataFrame([(0, "genesis", "Gênesis"), (1, "1 joao", "1 João"), (2, "romanos", "Romanos")], "position int, folded string, book string")


def test_books_inside_words(spark):
    cases = [("romanosx", "Romanos"), ("romanosxx", None), ("genesisx romanos", "Gênesis"), ("romanosx genesis", "Gênesis"), ("11 joao", None), ("romano", None), ("xromanosyy romano", "Romanos"), (None, None), ("", None)]
    titles = spark.createDataFrame([(t,) for t, _ in cases + cases], "t string")
    got = [(r.t, r.book) for r in joins.match_books(titles, books(spark), "t", "t", alike=True).collect()]
    assert sorted(got, key=str) == sorted(cases + cases, key=str)


def test_reference_behind_a_book_inside_a_word(spark):
    df = spark.createDataFrame([(1, "Fé - Romanosx 8:1 a 4"), (2, "Fé"), (3, None)], "k int, title string")
    got = {r.k: r.text_reference for r in talks.extract_reference(df, "title", books(spark)).select("k", F.col("text_reference")).collect()}
    assert got == {1: "Romanos 8:1-4", 2: "", 3: ""}
