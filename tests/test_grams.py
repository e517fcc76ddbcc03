"""Search through postings finds what a scan finds."""

import pytest
from pyspark.sql import functions as F

from medialake.operators import filters, grams
from medialake.sources.scratch import fresh_path

COLUMNS = ["title", "speaker"]


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [(1, "A Graça de Deus", "Ana"), (2, "graça", None), (3, None, None), (4, "", "RUI GRAÇA"), (5, "100% certo", "x_y"), (6, "de", "De Souza"), (7, "aaaa", "aaa"), (8, "Deus e a grama", "Zé")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "id long, title string, speaker string, key string, gram string")
    return df, grams.store_postings(df, "id", COLUMNS, fresh_path(spark, "postings"))


@pytest.mark.parametrize("query", ["graça", "GRAÇA", "de", "a", "", "deus", "d%us", "gra__ de", "%", "_", "100%", "x_y", "nothing", "gra%ma", "aaaa", "de souza", "é", "graçade"])
def test_search(spark, catalog, query):
    df, stored = catalog
    found = grams.search_postings(df, "id", COLUMNS, query, stored)
    assert found.columns == df.columns
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in filters.search(df, COLUMNS, query).collect())


def test_lookups_read_the_parts_of_their_grams(spark):
    df = spark.range(3000).select("id", F.concat(F.lit("t"), F.md5(F.col("id").cast("string"))).alias("title"))
    stored = grams.store_postings(df.repartition(4), "id", ["title"], fresh_path(spark, "postings"))
    one = df.where("id = 77").first().title
    assert [r.id for r in grams.search_postings(df, "id", ["title"], one[3:20], stored).collect()] == [77]
    plan = stored.where(F.col("gram").isin(["abc", "bcd"]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan
