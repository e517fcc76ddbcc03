"""Jobs that once held too much in one place, or fitted only small tables."""

import pyarrow as pa
from pyspark.sql import functions as F

from medialake.functions import markup
from medialake.functions import text as x
from medialake.operators import joins
from medialake.plans import q_sources, q_tables, serving


def test_study_listing(spark):
    """The rows of the nested catalogue, at their places, and no type or year gathered into one row."""
    rows = [(str(i), ("weekly", "pfd", "ctb", "other", None)[i % 5], (f"202{i % 4}-0{i % 9 + 1}-01", "2020", None)[i % 3], ("Estudo 10", "2 - x", "B", None)[i % 4]) for i in range(300)]
    studies = spark.createDataFrame(rows, "study_id string, study_type string, study_date string, title string").withColumn("resource_count", F.lit(0))
    years = serving.study_catalog(studies).select("study_type", "label", "count", F.posexplode("years").alias("year_place", "y"))
    nested = years.select("study_type", "label", "count", "year_place", "y.year", F.posexplode("y.studies").alias("place", "s")).select("study_type", "label", "count", "year_place", "year", "place", "s.title", "s.study_id", "s.study_date", "s.resources")
    listing = serving.study_listing(studies)
    assert listing.schema.names == nested.schema.names and sorted(listing.collect(), key=repr) == sorted(nested.collect(), key=repr)
    assert "collect_list" not in listing._jdf.queryExecution().toString()
    assert serving.study_listing(studies.limit(0)).count() == 0


def test_chain_over_a_million_ids(spark):
    """No page without a parent finds one, however many ids there are."""
    ids = spark.range(3_000_000)
    lost = q_tables.chained(ids).where("id % 3 = 2")
    assert lost.count() == 1_000_000 and lost.join(ids.select(F.col("id").alias("parent")), "parent", "left_semi").isEmpty()


def test_series_are_folded_once(spark):
    """Titles are looked through once for both fields, and ASCII letters pass no list of characters."""
    lists = spark.range(3).select(F.array(F.concat(F.lit("Série: A"), F.col("id").cast("string"), F.lit(" [B]")), F.lit("Outros")).alias("lists"))
    df = lists.select(x.series_from_playlists("lists").alias("s")).select("s.*")
    assert [tuple(r) for r in df.collect()] == [(f"A{k}", "B") for k in range(3)]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("^(mini)?serie") == 1
    assert x._decompositions()[2].startswith(r"[\x{80}-\x{10ffff}&&")


def test_pages_are_taken_apart_in_slices():
    """No more pages than a slice stand beside each other as Python objects; results are those of single pages."""
    pages = [None if k % 50 == 3 else f"<a href='//e.org/{k}'>{k}<a href=x>" for k in range(2 * markup.SLICE + 5)]
    got = markup._walked.func(pa.array(pages, pa.string())).to_pylist()
    assert got == [None if p is None else markup.walk(p) for p in pages]
    assert markup._walked.func(pa.array([], pa.string())).to_pylist() == []


def test_searches_read_the_stored_catalogue(spark, sf_small):
    """The tables behind the catalogue are joined once, not again for every question."""
    found = q_tables.f05_search_postings(spark, sf_small)
    assert not any(f.endswith("orders.parquet") for f in found.inputFiles())


def test_titles_are_taken_apart_once_for_all_books(spark):
    """A title's words are made outside the look at the books."""
    books = spark.createDataFrame([(i, b, b.title()) for i, b in enumerate(x.CANON)], "position int, folded string, book string")
    want = {"fe - 1 joao 3": "Joao", "fe - 1 pedro": "1 Pedro", "rute e genesis": "Genesis", "jonasx jo": "Jo", "amos-joel": "Joel", "genesisx rute": "Genesis", "rutexx": None, "": None, None: None}
    found = joins.match_books(spark.createDataFrame([(t,) for t in want], "t string"), books, "t", "t", alike=True)
    assert {r.t: r.book for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^a-z0-9]+") == 1 and "Contains(concat(" not in plan


def test_posts_are_read_once(spark, sf_small):
    """The rows of talks and of their media come from one stored table."""
    assert not any(f.endswith("orders.parquet") for f in q_sources.e02_load_posts(spark, sf_small).inputFiles())


def test_runs_without_three_numbers_are_not_read(spark):
    """Addresses are full of signs and numbers; only runs with three numbers in a row are searched for dates."""
    cases = {"https://e.org/f1.pdf 3.4 // 1..2.2020": [], "x 01/02/2020 y": ["2020-02-01"], "1.2-20": ["2020-02-01"], "//5/2020-03-04.": ["2020-03-04"], "": [], None: []}
    found = spark.createDataFrame([(t,) for t in cases], "t string").select("t", x.explicit_dates("t").alias("d"))
    assert {r.t: r.d for r in found.collect()} == cases
    assert "[0-9][./_-][0-9]+[./_-][0-9]" in found._jdf.queryExecution().optimizedPlan().toString()
