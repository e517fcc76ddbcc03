"""Order and names of studies, resources and issues."""

from pyspark.sql import functions as F

from medialake.functions import text as x
from medialake.operators import aggs, filters, joins
from medialake.plans import serving


def test_study_catalog(spark):
    rows = [
        ("a", "weekly", "2020-05-01", "B"), ("b", "weekly", "2020", "A"), ("c", "weekly", "2020-06-01", "C"), ("d", "weekly", None, "D"), ("e", "weekly", "2021-01-01", "E"),
        ("f", "pfd", "2020", "Estudo 10 - x"), ("g", "pfd", "2020-09-09", "2 - x"), ("h", "pfd", "2020", "sem"), ("i", "other", "2020", "x"),
    ]
    studies = spark.createDataFrame(rows, "study_id string, study_type string, study_date string, title string").withColumn("resource_count", F.lit(0))
    got = [(r.study_type, r["count"], [(y.year, "".join(s.study_id for s in y.studies)) for y in r.years or []]) for r in serving.study_catalog(studies).collect()]
    assert got == [("ctb", 0, []), ("lecture_or_conference", 0, []), ("weekly", 5, [("2021", "e"), ("2020", "cab"), ("Sem data", "d")]), ("pfd", 3, [("2020", "gfh")])]
    assert [r["count"] for r in serving.study_catalog(studies.limit(0)).collect()] == [0] * 4


def test_groups_and_labels(spark):
    rows = [("archive", None, None, "documents"), ("pdf", "audio/mpeg", "/m/a.mp3", "audio"), (None, None, None, "external_link"), ("", None, "", "external_link"), ("video_file", None, "/m/a.mp4", "video_file"), ("audio", None, None, "audio")]
    df = spark.createDataFrame(rows, "k string, m string, l string, want string").withColumn("got", filters.resource_group("k", "m", "l"))
    assert all(r.got == r.want for r in df.collect())
    named = df.select("got", x.label_of("got", x.RESOURCE_GROUPS).alias("name"), x.place_of("got", x.RESOURCE_GROUPS).alias("place")).distinct().collect()
    assert {(r.got, r.name, r.place) for r in named} == {("documents", "Documentos", 1), ("audio", "Áudios", 0), ("external_link", "Links externos", 5), ("video_file", "Arquivos de vídeo", 4)}


def test_order_of_issues(spark):
    rows = [("1", "b", None), ("2", "B", "2020-01-02"), ("3", "a", "2020-01-02"), ("4", "b", "2020-01-02"), ("5", "z", "2021-01-01")]
    issues = spark.createDataFrame(rows, "entity_id string, title string, preaching_date string")
    assert [r.entity_id for r in aggs.order_issues(issues).collect()] == ["5", "3", "2", "4", "1"]


def test_batches(spark):
    ids = spark.range(125).unionByName(spark.range(20)).repartition(4).unionByName(spark.createDataFrame([(None,)], "id long"))
    got = {r.batch: list(r.ids) for r in joins.batches(ids, "id").collect()}
    assert got == {0: list(range(50)), 1: list(range(50, 100)), 2: list(range(100, 125))}
    assert joins.batches(ids.limit(0), "id").collect() == []
