"""Column functions on examples."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from medialake.functions import text as x
from medialake.functions import times as t
from medialake.functions import urls as u


def value(spark, column, **given):
    names = {k: (v,) for k, v in given.items()}
    kinds = {str: "string", int: "long", float: "double", type(None): "string", bool: "boolean", dt.datetime: "timestamp", list: "array<string>"}
    df = spark.createDataFrame([tuple(v for (v,) in names.values()) or (1,)], ", ".join(f"{k} {kinds[type(v)]}" for k, (v,) in names.items()) or "one int")
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw, want", [("  João ÇÃO ", "joao cao"), (None, ""), ("Ñandú", "nandu")])
def test_fold(spark, raw, want):
    assert value(spark, x.fold("c"), c=raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [("Estudo CTB: Graça", "Graça"), ("CTB Romanos | CTB 2024", "Romanos"), ("Conferência - Família [Ana]", "Família"), ("Estudo", "Estudo"), ("Estudos bíblicos", "Estudos bíblicos"), ("[x]", "[x]")],
)
def test_clean_study_title(spark, raw, want):
    assert value(spark, x.clean_study_title("c"), c=raw) == want


def test_title_identity(spark):
    same = {value(spark, x.title_identity("c"), c=c) for c in ("Estudo: Graça & Fé", "CTB graca - fe", "GRAÇA, FÉ | CTB 2020")}
    assert same == {"graca fe"}


@pytest.mark.parametrize("raw, want", [("Estudo de João", True), ("Estudo", False), ("Retiro 2020", True), ("Culto", False), ("Palestras e mais", True)])
def test_is_study_playlist(spark, raw, want):
    assert value(spark, x.is_study_playlist("c"), c=raw) is want


@pytest.mark.parametrize("raw, want", [(["CTB 1"], "ctb"), (["Curso PFD"], "pfd"), (["Retiro de casais"], "lecture_or_conference"), (["Aula ctb"], "ctb"), (["Estudo"], "weekly"), ([], "weekly")])
def test_study_type(spark, raw, want):
    assert value(spark, x.study_type("c"), c=raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [("em 05/02/2020 e 2014-11-02", "2014-11-02,2020-02-05"), ("31.02.2020", ""), ("1-2-14", "2014-02-01"), ("12005/02/2020", ""), ("a &#47; 3/4/21", "2021-04-03"), (None, "")],
)
def test_explicit_dates(spark, raw, want):
    assert value(spark, F.array_join(x.explicit_dates("c"), ","), c=raw) == want


@pytest.mark.parametrize("raw, want", [("visto em 1999 e 2020", "1999"), ("sem data", ""), ("20201", "")])
def test_text_date(spark, raw, want):
    assert value(spark, x.text_date("c"), c=raw) == want


@pytest.mark.parametrize("raw, book, kind", [("2Tm 3:16", "2 timoteo", "new"), ("Gn 1", "genesis", "old"), ("Salmo 23", "salmo", "old"), ("1", "", ""), ("", "", ""), ("Tema livre", "tema", "")])
def test_books(spark, raw, book, kind):
    assert value(spark, x.normalize_book("c"), c=raw) == book
    assert value(spark, x.testament("c"), c=raw) == kind


def test_canon_order(spark):
    places = [value(spark, x.book_position("c"), c=c) for c in ("Gênesis", "Salmo", "Mateus", "Apocalipse", "Outro")]
    assert places == sorted(places) and places[-1] == 66 and len(x.CANON) == 66


@pytest.mark.parametrize(
    "raw, want",
    [
        ("https://x/2020_02_05_Ana.mp3", ("2020-02-05", "Ana")),
        ("https://x/Ana_05_02_20.mp3", ("2020-02-05", "Ana")),
        ("https://x/Ana 05.02.2020.mp3", ("2020-02-05", "Ana")),
        ("https://x/Ana-05-02-2020.mp3", ("2020-02-05", "Ana")),
        ("https://x/audio.mp3", ("", "")),
    ],
)
def test_file_info(spark, raw, want):
    assert tuple(value(spark, x.file_info("c"), c=raw)) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("//www.Example.org/a/", "https://example.org/a"),
        ("http://example.org", "https://example.org/"),
        ("https://youtu.be/abc?t=3", "https://youtube.com/watch?v=abc"),
        ("https://www.youtube.com/embed/abc", "https://youtube.com/watch?v=abc"),
        ("https://m.youtube.com/watch?x=1&v=abc", "https://youtube.com/watch?v=abc"),
        ("http://Other.example/a%20b/?q=1#top", "http://other.example/a b?q=1"),
        ("nothing", "nothing"),
        ("https://a.example/x&amp;y.,", "https://a.example/x&y"),
    ],
)
def test_canonical_url(spark, raw, want):
    assert value(spark, u.canonical_url("c"), c=raw) == want


@pytest.mark.parametrize("raw, want", [("https://a.example/x", True), ("/media/x.mp3", True), ("", True), ("//x", False), ("a.example/x", False), ("javascript:x", False), ("https://", False)])
def test_valid_link(spark, raw, want):
    assert value(spark, u.is_valid_link("c"), c=raw) is want


def test_safe_component(spark):
    name = value(spark, u.safe_component("c", F.lit(" [abc].mp3")), c="é" * 200)
    assert len(name.encode()) <= 180 and name.endswith("é [abc].mp3")
    assert value(spark, u.safe_component("c", F.lit("")), c="con") == "_con"
    assert value(spark, u.safe_component("c", F.lit("")), c='a/b:c*"d" ') == "a_b_c__d_"


@pytest.mark.parametrize("raw, want", [("PT1H2M3S", 3723.0), ("P1DT1S", 86401.0), ("P0D", 0.0), ("", None), ("1H", None), ("PT", None)])
def test_iso_duration(spark, raw, want):
    assert value(spark, t.iso_duration_seconds("c"), c=raw) == want


def test_local_dates(spark):
    at = dt.datetime(2026, 11, 10, 2, 59, 59)
    assert value(spark, t.local_date("c"), c=at) == dt.date(2026, 11, 9)
    assert value(spark, t.fixed_offset_date("c"), c=dt.datetime(2026, 11, 10, 3)) == dt.date(2026, 11, 10)


def test_period():
    p = t.resolve_period("bad", None, 7, dt.date(2024, 3, 10), 180)
    assert (p.start, p.end) == (dt.date(2024, 3, 4), dt.date(2024, 3, 10))
    assert p.start_utc == dt.datetime(2024, 3, 4, 3) and p.end_utc == dt.datetime(2024, 3, 11, 3)
    far = t.resolve_period("2000-01-01", "2030-01-01", 7, dt.date(2024, 3, 10), 10)
    assert (far.start, far.end) == (dt.date(2024, 3, 1), dt.date(2024, 3, 10))


@pytest.mark.parametrize("seconds, want", [(2640.0, "44 min"), (3900.0, "1h 05min"), (12.0, "12s"), (0.0, "")])
def test_duration(spark, seconds, want):
    assert value(spark, x.fmt_duration("c"), c=seconds) == want


@pytest.mark.parametrize("size, want", [(0.0, "0 B"), (1536.0, "1.5 KB"), (102400.0, "100 KB"), (5242880.0, "5.0 MB")])
def test_bytes(spark, size, want):
    assert value(spark, x.fmt_bytes("c"), c=size) == want


def test_missing_sundays(spark):
    have = spark.createDataFrame([("2026-09-27",)], "preaching_date string")
    why = spark.createDataFrame([("2026-10-04", "chuva")], "preaching_date string, reason string")
    got = t.missing_weekdays(have, why, dt.date(2026, 9, 27), dt.date(2026, 10, 22), grace=10).collect()
    assert [(str(r.day), r.justified) for r in sorted(got)] == [("2026-10-04", True), ("2026-10-11", False)]


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("https://h/up/2020_01_02_Ana.mp3", ("2020-01-02", "Ana")), ("12020-01-02-Ana.mp3", ("2020-01-02", "Ana")), ("Ana_02_01_20.mp3", ("2020-01-02", "Ana")), ("Ana-02-01-2019.mp3", ("2020-01-02", "Ana")),
        ("Ana 02.01.2019.mp3", ("2019-01-02", "Ana")), ("Ana 02-01-2019.mp3", ("2019-01-02", "Ana")), ("Zé-Ana 02-01-2019_1.mp3", ("2019-01-02", "Ana")), ("1999_01_02_Ana.mp3", ("", "")), ("Ana  02-01-2019.mp3", ("", "")),
        ("Rui_1_01_20.mp3", ("", "")), ("Rui_01_02_20_2021_03_04_Ana.mp3", ("2021-03-04", "Ana")), ("plain.mp3", ("", "")), ("", ("", "")), (None, ("", "")),
    ],
)
def test_file_names(spark, name, want):
    assert tuple(value(spark, x.file_info("c"), c=name)) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [("<p>por Ana Souza, 2020</p>", "Ana Souza"), ("POR\n Rui<br>", "Rui"), ("por <b>x</b> por Zé - y", "Zé"), ("por Ana\nRui", "Ana"), ("sem nome", ""), ("", ""), (None, ""), ("vapor d'água | x", "d'água")],
)
def test_speakers_in_html(spark, html, want):
    assert value(spark, x.speaker_from_html("c"), c=html) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [('<a href="http://h/a.pdf"><a href=\'x https://h/b.MP3 \'>', "https://h/b.MP3"), ("see http://h/a.ogg", "http://h/a.ogg"), ('"https://h/a.mp3?x"', ""), ("a.mp3", ""), (None, "")],
)
def test_audio_addresses(spark, html, want):
    assert value(spark, x.first_audio_url("c"), c=html) == want


@pytest.mark.parametrize(("title", "want"), [("Estudo 12 - x", 12), ("estudo  7", 7), ("12b", 9999), ("3. y", 3), (" 4", 9999), ("Estudo", 9999), ("", 9999), (None, 9999)])
def test_numbers_of_courses(spark, title, want):
    assert value(spark, x.study_place(F.lit("pfd"), "c", F.lit("2020")), c=title) == want


@pytest.mark.parametrize(
    ("title", "want"),
    [("I  João 3: 16 a 18", "1 João 3: 16-18"), ("II Samuel 7 e 8", "2 Samuel 7-8"), ("III x IV", "3 x IV"), ("de 1 a 2 a 3 e 4", "de 1-2-3-4"), ("a e 1 a b", "a e 1 a b"), ("2I x", "2I x"), ("ação  1a2", "ação 1-2"), ("", "")],
)
def test_numbers_in_titles(spark, title, want):
    from medialake.plans import talks

    assert value(spark, talks.numbered(F.col("c")), c=title) == want


@pytest.mark.parametrize(("rest", "want"), [(" 3:16-18 b", " 3:16-18"), ("x 3 : 4", " 3"), ("3:  4-b", " 3:4"), (" cap. 12", " 12"), ("-", ""), ("", "")])
def test_places_in_books(spark, rest, want):
    from medialake.plans import talks

    assert value(spark, talks.place_in_book(F.col("c")), c=rest) == want
