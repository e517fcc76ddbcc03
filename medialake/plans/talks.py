"""Talks: video listings and website posts to silver, silver to gold."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.functions import text as x
from medialake.functions import times as t
from medialake.functions import urls as u
from medialake.operators import joins, pick
from medialake.operators.filters import published
from medialake.sources.scratch import stored
from medialake.sources.tables import Policy, upsert

METADATA = ("canonical_sermon_id", "source_system", "source_item_id", "preaching_date", "title", "preacher_name", "text_reference", "serie", "processed_at")
#: Blank news never erase a known series.
METADATA_POLICY = {"serie": Policy.COALESCE_TRIMMED}
GOLD_POLICY = dict.fromkeys(("title", "preacher_name", "text_reference", "serie", "youtube_link", "wordpress_link", "media_link", "download_link"), Policy.COALESCE_NONEMPTY) | {"duration_seconds": Policy.COALESCE}


def resolve_alias(df: DataFrame, aliases: DataFrame, columns: list[Column], name: str = "preacher_name", by_first_word: bool = False) -> DataFrame:
    """``df`` with a speaker's shown name: the first filled column looked up by its folded form, else in title case.

    The alias table is small, but its size decides: the planner broadcasts it
    only below its threshold.
    """
    chosen = x.first_filled(*columns)
    out = df.withColumn("__name", chosen).withColumn("__key", x.fold(chosen)).join(aliases.select(F.col("alias").alias("__key"), F.col("name").alias("__a")), "__key", "left")
    found = F.col("__a")
    if by_first_word:
        out = out.withColumn("__first", F.substring_index("__key", " ", 1)).join(aliases.select(F.col("alias").alias("__first"), F.col("name").alias("__b")), "__first", "left")
        found = F.coalesce("__a", F.when(F.col("__key").contains(" "), F.col("__b")))
    return out.withColumn(name, F.coalesce(found, x.title_case("__name"))).drop("__name", "__key", "__a", "__first", "__b")


def video_candidates(videos: DataFrame, aliases: DataFrame) -> DataFrame:
    """Talk videos with date, title parts, speaker and series; one row a video."""
    day = x.first_filled(
        x.first_br_date("description"),
        F.date_format(t.fixed_offset_date(t.to_instant("live_start_time")), "yyyy-MM-dd"),
        F.date_format(t.fixed_offset_date(t.to_instant("published_at")), "yyyy-MM-dd"),
    )
    rows = videos.where(x.is_talk("title")).withColumns({"preaching_date": day, "__p": x.title_parts("title"), "__s": x.series_from_playlists("playlists"), "__label": x.extract_label("description")}).where("preaching_date <> ''")
    named = resolve_alias(rows, aliases, [F.col("__s.speaker"), F.col("__p.speaker"), F.col("__label")])
    return named.select(
        F.col("preaching_date").alias("canonical_sermon_id"), F.lit("youtube").alias("source_system"), F.col("video_id").alias("source_item_id"), "preaching_date",
        F.col("__p.title").alias("title"), "preacher_name", F.col("__p.reference").alias("text_reference"), F.col("__s.serie").alias("serie"),
        "published_at", "duration", F.size(F.coalesce("playlists", F.array().cast("array<string>"))).alias("n_playlists"), "url",
    )


def load_videos(videos: DataFrame, aliases: DataFrame, now: dt.datetime, date: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(provenance, metadata, media) of a listing: all videos, and one resolved talk per date.

    The best candidate of a date wins; what it lacks comes from the others. An
    exact date narrows talks, never provenance.
    """
    provenance = videos.select(F.lit("youtube").alias("source_system"), F.col("video_id").alias("source_item_id"), F.lit(now).alias("captured_at"))
    rows = video_candidates(videos, aliases)
    if date:
        rows = rows.where(F.col("preaching_date") == dt.date.fromisoformat(date).isoformat())
    rank = F.struct(t.has_positive_duration(F.lit(None), "duration"), F.coalesce("published_at", F.lit("")), F.col("n_playlists") > 0, F.col("source_item_id"))
    best = rows.groupBy("preaching_date").agg(F.max_by(F.struct("source_item_id", "url", "title", "canonical_sermon_id", "source_system"), rank).alias("b"))
    joined = rows.join(best.select("preaching_date", F.col("b.source_item_id").alias("winner")), "preaching_date")
    filled = pick.fill_from_group(joined, "preaching_date", ["preacher_name", "text_reference", "serie"], F.col("source_item_id") == F.col("winner"), "source_item_id")
    resolved = best.join(filled, "preaching_date").select("preaching_date", "b.*", "preacher_name", "text_reference", "serie").withColumn("processed_at", F.lit(now))
    media = resolved.select("canonical_sermon_id", F.lit("youtube_video").alias("asset_type"), F.col("url").alias("source_url"), F.lit("").alias("local_path"), F.lit(None).cast("double").alias("duration_seconds"), F.lit("video/youtube").alias("mime_type"))
    return provenance, resolved.select(*METADATA), media


#: Numbers of books as titles write them, and the words that join two numbers (fixed values).
ROMAN = {"I": "1", "II": "2", "III": "3"}
JOINERS = ("a", "e")


def numbered(title: Column) -> Column:
    """A title with roman book numbers as digits and joined numbers as ranges, by its words, numbers, spaces and signs."""
    pieces = F.regexp_extract_all(title, F.lit(r"[\p{L}\p{M}]+|[0-9]+|\s+|[^\p{L}\p{M}0-9\s]"), F.lit(0))

    def mapped(given: Column) -> Column:
        near = lambda k, step: F.get(given, k + step)
        blank, digits = lambda c: F.coalesce(F.trim(c) == "", F.lit(False)), lambda c: F.coalesce(c.rlike("^[0-9]"), F.lit(False))
        before = lambda k: F.when(blank(near(k, -1)), near(k, -2)).otherwise(near(k, -1))
        behind = lambda k: F.when(blank(near(k, 1)), near(k, 2)).otherwise(near(k, 1))
        joins_ = lambda x, k: x.isin(*JOINERS) & digits(before(k)) & digits(behind(k))
        roman = F.create_map(*[F.lit(v) for pair in ROMAN.items() for v in pair])

        def piece(x: Column, k: Column) -> Column:
            counts = x.isin(*ROMAN) & blank(near(k, 1)) & ~F.coalesce(near(k, -1).rlike("^[0-9_]"), F.lit(False))
            beside = blank(x) & (joins_(near(k, 1), k + 1) | joins_(near(k, -1), k - 1))
            return F.when(counts, roman[x]).when(joins_(x, k), "-").when(beside, "").when(blank(x), " ").otherwise(x)

        return F.array_join(F.transform(given, piece), "")

    return F.transform(F.array(pieces), mapped)[0]


def place_in_book(rest: Column) -> Column:
    """`` chapter:verses`` by the first number of a text, the verses behind a colon and up to a hyphen's other side; empty without a number."""
    leading = lambda c: F.regexp_extract(c, "^[0-9]+", 0)
    after = lambda c, part: F.substring(c, F.length(part) + 1, F.length(c))
    from_number = F.regexp_extract(rest, "[0-9].*", 0)
    chapter = leading(from_number)
    behind = after(from_number, chapter)
    verses = F.when(behind.startswith(":"), F.ltrim(F.substring(behind, 2, 1 << 20))).otherwise("")
    verse = leading(verses)
    to = after(verses, verse)
    last = F.when(to.startswith("-") & (verse != ""), leading(F.substring(to, 2, 1 << 20))).otherwise("")
    shown = F.concat(F.when(verse != "", F.concat(F.lit(":"), verse)).otherwise(""), F.when(last != "", F.concat(F.lit("-"), last)).otherwise(""))
    return F.when(chapter == "", "").otherwise(F.concat(F.lit(" "), chapter, shown))


def extract_reference(df: DataFrame, title: str, books: DataFrame, name: str = "text_reference") -> DataFrame:
    """``df`` with the scripture reference of a title: first book in canon order, then chapter and verses behind it.

    ``books(position, folded, book)`` has one row per book.
    """
    keyed = df.withColumn("__folded", x.fold(numbered(x.clean_title(title))))
    found = joins.match_books(keyed, books, "__folded", "__folded", alike=True)
    rest = F.substring(F.col("__folded"), F.instr("__folded", F.col("folded")) + F.length("folded"), F.length("__folded"))
    return found.withColumn(name, x.text(F.concat(F.col("book"), place_in_book(rest)))).drop("__folded", "book", "folded")


def load_posts(items: DataFrame, aliases: DataFrame, books: DataFrame, now: dt.datetime, max_date: str, category: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(provenance, metadata, media) of website posts; the newest post of a date is its talk."""
    terms = items.withColumns({"categories": x.terms_by_domain("category", "category"), "tags": x.terms_by_domain("category", "post_tag"), "post_day": x.to_iso_date("post_date")})
    out = published(terms, max_date, category, date="post_day")
    audio = x.first_audio_url("content")
    rows = out.withColumn("audio", audio).withColumns({"__f": x.file_info("audio"), "__said": x.speaker_from_html("content")})
    rows = rows.withColumn("preaching_date", x.first_filled("__f.date", x.first_br_date("title", False), "post_day")).where("preaching_date <> ''")
    rows = rows.select("preaching_date", "post_date", "link", "title", "audio", "tags", "categories", F.col("__f.speaker").alias("__named"), "__said")
    one = pick.rows_by(rows, ["preaching_date"], [F.col("post_date"), F.col("link")])  # titles and names are read of posts that count
    one = extract_reference(one.withColumns({"__head": x.title_head("title"), "serie": x.series_from_terms("tags", "categories")}), "title", books)
    one = resolve_alias(one, aliases, [F.col("__named"), F.col("__said")], by_first_word=True)
    one = stored(one.select("preaching_date", "post_date", "link", "__head", "preacher_name", "text_reference", "serie", "audio"), "posts")  # read twice below
    meta = one.select(
        F.col("preaching_date").alias("canonical_sermon_id"), F.lit("wordpress").alias("source_system"), F.col("link").alias("source_item_id"), "preaching_date",
        F.col("__head").alias("title"), "preacher_name", "text_reference", "serie", F.lit(now).alias("processed_at"),
    )
    media = one.where("audio <> ''").select(F.col("preaching_date").alias("canonical_sermon_id"), F.lit("audio").alias("asset_type"), F.col("audio").alias("source_url"), F.lit("").alias("local_path"), F.lit(None).cast("double").alias("duration_seconds"), u.mime_of("audio").alias("mime_type"))
    provenance = out.select(F.lit("wordpress").alias("source_system"), F.col("link").alias("source_item_id"), F.lit(now).alias("captured_at"))
    return provenance, meta, media


def refresh_gold(meta: DataFrame, media: DataFrame, texts: DataFrame, now: dt.datetime, current: DataFrame | None = None) -> DataFrame:
    """One trusted record per talk; with ``current``, blank news keep what the served table has.

    Website rows come before video rows, fuller ones before others. One
    aggregate over the metadata; media are pivoted to one row a talk first.
    """
    key = "canonical_sermon_id"
    ranked = meta.withColumns({"prio": F.when(F.col("source_system") == "wordpress", 0).otherwise(1), "score": pick.quality_score("title", "preacher_name", "text_reference", "serie")})
    order = [F.col("prio"), -F.col("score"), F.col("processed_at"), F.col("source_item_id")]
    columns = ["preaching_date", "title", "preacher_name", "text_reference", "serie"]
    best = pick.survivorship(ranked, key, columns, order)
    site = ranked.where("source_system = 'wordpress'").groupBy(key).agg(F.min_by("source_item_id", F.struct(*order)).alias("wordpress_link"))
    kind = lambda name, c: F.max(F.when(F.col("asset_type") == name, F.col(c)))
    files = media.groupBy(key).agg(kind("youtube_video", "source_url").alias("youtube_link"), kind("audio", "local_path").alias("path"), kind("audio", "source_url").alias("audio_url"), kind("audio", "duration_seconds").alias("duration_seconds"))
    out = joins.exists_flag(best.join(site, key, "left").join(files, key, "left"), texts, key, "transcript_available")
    out = out.select(
        key, *[x.text(c).alias(c) for c in columns], x.text("youtube_link").alias("youtube_link"), x.text("wordpress_link").alias("wordpress_link"),
        x.first_filled(u.download_link("path"), "audio_url").alias("media_link"), u.download_link("path").alias("download_link"), "duration_seconds", "transcript_available", F.lit(now).alias("last_aggregated_at"),
    )
    return out if current is None else upsert(current, out, [key], GOLD_POLICY)
