"""Studies: page graphs and course payloads to silver, both sources to gold, enrichment and work lists."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.functions import markup
from medialake.functions import text as x
from medialake.functions import times as t
from medialake.functions import urls as u
from medialake.operators import aggs, joins, pick
from medialake.sources.scratch import stored
from medialake.sources.tables import reset_then_set

#: A bare address in text, with or without its scheme, up to a space, quote or closing bracket (fixed value).
_ADDRESS = r"(?i)(?:https?:)?//[^\s<>\"')\]]+"
_LINK = "struct<url:string,label:string,element_tag:string,is_raw:boolean>"


def _unlinked(found: Column, linked: Column) -> Column:
    """Of ``found`` (structs with url) those whose canonical address is not in ``linked`` and was not met before.

    Both are sorted together by address, links before what was found, so a first occurrence differs from the one before it.
    """
    place = F.transform(linked, lambda x: F.struct(u.canonical_url(x["url"]).alias("c"), F.lit(-1).alias("at"), x.alias("link")))
    place = F.concat(place, F.transform(found, lambda x, i: F.struct(u.canonical_url(x["url"]).alias("c"), i.alias("at"), x.alias("link"))))
    pairs = F.transform(F.array(F.array_sort(place)), lambda s: F.zip_with(s, F.concat(F.array(F.lit(None).cast("string")), F.transform(s, lambda x: x["c"])), lambda x, before: F.struct(x["at"].alias("at"), x["link"].alias("link"), x["c"].eqNullSafe(before).alias("again"))))
    return F.transform(F.array_sort(F.filter(pairs[0], lambda x: (x["at"] >= 0) & ~x["again"])), lambda x: x["link"])


def extract_links(pages: DataFrame, ident: str = "page_id", html: str = "html", link: str = "url", title: str | None = None) -> DataFrame:
    """Links of pages in order: ``ident, url, label, element_tag, is_raw, position``.

    Elements first, in document order with the target their kind has; then
    addresses in the text that lead to a supported resource and are not linked
    yet, each once. Everything happens within the row of a page: nothing is
    shuffled, and a page is read once.
    """
    fallback = F.col(title) if title else F.lit("")
    rows = pages.select(F.col(ident).alias("id"), F.col(link).alias("base"), fallback.alias("title"), markup.elements(html).alias("seen"))
    linked = F.filter(
        F.transform("seen.found", lambda x: F.struct(u.resolve_url(x["target"], F.col("base")).alias("url"), _label(x, F.col("title")).alias("label"), x["tag"].alias("element_tag"), F.lit(False).alias("is_raw"))),
        lambda x: x["url"] != "",
    ).cast(f"array<{_LINK}>")
    addresses = F.regexp_extract_all(F.coalesce("seen.words", F.lit("")), F.lit(_ADDRESS), F.lit(0))
    found = F.transform(addresses, lambda a: F.struct(u.resolve_url(a, F.col("base")).alias("url"), F.col("title").alias("label"), F.lit("").alias("element_tag"), F.lit(True).alias("is_raw")))
    found = F.filter(found, lambda x: (x["url"] != "") & u.is_supported_url(x["url"])).cast(f"array<{_LINK}>")
    rows = rows.select("id", linked.alias("linked"), found.alias("found"))
    both = rows.select("id", F.when(F.size("found") == 0, F.col("linked")).otherwise(F.concat("linked", _unlinked(F.col("found"), F.col("linked")))).alias("links"))
    # the outer form, as the planner guards the other by a filter that computes all of the above once more
    each = both.select(F.col("id").alias(ident), F.posexplode_outer("links").alias("place", "l")).where("place IS NOT NULL")
    return each.select(ident, "l.*", (F.col("place") + 1).alias("position"))


def _label(found: Column, fallback: Column) -> Column:
    return x.element_label(found["label"], found["title"], found["alt"], fallback)


def page_resources(links: DataFrame, pages: DataFrame, attachments: DataFrame, ident: str = "post_id") -> DataFrame:
    """Resources of pages: links without self references and images, one per address, with kind and name."""
    known = attachments.groupBy(u.canonical_url("attachment_url").alias("canonical_url")).agg(F.max("mime_type").alias("mime_type"))
    rows = links.join(pages.select(ident, F.col("link").alias("__link")), ident).where(~u.is_self("url", ident, "__link")).drop("__link")
    rows = rows.withColumn("canonical_url", u.canonical_url("url")).join(known, "canonical_url", "left")
    rows = rows.withColumn("resource_type", u.resource_type("url", "element_tag", "mime_type", F.lit(False))).where("resource_type <> 'image'")
    one = pick.dedupe_links(rows, [ident, "canonical_url"])
    return one.withColumns({"label": u.resource_name("url", "resource_type", "label"), "mime_type": x.first_filled("mime_type", u.mime_of("url"))})


def discover_studies(pages: DataFrame, roots: dict[str, str], weekly_root: str) -> tuple[DataFrame, DataFrame]:
    """(studies, resources) of the public pages of an export.

    ``pages`` are export items; ``roots`` maps a root page's slug to its study
    type. A study is a published page that a root links to; pages of the weekly
    root must also lie below it. Numbered PDF files on the weekly root make
    studies of their own. Every root type must turn up at least once.
    """
    spark = pages.sparkSession
    kinds = spark.createDataFrame(list(roots.items()), "slug string, study_type string")
    live = pages.where("post_type = 'page' AND status = 'publish'")
    root_pages = live.join(kinds, "slug")
    links = stored(extract_links(live, "post_id", "content", "link", "title"), "links")  # read three times below
    from_roots = links.where("element_tag = 'a'").join(root_pages.select("post_id", F.col("slug").alias("root_slug"), "study_type"), "post_id").withColumnRenamed("post_id", "root_id")
    reached = joins.resolve_links(from_roots, live.select("post_id", "link")).where("page_id IS NOT NULL AND page_id <> root_id")
    weekly = root_pages.where(F.col("slug") == weekly_root).select("post_id").first()
    below = joins.descendants(live, "post_id", "post_parent", weekly["post_id"]) if weekly else spark.createDataFrame([], "id string, level int")
    reached = reached.join(below.select(F.col("id").alias("page_id"), F.lit(True).alias("__below")), "page_id", "left").where((F.col("root_slug") != weekly_root) | F.col("__below"))
    places = F.create_map(*[F.lit(v) for i, s in enumerate(roots) for v in (s, i)])
    first = pick.first_by(reached.withColumn("__root", places[F.col("root_slug")]).select("page_id", "__root", "position", "study_type"), "page_id", ["__root", "position"])
    studies = first.join(live.withColumnRenamed("post_id", "page_id"), "page_id").select(
        F.concat(F.lit("wordpress:"), "page_id").alias("study_key"), F.col("page_id").alias("source_item_id"), "study_type",
        x.clean_study_title(x.first_filled("title", "slug")).alias("title"), x.infer_study_date("title", "content", "post_date").alias("study_date"), F.col("link").alias("source_url"),
    )
    attachments = pages.where("post_type = 'attachment'").select("attachment_url", "mime_type")
    own = page_resources(links, live, attachments).join(studies.select(F.col("source_item_id").alias("post_id"), "study_key"), "post_id")
    numbered = links.join(root_pages.where(F.col("slug") == weekly_root).select("post_id", F.col("link").alias("__link"), F.substring(x.to_iso_date("post_date"), 1, 4).alias("__year")), "post_id")
    numbered = numbered.withColumns({"canonical_url": u.canonical_url("url"), "__n": x.pfd_number("url")}).where((u.url_ext("canonical_url") == "pdf") & F.col("__n").isNotNull())
    numbered = pick.first_by(numbered.withColumn("study_key", F.concat(F.lit("wordpress:pfd:"), "__n")), "canonical_url", ["position"])
    pfd = numbered.groupBy("study_key").agg(F.min_by(F.struct("post_id", "__n", "label", "canonical_url", "__link", "__year"), "position").alias("r")).select(
        "study_key", F.concat("r.post_id", F.lit(":pfd:"), "r.__n").alias("source_item_id"), F.lit("pfd").alias("study_type"),
        x.clean_study_title(F.concat(F.lit("Estudo "), F.col("r.__n").cast("string"), F.lit(" - "), x.first_filled("r.label", F.concat(F.lit("Estudo "), F.col("r.__n").cast("string"))))).alias("title"),
        F.coalesce(x.upload_year("r.canonical_url").cast("string"), F.col("r.__year")).alias("study_date"), F.col("r.__link").alias("source_url"),
    )
    files = numbered.select("study_key", F.lit("pdf").alias("resource_type"), u.resource_name("url", F.lit("pdf"), "label").alias("label"), F.col("url").alias("source_url"), "canonical_url", F.lit("application/pdf").alias("mime_type"), "position")
    resources = own.select("study_key", "resource_type", "label", F.col("url").alias("source_url"), "canonical_url", "mime_type", "position").unionByName(files)
    return studies.unionByName(pfd), resources.withColumn("resource_key", x.stable_key("study_key", "canonical_url"))


def load_study_payload(playlists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(studies, resources) of course playlists as read by the payload scan."""
    rows = playlists.where(~x.is_blank("playlist_id")).withColumn("study_key", F.concat(F.lit("youtube:"), "playlist_id"))
    dates = F.transform("videos", lambda v: x.first_filled(v["description_date"], v["effective_date"], F.substring(x.text(v["published_at"]), 1, 10)))
    day = t.oldest_date(F.col("oldest_video_date"), F.coalesce(dates, F.array().cast("array<string>")), F.substring(x.text("published_at"), 1, 10))
    kind = x.first_filled("study_type", x.study_type(F.array("title")))
    studies = rows.select("study_key", F.col("playlist_id").alias("source_item_id"), kind.alias("study_type"), x.clean_study_title("title").alias("title"), day.alias("study_date"), F.col("url").alias("source_url"))
    listed = rows.select("study_key", F.col("url").alias("source_url"), "title").select("study_key", F.lit("youtube_playlist").alias("resource_type"), F.col("title").alias("label"), "source_url", F.lit(0).alias("position"))
    videos = pick.explode_dedupe(rows.select("study_key", F.transform("videos", lambda v: F.struct(v["video_id"].alias("video_id"), v["title"].alias("label"), v["url"].alias("source_url"))).alias("videos")), "videos", "video_id")
    resources = listed.unionByName(videos.select("study_key", F.lit("youtube").alias("resource_type"), "label", "source_url", "position"))
    resources = resources.withColumn("canonical_url", u.canonical_url("source_url")).withColumn("resource_key", x.stable_key("study_key", "canonical_url"))
    return studies, resources


def shape_study_bronze(playlists: DataFrame, items: DataFrame, videos: DataFrame, cutoff: str) -> DataFrame:
    """Course playlists with their videos in order, from landed pages.

    Dates come from all videos, also those before the cutoff that are not kept.
    """
    own = playlists.where(x.is_study_playlist("title")).withColumn("study_type", x.study_type(F.array("title")))
    day = x.first_filled(x.first_br_date("description"), F.date_format(t.local_date(t.to_instant("published_at")), "yyyy-MM-dd"))
    dated = items.join(videos.withColumn("effective_date", day), "video_id")
    per = dated.groupBy("playlist_id").agg(
        F.min(F.nullif("effective_date", F.lit(""))).alias("oldest_video_date"),
        F.array_sort(F.collect_list(F.when(F.col("effective_date") >= cutoff, F.struct("position", "video_id", "title", "effective_date", "published_at")))).alias("videos"),
    )
    return own.join(per, "playlist_id", "left").where(F.size("videos") > 0)


TYPE_PRIORITY = ("ctb", "pfd", "lecture_or_conference", "weekly")
#: Shown names of a study's origins (fixed values).
ORIGIN_LABELS = {"youtube": "Playlist original no YouTube", "wordpress": "Página original no WordPress"}


def merge_studies(site: tuple[DataFrame, DataFrame], courses: tuple[DataFrame, DataFrame], now: dt.datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(studies, resources, origins): both sources merged where titles mean the same."""
    rows = joins.union_tagged({"wordpress": site[0], "youtube": courses[0]}, "source_system")
    rows = rows.withColumn("identity", x.first_filled(x.title_identity("title"), "study_key")).withColumn("study_id", x.stable_key(F.lit("study-title"), "identity"))
    rank = F.struct(F.when(F.col("source_system") == "wordpress", 0).otherwise(1), x.first_filled("study_date", F.lit("9999")), "study_key")
    place = F.coalesce(F.array_position(F.array(*map(F.lit, TYPE_PRIORITY)), F.col("study_type")), F.lit(99))
    studies = rows.groupBy("study_id").agg(
        F.min_by(F.struct(x.clean_study_title("title").alias("title"), "source_url"), rank).alias("p"),
        F.min(F.nullif("study_date", F.lit(""))).alias("study_date"),
        F.min_by("study_type", F.struct(F.when(place == 0, 99).otherwise(place), "study_type")).alias("study_type"),
        F.array_join(F.array_sort(F.collect_set("source_system")), ",").alias("source_system"),
    ).select("study_id", "study_type", "p.title", "study_date", F.substring("study_date", 1, 4).alias("study_year"), "source_system", "p.source_url", F.lit(now).alias("last_aggregated_at"))
    labelled = pick.label_with_year(rows, "identity", "source_system", "source_url", "study_date")
    year = F.regexp_extract("label", r" (\d{4})$", 1)
    names = F.create_map(*[F.lit(v) for kv in ORIGIN_LABELS.items() for v in kv])
    origins = labelled.where(~x.is_blank("source_url")).select("study_id", "source_url", "source_system", "study_key", F.concat(names[F.col("source_system")], F.when(year != "", F.concat(F.lit(" ("), year, F.lit(")"))).otherwise("")).alias("label"))
    origins = pick.first_by(origins.withColumn("__k", F.concat_ws("\x1f", "study_id", "source_url")), "__k", ["source_system", "study_key"]).drop("__k", "study_key").withColumn("origin_id", x.stable_key("study_id", "source_url"))
    parts = joins.union_tagged({"wordpress": site[1], "youtube": courses[1]}, "source_system").join(rows.select("study_key", "study_id"), "study_key")
    parts = parts.withColumn("prio", F.when(F.col("source_system") == "wordpress", 0).otherwise(1))
    resources = pick.dedupe_merge_sources(parts, ["study_id", "canonical_url"], [F.col("prio"), F.col("study_key"), F.col("position")], separator=",")
    resources = resources.drop("prio", "study_key", "resource_key").withColumn("resource_id", x.stable_key("study_id", "canonical_url"))
    return aggs.resource_counts(studies, resources), resources, origins


def publish_enrichment(gold_resources: DataFrame, assets: DataFrame, texts: DataFrame) -> DataFrame:
    """Served resources with what enrichment made; platform audio only where a study has no audio of its own."""
    known = joins.exists_flag(assets, texts, "asset_id", "transcript_available")
    typed = known.join(gold_resources.select("resource_id", "study_id", "resource_type"), ["resource_id", "study_id"])
    shown = joins.unless_sibling(typed, "study_id", F.col("resource_type") == "audio", F.col("resource_type") == "youtube")
    shown = shown.select("resource_id", "study_id", u.download_link("local_path").alias("download_link"), "duration_seconds", "transcript_available")
    return reset_then_set(gold_resources, shown, ["resource_id", "study_id"], ["download_link", "duration_seconds", "transcript_available"], ("transcript_available",))


def download_worklist(resources: DataFrame, studies: DataFrame) -> DataFrame:
    """What to fetch: audio and documents, platform audio without a direct one, with target names and asset ids."""
    rows = resources.join(studies.select("study_id", F.col("title").alias("study_title"), "study_date"), "study_id")
    eligible = rows.where(F.col("resource_type").isin("audio", "pdf", "word", "presentation", "spreadsheet") | ((F.col("resource_type") == "youtube") & (u.media_ref("canonical_url")["kind"] == "video")))
    kept = joins.unless_sibling(eligible, "study_id", F.col("resource_type") == "audio", F.col("resource_type") == "youtube")
    sound = F.col("resource_type").isin("audio", "youtube")
    ext = F.when(F.col("resource_type") == "youtube", ".mp3").when(u.url_ext("canonical_url") != "", F.concat(F.lit("."), u.url_ext("canonical_url"))).otherwise(F.when(sound, u.ext_of("canonical_url", "mime_type")).otherwise(".bin"))
    stem = F.regexp_replace(x.first_filled("label", "study_title"), r"\.[A-Za-z0-9]{1,5}$", "")
    suffix = F.concat(F.lit(" ["), F.substring("resource_id", 1, 12), F.lit("]"), ext)
    return kept.withColumns({"asset_type": F.when(sound, "audio").otherwise("document"), "source_kind": F.when(F.col("resource_type") == "youtube", "platform").otherwise("direct"), "asset_id": x.stable_key(F.lit("asset"), "resource_id"), "file_name": u.safe_component(stem, suffix), "folder": u.safe_component("study_title", F.lit(""))})


def pending_worklists(assets: DataFrame, meta: DataFrame, texts: DataFrame, loopback_days: int | None = None, today: dt.date | None = None) -> dict[str, DataFrame]:
    """Audio without a measured length, and audio without a transcript, by date."""
    from medialake.operators.filters import date_scope

    rows = joins.assets_with_date(assets.where("asset_type = 'audio' AND trim(coalesce(local_path, '')) <> ''"), meta)
    rows = date_scope(rows, "preaching_date", loopback_days, today=today)
    return {"duration": rows.where("duration_seconds IS NULL"), "transcript": joins.pending(rows, texts, "canonical_sermon_id")}
