"""Scans of raw listings, exports and event batches. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medialake.functions.text import fold, is_blank, is_study_playlist, text
from medialake.sources import pointer

VIDEO = "video_id string, title string, description string, published_at string, playlist_added_at string, url string, is_live boolean, live_start_time string, duration string, view_count string, playlists array<string>"
PAYLOAD = (
    "schema_version int, captured_at string, complete_snapshot boolean, playlists array<struct<playlist_id:string,title:string,published_at:string,oldest_video_date:string,"
    "oldest_video_published_at:string,url:string,study_type:string,videos:array<struct<video_id:string,title:string,description:string,description_date:string,effective_date:string,published_at:string,url:string,position:int>>>>"
)
POST = "`title` string, `link` string, `content:encoded` string, `wp:post_id` string, `wp:post_date` string, `wp:post_name` string, `wp:status` string, `wp:post_parent` string, `wp:post_type` string, `wp:attachment_url` string, `wp:post_mime_type` string"
TALK_POST = POST + ", `category` array<struct<_VALUE:string,_domain:string>>"
EVENT = (
    "visitor_id string, session_id string, content_length long, user_agent string, origin string, host string, events array<struct<event_id:string,event_type:string,content_type:string,content_id:string,resource_id:string,"
    "page_path:string,position_seconds:string,duration_seconds:string,listened_seconds:string,playback_rate:string,referrer:string>>"
)
SCHEMA_VERSION = 2


def read_videos(spark: SparkSession, path: str) -> DataFrame:
    """Video listings, one JSON array a file; rows without an id are dropped. Documents of ``write_json`` are found by their pointer."""
    return spark.read.schema(VIDEO).option("multiLine", True).json(pointer.resolve(spark, path)).where(~is_blank("video_id"))


def read_study_payload(spark: SparkSession, path: str) -> DataFrame:
    """Playlists of study payloads, one row each with their videos; another schema version fails the job."""
    payload = spark.read.schema(PAYLOAD).option("multiLine", True).json(pointer.resolve(spark, path))
    checked = payload.where(F.when(F.col("schema_version") == SCHEMA_VERSION, True).otherwise(F.raise_error(F.concat(F.lit("schema_version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("missing"))))))
    return checked.select("captured_at", "complete_snapshot", F.inline_outer("playlists"))


def _renamed(df: DataFrame) -> DataFrame:
    names = {"content:encoded": "content", "wp:post_id": "post_id", "wp:post_date": "post_date", "wp:post_name": "slug", "wp:status": "status", "wp:post_parent": "post_parent", "wp:post_type": "post_type", "wp:attachment_url": "attachment_url", "wp:post_mime_type": "mime_type"}
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(names.get(c, c)) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def read_wxr(spark: SparkSession, path: str) -> DataFrame:
    """Items of a website export with their categories."""
    return _renamed(spark.read.format("xml").option("rowTag", "item").schema(TALK_POST).load(path))


def read_wxr_pages(spark: SparkSession, path: str) -> DataFrame:
    """Items of a website export as pages and attachments."""
    return _renamed(spark.read.format("xml").option("rowTag", "item").schema(POST).load(path))


def latest_export(spark: SparkSession, folder: str, pattern: str) -> str:
    """The last file of a folder by name; raises without one."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).agg(F.max("path")).first()[0]
    if found is None:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return found


def load_alias_dim(spark: SparkSession, path: str) -> DataFrame:
    """``alias, name`` of lines ``key: value``; keys folded, comments and section names skipped."""
    line = r"^\s*[\"']?([^#\"':]+)[\"']?\s*:\s*[\"']?([^\"'#]+?)[\"']?\s*$"
    rows = spark.read.text(path).select(F.regexp_extract("value", line, 1).alias("k"), F.regexp_extract("value", line, 2).alias("name"))
    return rows.where("k <> '' AND name <> ''").select(fold("k").alias("alias"), F.trim("name").alias("name")).dropDuplicates(["alias"])


def event_batches(spark: SparkSession, folder: str, streaming: bool = True) -> DataFrame:
    """Landed event batches with the facts of their transport."""
    return (spark.readStream if streaming else spark.read).schema(EVENT).json(folder)


def file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length`` of the files of a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return files.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "length")


def memberships(items: DataFrame) -> DataFrame:
    """Landed pages ``page, items array<struct<video_id, ...>>`` as playlist members, numbered from 1 without blank ids."""
    rows = items.select("playlist_id", "page", F.posexplode("items").alias("pos", "item")).select("playlist_id", "page", "pos", "item.*").where(~is_blank("video_id"))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("playlist_id").orderBy("page", "pos"))).drop("page", "pos")


def flatten_pages(pages: DataFrame, kind: str) -> DataFrame:
    """Landed pages ``items array<struct>`` as flat rows: study playlists by folded title, details, or titles."""
    rows = pages.select(F.inline_outer("items"))
    if kind == "playlists":
        return rows.where(is_study_playlist("title")).orderBy(fold("title"), "playlist_id")
    if kind == "titles":
        return rows.where(~is_blank("title")).select("kind", "ref_id", F.trim("title").alias("title"))
    return rows.where(~is_blank("video_id")).withColumn("title", text("title"))
