"""URL columns by the generic syntax of RFC 3986; never fails on odd input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let, text, unescape

_SYNTAX = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"

#: File extensions by kind of resource (fixed values).
EXTENSIONS = {
    "audio": ("aac", "flac", "m4a", "mp3", "oga", "ogg", "wav", "wma"),
    "pdf": ("pdf",),
    "word": ("doc", "docx", "odt", "rtf"),
    "presentation": ("odp", "ppt", "pptx"),
    "spreadsheet": ("csv", "ods", "xls", "xlsx"),
    "image": ("avif", "gif", "jpeg", "jpg", "png", "svg", "webp"),
    "video_file": ("avi", "m4v", "mkv", "mov", "mp4", "mpeg", "webm"),
    "archive": ("7z", "rar", "tar", "gz", "zip"),
}
VIDEO_HOSTS = ("youtube.com", "youtu.be", "m.youtube.com")
PLATFORM_HOSTS = ("vimeo.com", "www.vimeo.com", "player.vimeo.com")
DOCUMENT_HOSTS = ("docs.google.com", "drive.google.com")
MIME_TYPES = {"mp3": "audio/mpeg", "m4a": "audio/mp4", "wav": "audio/wav", "ogg": "audio/ogg"}


def part(c: Column | str, which: str) -> Column:
    """``scheme``, ``authority``, ``path``, ``query`` or ``fragment`` of a URL; missing parts are empty."""
    return F.regexp_extract(text(c), _SYNTAX, 1 + ("scheme", "authority", "path", "query", "fragment").index(which))


def unquote(c: Column | str) -> Column:
    """Percent sequences decoded, plus signs kept; unchanged where they are not valid."""
    return F.coalesce(F.try_url_decode(F.replace(text(c), F.lit("+"), F.lit("%2B"))), text(c))


def query_value(c: Column | str, name: str) -> Column:
    """The first value of a query parameter, else the empty string."""
    return F.regexp_extract(part(c, "query"), rf"(?:^|&){name}=([^&#]+)", 1)


def canonical_url(c: Column | str, site_host: str = "example.org") -> Column:
    """One spelling per resource: https for the site, one form of video links, no www, no fragment, no closing slash."""
    raw = F.regexp_replace(F.trim(unescape(F.trim(text(c)))), r"[.,;]+$", "")
    parts = lambda r: F.struct(
        r.alias("raw"),
        F.lower(part(r, "scheme")).alias("scheme"),
        F.regexp_replace(F.lower(part(r, "authority")), r"^www\.", "").alias("host"),
        part(r, "path").alias("path"),
        part(r, "query").alias("query"),
        query_value(r, "v").alias("v"),
    )
    return let(let(F.when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).otherwise(raw), parts), lambda p: _joined(p, site_host))


def _joined(p: Column, site_host: str) -> Column:
    host, path, query = p["host"], p["path"], p["query"]
    video = (
        F.when(host == "youtu.be", F.regexp_extract(path, "^/*([^/]+)", 1))
        .when(host.isin(*VIDEO_HOSTS) & (path == "/watch"), p["v"])
        .when(host.isin(*VIDEO_HOSTS), F.regexp_replace(F.regexp_extract(path, "^/(?:embed|shorts|live)/(.*)$", 1), "/+$", ""))
        .otherwise("")
    )
    clean = F.regexp_replace(unquote(path), "/+$", "")
    whole = F.concat(
        F.when(host == site_host, "https").otherwise(p["scheme"]),
        F.lit("://"),
        host,
        F.when(clean == "", "/").otherwise(clean),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )
    return F.when(host == "", p["raw"]).when(video != "", F.concat(F.lit("https://youtube.com/watch?v="), video)).otherwise(whole)


def file_name(c: Column | str) -> Column:
    return F.regexp_extract(unquote(part(c, "path")), r"([^/]*)$", 1)


def url_ext(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(file_name(c), r"\.([^.]*)$", 1))


def resolve_url(c: Column | str, base: Column | str) -> Column:
    """A link on a page as an absolute URL; links without a target are empty."""
    scheme, authority = part(base, "scheme"), part(base, "authority")
    folder = F.regexp_extract(part(base, "path"), r"^(.*/)", 1)
    return let(
        F.regexp_replace(F.trim(unescape(F.trim(text(c)))), r"[.,;]+$", ""),
        lambda raw: F.when((raw == "") | raw.rlike("^(#|data:|javascript:|mailto:)"), "")
        .when(raw.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), raw)
        .when(raw.startswith("//"), F.concat(scheme, F.lit(":"), raw))
        .when(raw.startswith("/"), F.concat(scheme, F.lit("://"), authority, raw))
        .when(raw.startswith("?"), F.concat(scheme, F.lit("://"), authority, part(base, "path"), raw))
        .otherwise(F.concat(scheme, F.lit("://"), authority, F.when(folder == "", "/").otherwise(folder), raw)),
    )


def kind_of_extension(extension: Column) -> Column:
    pairs = [(e, kind) for kind, extensions in EXTENSIONS.items() for e in extensions]
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])[extension]


def host_of(c: Column | str, site_host: str = "example.org") -> Column:
    return F.lower(part(canonical_url(c, site_host), "authority"))


def is_supported_url(c: Column | str) -> Column:
    return kind_of_extension(url_ext(c)).isNotNull() | host_of(c).isin(*DOCUMENT_HOSTS, *VIDEO_HOSTS, *PLATFORM_HOSTS)


def resource_type(url: Column | str, tag: Column | str, mime: Column | str, is_known: Column, site_host: str = "example.org") -> Column:
    """What a link leads to, by the first rule that fits: host, extension, media type, tag, site."""
    found = let(canonical_url(url, site_host), lambda c: F.struct(F.lower(part(c, "authority")).alias("host"), kind_of_extension(url_ext(c)).alias("kind")))
    return let(found, lambda f: _kind(f["host"], f["kind"], tag, mime, is_known, site_host))


def _kind(host: Column, kind: Column, tag: Column | str, mime: Column | str, is_known: Column, site_host: str) -> Column:
    m = F.lower(text(mime))
    return (
        F.when(host.isin(*VIDEO_HOSTS), "youtube")
        .when(host.isin(*PLATFORM_HOSTS), "video_platform")
        .when(kind.isNotNull(), kind)
        .when(m.startswith("audio/"), "audio")
        .when(m == "application/pdf", "pdf")
        .when(m.startswith("image/") | (col(tag) == "img"), "image")
        .when(m.startswith("video/"), "video_file")
        .when(host.rlike(r"(docs|drive)\.google\.com"), "document")
        .when(is_known | host.endswith(site_host), "internal_link")
        .otherwise("external_link")
    )


def resource_name(url: Column | str, kind: Column | str, fallback: Column | str) -> Column:
    """A link's file name, else its video or list id, else its host, else the fallback."""
    name = F.regexp_extract(F.regexp_replace(unquote(part(url, "path")), "/+$", ""), r"([^/]*)$", 1)
    ident = F.when(col(kind) == "youtube", F.coalesce(F.nullif(query_value(url, "v"), F.lit("")), query_value(url, "list"))).otherwise("")
    host = F.regexp_replace(F.lower(part(url, "authority")), r"^www\.", "")
    return (
        F.when(~name.isin("", "watch", "playlist"), name)
        .when(ident != "", ident)
        .when(host != "", host)
        .otherwise(F.coalesce(F.nullif(F.trim(text(fallback)), F.lit("")), text(url)))
    )


def media_ref(c: Column | str) -> Column:
    """``struct<kind, id>`` of a platform link: a video, a playlist, or nulls."""
    video = F.coalesce(
        F.nullif(query_value(c, "v"), F.lit("")),
        F.when(part(c, "authority").rlike(r"(^|\.)youtu\.be$"), F.nullif(F.regexp_extract(part(c, "path"), "^/([^/]+)", 1), F.lit(""))),
        F.nullif(F.regexp_extract(part(c, "path"), "^/(?:embed|shorts|live)/([^/]+)", 1), F.lit("")),
    )
    listed = F.nullif(query_value(c, "list"), F.lit(""))
    return F.struct(F.when(video.isNotNull(), "video").when(listed.isNotNull(), "playlist").alias("kind"), F.coalesce(video, listed).alias("id"))


def is_self(url: Column | str, item_id: Column | str, link: Column | str) -> Column:
    ids = F.regexp_extract_all(part(url, "query"), F.lit(r"(?:^|&)(?:page_id|p)=([^&]+)"), F.lit(1))
    return (canonical_url(url) == canonical_url(link)) | F.array_contains(ids, text(item_id))


def mime_of(c: Column | str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in MIME_TYPES.items() for x in kv])[F.regexp_extract(F.lower(text(c)), r"\.([a-z0-9]+)$", 1)], F.lit(""))


def ext_of(url: Column | str, mime: Column | str) -> Column:
    """A file's extension with its dot, from the URL, else from the media type, else ``.mp3``."""
    back = {m: e for e, m in MIME_TYPES.items()}
    known = F.create_map(*[F.lit(x) for kv in back.items() for x in kv])[F.lower(text(mime))]
    return F.concat(F.lit("."), F.when(url_ext(url).isin(*MIME_TYPES), url_ext(url)).otherwise(F.coalesce(known, F.lit("mp3"))))


def safe_component(c: Column | str, suffix: Column, limit: int = 180) -> Column:
    """A file-system-safe name of at most ``limit`` UTF-8 bytes that ends in ``suffix``."""
    plain = F.regexp_replace(unquote(c), r'[<>:"/\\|?*\x00-\x1f]', "_")
    plain = F.regexp_replace(F.trim(F.regexp_replace(plain, r"\s+", " ")), r"[ .]+$", "")
    plain = F.when(F.lower(plain).rlike(r"^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|$)"), F.concat(F.lit("_"), plain)).otherwise(plain)
    plain = F.when(plain == "", "_").otherwise(plain)
    room = F.lit(limit) - F.octet_length(suffix)
    raw = F.encode(plain, "UTF-8")
    cuts = [F.try_validate_utf8(F.substring(raw, F.lit(1), room - k).cast("string")) for k in range(4)]  # a character has at most four bytes
    return F.concat(F.when(F.octet_length(plain) <= room, plain).otherwise(F.coalesce(*cuts)), suffix)


def download_link(c: Column | str) -> Column:
    """The public link of a stored path: its last component below ``/media/``."""
    name = F.regexp_extract(text(c), r"([^/\\]+)$", 1)
    return F.when(name == "", "").otherwise(F.concat(F.lit("/media/"), name))


def is_valid_link(c: Column | str) -> Column:
    """Blank, rooted, or http(s) with a host."""
    v = F.trim(text(c))
    return (v == "") | v.rlike(r"^/(?!/)") | v.rlike(r"(?i)^https?://[^/?#]+")


def is_checkable(c: Column | str, domains: tuple[str, ...]) -> Column:
    host = F.lower(part(c, "authority"))
    return host.rlike(r"(^|\.)(" + "|".join(d.replace(".", r"\.") for d in domains) + ")$")


def ref_host(c: Column | str) -> Column:
    """Host of a referrer in lower case, at most 255 characters."""
    host = F.regexp_replace(F.regexp_replace(part(c, "authority"), "^.*@", ""), r":\d*$", "")
    return F.lower(F.substring(host, 1, 255))
