"""Queries over text and URL columns, and single-row scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialake.bindings import cte, table, view
from medialake.functions import text as x
from medialake.functions import times as t
from medialake.functions import urls as u
from medialake.functions.similar import is_similar
from medialake.plans.registry import query

_FOLD = "trim(lower(strip_accents(coalesce({}, ''))))"
_TITLE = cte("v_titles")
_WC = r"len(regexp_extract_all({}, '[^\s]+'))"


def titles(spark, sf_dir):
    return view(spark, sf_dir, "v_titles")


@query(_TITLE + f"SELECT p_partkey, {_FOLD.format('title')} AS folded FROM v_titles")
def t01_fold(spark, sf_dir):
    return titles(spark, sf_dir).select("p_partkey", x.fold("title").alias("folded"))


@query(cte("v_gold") + "SELECT canonical_sermon_id, nullif(trim(title), '') AS title, nullif(trim(serie), '') AS serie FROM v_gold")
def t02_blank_to_null(spark, sf_dir):
    return view(spark, sf_dir, "v_gold").select("canonical_sermon_id", x.blank_to_null("title").alias("title"), x.blank_to_null("serie").alias("serie"))


@query(_TITLE + f"""SELECT p_partkey, trim(p[1]) AS title, CASE WHEN len(p) > 1 THEN trim(p[2]) ELSE '' END AS reference,
  CASE WHEN len(p) > 1 AND {_WC.format('p[len(p)]')} <= 3 THEN trim(p[len(p)]) ELSE '' END AS speaker FROM (SELECT p_partkey, string_split(title, '|') AS p FROM v_titles)""")
def t03_title_parts(spark, sf_dir):
    return titles(spark, sf_dir).select("p_partkey", x.title_parts("title").alias("p")).select("p_partkey", "p.*")


@query(_TITLE + "SELECT p_partkey, len(title) - len(replace(title, '|', '')) >= 2 AS is_talk FROM v_titles")
def t04_is_talk(spark, sf_dir):
    return titles(spark, sf_dir).select("p_partkey", x.is_talk("title").alias("is_talk"))


@query("SELECT doc_id, trim(regexp_extract('Tema' || chr(10) || 'Pregador - ' || coalesce(text, '') || chr(10) || 'fim', '(?i)Pregador\\s*-\\s*([^\\r\\n]+)', 1)) AS label FROM documents")
def t05_label(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    made = F.concat(F.lit("Tema\nPregador - "), F.coalesce("text", F.lit("")), F.lit("\nfim"))
    return d.select("doc_id", x.extract_label(made).alias("label"))


@query("""SELECT p_partkey, nullif(trim(p_name), '') AS serie, CASE WHEN p_partkey % 2 = 0 THEN trim(p_brand) ELSE '' END AS speaker FROM part""")
def t06_series_from_playlists(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    lists = F.array(F.lit("Outros"), F.lit("Série velha"), F.concat(F.lit("Série: "), "p_name", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" ["), "p_brand", F.lit("]"))).otherwise("")))
    return p.select("p_partkey", x.series_from_playlists(lists).alias("s")).select("p_partkey", "s.*")


@query("SELECT p_partkey, trim(p_name || ' - ' || p_type) AS title FROM part")
def t08_clean_title(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", x.clean_title(F.concat(F.lit("  "), "p_name", F.lit(" â€“ "), "p_type")).alias("title"))


@query(_TITLE + f"SELECT p_partkey, CASE WHEN {_FOLD.format('h')} LIKE 'pregacao%' THEN '' ELSE h END AS head FROM (SELECT p_partkey, trim(regexp_extract(title, '(?s)^(.*) - ', 1)) AS h FROM v_titles)")
def t09_title_head(spark, sf_dir):
    return titles(spark, sf_dir).select("p_partkey", x.title_head("title").alias("head"))


@query("SELECT p_partkey, regexp_matches(word, '^[^0-9]+$') AND 2.0 * length(word) >= 0.9 * (2 * length(word) + p_partkey % 7) AS alike FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE p_type END AS word FROM part)")
def t11_similar(spark, sf_dir):
    """Words against themselves with up to six further letters, some with digits."""
    p = table(spark, sf_dir, "part").withColumn("word", F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand")).otherwise(F.col("p_type")))
    longer = F.concat("word", F.repeat(F.lit("~"), (F.col("p_partkey") % 7).cast("int")))
    return p.select("p_partkey", is_similar("word", longer).alias("alike"))


@query("SELECT page_id, 'https://example.org/a' || page_id || '.MP3' AS audio FROM pages")
def t12_first_audio(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    html = F.concat(F.regexp_replace("html", "https?://", "ftp:"), F.lit('<a href="https://example.org/x.pdf">x</a><a href="https://example.org/a'), "page_id", F.lit('.MP3">y</a><a href="https://example.org/z.ogg">z</a>'))
    return p.select("page_id", x.first_audio_url(html).alias("audio"))


@query("SELECT c_custkey, c_name AS speaker FROM customer")
def t13_speaker(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", x.speaker_from_html(F.concat(F.lit("<p>Mensagem Por "), F.col("c_name"), F.lit(" | 2020<br>por outro</p>"))).alias("speaker"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN '20' || strftime(o_orderdate, '%y-%m-%d') WHEN o_orderkey % 4 = 0 AND o_orderdate < TIMESTAMP '2000-01-01' THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date,
  CASE WHEN o_orderkey % 4 = 0 AND o_orderdate < TIMESTAMP '2000-01-01' THEN '' ELSE 'Ana' END AS speaker FROM orders""")
def t14_file_info(spark, sf_dir):
    """Years of two digits are of this century, and dates ahead of a word are taken from 2000 on."""
    o = table(spark, sf_dir, "orders")
    f = lambda p: F.date_format("o_orderdate", p)
    names = F.element_at(
        F.array(F.concat(f("yyyy_MM_dd"), F.lit("_Ana.mp3")), F.concat(F.lit("Ana_"), f("dd_MM_yy"), F.lit(".mp3")), F.concat(F.lit("Ana "), f("dd.MM.yyyy"), F.lit(".mp3")), F.concat(F.lit("Ana "), f("dd-MM-yyyy"), F.lit(".mp3"))),
        (F.col("o_orderkey") % 4 + 1).cast("int"),
    )
    return o.select("o_orderkey", x.file_info(F.concat(F.lit("https://example.org/up/"), names)).alias("i")).select("o_orderkey", "i.*")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS valid, CASE WHEN o_orderkey % 7 = 0 THEN '2001-13-31' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS raw FROM orders")
def t15_br_date(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    made = F.concat(F.lit("culto de "), F.when(F.col("o_orderkey") % 7 == 0, "31/13/2001").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")), F.lit(" e 01/01/1999"))
    return o.select("o_orderkey", x.first_br_date(made).alias("valid"), x.first_br_date(made, False).alias("raw"))


@query(cte("v_gold") + "SELECT canonical_sermon_id, coalesce(nullif(trim(title), ''), nullif(trim(serie), ''), nullif(trim(preacher_name), ''), '') AS chosen FROM v_gold")
def t16_precedence(spark, sf_dir):
    return view(spark, sf_dir, "v_gold").select("canonical_sermon_id", x.first_filled("title", "serie", "preacher_name").alias("chosen"))


@query(cte("v_metadata") + "SELECT source_item_id, lower(trim(coalesce(preacher_name, ''))) = 'nome sobrenome' AS placeholder FROM v_metadata")
def t17_placeholder(spark, sf_dir):
    return view(spark, sf_dir, "v_metadata").select("source_item_id", x.is_placeholder("preacher_name").alias("placeholder"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS serie, 1 AS n_tags FROM part")
def t18_t19_terms(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    term = lambda v, d: F.struct(v.alias("_VALUE"), F.lit(d).alias("_domain"))
    terms = F.array(term(F.lit(" culto "), "post_tag"), term(F.when(F.col("p_partkey") % 3 == 0, "Outro").otherwise(F.concat(F.lit("Série: "), "p_brand")), "category"))
    tags, cats = x.terms_by_domain(terms, "post_tag"), x.terms_by_domain(terms, "category")
    return p.select("p_partkey", x.series_from_terms(tags, cats).alias("serie"), F.size(tags).alias("n_tags"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'audio/mpeg' WHEN 1 THEN 'audio/mp4' WHEN 2 THEN '' ELSE 'audio/ogg' END AS mime,
  CASE p_partkey % 4 WHEN 0 THEN '.mp3' WHEN 1 THEN '.m4a' WHEN 2 THEN '.wav' ELSE '.ogg' END AS ext FROM part""")
def t20_mime(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("a.MP3", "b.m4a", "c", "d.ogg"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    url = F.concat(F.lit("https://example.org/x/"), name)
    return table(spark, sf_dir, "part").select("p_partkey", u.mime_of(url).alias("mime"), u.ext_of(url, F.lit("audio/wav")).alias("ext"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS best,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS dates, strftime(o_orderdate, '%Y') AS years FROM orders""")
def t21_t23_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    f = lambda p: F.date_format("o_orderdate", p)
    made = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("Ano "), f("yyyy"), F.lit(" 99/99/2001x9"))).otherwise(F.concat(F.lit("Em "), f("d.M.yyyy"), F.lit(" ou "), f("yyyy/MM/dd"), F.lit(" ou 40/40/"), f("yyyy")))
    made = F.regexp_replace(made, " 99/99/2001x9", "")
    return o.select("o_orderkey", x.text_date(made).alias("best"), F.array_join(x.explicit_dates(made), ",").alias("dates"), F.array_join(x.content_years(made), ",").alias("years"))


_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(title), '\s*\[[^\]]+\]\s*', ' ', 'g'),
  '(?i)\s*\|\s*CTB\s+(?:19|20)[0-9]{2}\s*$', ''), '(?i)^(?:\s*(?:CTB|Estudo|Confer[eê]ncia)\b\s*[:|\-]?\s*)+', ''), '\s+', ' ', 'g'), '^[ |:\-]+', ''), '[ |:\-]+$', '')"""


@query(_TITLE + f"SELECT p_partkey, CASE WHEN c = '' THEN trim(title) ELSE c END AS cleaned FROM (SELECT *, {_CLEAN} AS c FROM v_titles)")
def t24_clean_study_title(spark, sf_dir):
    return titles(spark, sf_dir).select("p_partkey", x.clean_study_title("title").alias("cleaned"))


@query(_TITLE + f"SELECT p_partkey, array_to_string(regexp_extract_all(lower(strip_accents(CASE WHEN c = '' THEN trim(title) ELSE c END)), '[a-z0-9]+'), ' ') AS ident FROM (SELECT *, {_CLEAN} AS c FROM v_titles)")
def t25_title_identity(spark, sf_dir):
    return titles(spark, sf_dir).select("p_partkey", x.title_identity("title").alias("ident"))


@query(_TITLE + f"SELECT p_partkey, regexp_matches({_FOLD.format('title')}, '^(estudo|ctb|conferencia|retiro|palestras|palestra) ') AS is_study FROM v_titles")
def t26_is_study(spark, sf_dir):
    return titles(spark, sf_dir).select("p_partkey", x.is_study_playlist("title").alias("is_study"))


@query(_TITLE + f"""SELECT p_partkey, CASE WHEN f LIKE 'ctb %' OR f LIKE '%treinamento biblico%' THEN 'ctb' WHEN f LIKE '%pfd%' OR f LIKE '%formacao de discipulos%' THEN 'pfd'
  WHEN f LIKE 'retiro %' OR f LIKE '%palestra%' OR f LIKE '%conferencia%' THEN 'lecture_or_conference' WHEN f LIKE '%ctb%' THEN 'ctb' ELSE 'weekly' END AS kind FROM (SELECT p_partkey, {_FOLD.format('title')} AS f FROM v_titles)""")
def t27_study_type(spark, sf_dir):
    return titles(spark, sf_dir).select("p_partkey", x.study_type(F.array("title")).alias("kind"))


@query("SELECT doc_id, sha256(coalesce(source, '') || chr(31) || coalesce(lang, '') || chr(31) || CAST(doc_id AS VARCHAR)) AS key FROM documents")
def t28_stable_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", x.stable_key("source", "lang", F.col("doc_id").cast("string")).alias("key"))


_HOST = r"regexp_replace(lower(regexp_extract(url, '^(?:[^:/?#]+:)?//([^/?#]*)', 1)), '^www\.', '')"
_PATH = r"regexp_extract(url, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1)"
_QUERY = r"regexp_extract(url, '\?([^#]*)', 1)"


@query(f"""SELECT page_id, CASE WHEN host = '' THEN url ELSE lower(regexp_extract(url, '^([^:/?#]+):', 1)) || '://' || host
  || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical
FROM (SELECT page_id, url, {_HOST} AS host, regexp_replace({_PATH}, '/+$', '') AS p, {_QUERY} AS q FROM pages)""")
def t29_canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", u.canonical_url("url", "site.invalid").alias("canonical"))


@query(f"SELECT page_id, lower(regexp_extract(regexp_extract({_PATH}, '([^/]*)$', 1), '\\.([^.]*)$', 1)) AS ext FROM pages")
def t30_url_ext(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", u.url_ext("url").alias("ext"))


@query(r"SELECT page_id, 'https://example.org/a/' || page_id AS rooted, 'https://example.org/dir/b' || page_id AS relative, '' AS anchor, 'https://cdn.example.org/c' AS protocol FROM pages")
def t31_resolve_url(spark, sf_dir):
    base, ident = F.lit("https://example.org/dir/page?x=1"), F.col("page_id").cast("string")
    made = {"rooted": F.concat(F.lit("/a/"), ident, F.lit(".,")), "relative": F.concat(F.lit("b"), ident), "anchor": F.concat(F.lit("#"), ident), "protocol": F.lit("//cdn.example.org/c")}
    return table(spark, sf_dir, "pages").select("page_id", *[u.resolve_url(c, base).alias(k) for k, c in made.items()])


_LINKS = ("https://example.org/a.PDF", "https://youtu.be/xyz", "https://vimeo.com/1", "https://docs.google.com/d/1", "https://site.invalid/page", "https://other.example/", "https://example.org/f.mp3?x=1", "https://example.org/k.zip")


def _links(spark, sf_dir):
    url = F.element_at(F.array(*map(F.lit, _LINKS)), (F.col("page_id") % len(_LINKS) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"))


@query("SELECT page_id, page_id % 8 NOT IN (4, 5) AS supported, ['pdf', 'youtube', 'video_platform', 'document', 'internal_link', 'external_link', 'audio', 'archive'][page_id % 8 + 1] AS kind FROM pages")
def t32_t33_resource_type(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", u.is_supported_url("url").alias("supported"), u.resource_type("url", F.lit("a"), F.lit(""), F.lit(False), "site.invalid").alias("kind"))


@query("SELECT page_id, ['a.PDF', 'xyz', '1', '1', 'page', 'other.example', 'f.mp3', 'k.zip'][page_id % 8 + 1] AS name FROM pages")
def t34_resource_name(spark, sf_dir):
    return _links(spark, sf_dir).withColumn("kind", F.lit("x")).select("page_id", u.resource_name("url", "kind", F.lit("?")).alias("name"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'playlist' END AS kind, CASE page_id % 3 WHEN 0 THEN 'v' || page_id WHEN 1 THEN 'l' || page_id END AS id FROM pages")
def t35_media_ref(spark, sf_dir):
    ident = F.col("page_id").cast("string")
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://youtube.com/watch?t=1&v=v"), ident, F.lit("&list=q"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://youtube.com/playlist?list=l"), ident)).otherwise("https://example.org/")
    return table(spark, sf_dir, "pages").select("page_id", u.media_ref(url).alias("r")).select("page_id", "r.*")


@query(f"SELECT doc_id, CAST({_WC.format('text')} AS INTEGER) AS words FROM documents")
def t36_word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", x.word_count("text").alias("words"))


@query("SELECT page_id, CAST(page_id AS INTEGER) AS pfd, CAST(2000 + page_id % 20 AS INTEGER) AS year FROM pages")
def t37_markers(spark, sf_dir):
    ident = F.col("page_id").cast("string")
    return table(spark, sf_dir, "pages").select("page_id", x.pfd_number(F.concat(F.lit("PFD_"), ident, F.lit(".pdf"))).alias("pfd"), x.upload_year(F.concat(F.lit("/uploads/"), (2000 + F.col("page_id") % 20).cast("string"), F.lit("/01/x.pdf"))).alias("year"))


@query("SELECT page_id, page_id % 3 <> 2 AS own FROM pages")
def t38_is_self(spark, sf_dir):
    ident = F.col("page_id").cast("string")
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://www.example.org/p"), ident, F.lit("/#top"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://example.org/?page_id="), ident)).otherwise("https://example.org/else")
    return table(spark, sf_dir, "pages").select("page_id", u.is_self(url, ident, F.concat(F.lit("https://example.org/p"), ident)).alias("own"))


@query("SELECT p_partkey, regexp_replace(trim(p_name), '[ .]+$', '') || '_x [' || p_partkey || '].mp3' AS name FROM part")
def t39_safe_component(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", u.safe_component(F.concat("p_name", F.lit("%3Ax. ")), F.concat(F.lit(" ["), F.col("p_partkey").cast("string"), F.lit("].mp3"))).alias("name"))


@query("SELECT p_partkey, '/media/f' || p_partkey || '.mp3' AS link FROM part")
def t40_download_link(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", u.download_link(F.concat(F.when(F.col("p_partkey") % 2 == 0, "C:\\data\\").otherwise("/data/"), F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".mp3"))).alias("link"))


@query(cte("v_gold") + r"SELECT canonical_sermon_id, coalesce(youtube_link, '') = '' OR regexp_matches(youtube_link, '^https?://[^/?#]+') AS valid, coalesce(regexp_matches(youtube_link, '^https://youtube\.com/'), false) AS checkable FROM v_gold")
def t41_t42_links(spark, sf_dir):
    return view(spark, sf_dir, "v_gold").select("canonical_sermon_id", u.is_valid_link("youtube_link").alias("valid"), u.is_checkable("youtube_link", ("youtube.com",)).alias("checkable"))


@query(cte("v_gold") + "SELECT canonical_sermon_id, split_part(trim(text_reference), ' ', 1) AS book FROM v_gold")
def t43_book_name(spark, sf_dir):
    return view(spark, sf_dir, "v_gold").select("canonical_sermon_id", x.book_name("text_reference").alias("book"))


_REFS = ("2Tm 3:16", "Gênesis 1", "1 Jo 2", "Sl 23", "Cânticos 1", "Foo 1", "3", "Apocalipse")


@query("""SELECT p_partkey, ['2 timoteo', 'genesis', '1 jo', 'salmos', 'canticos', 'foo', '', 'apocalipse'][p_partkey % 8 + 1] AS book, ['new', 'old', '', 'old', 'old', '', '', 'new'][p_partkey % 8 + 1] AS testament,
  CAST([54, 0, 66, 18, 21, 66, 66, 65][p_partkey % 8 + 1] AS INTEGER) AS position FROM part""")
def t44_t46_books(spark, sf_dir):
    ref = F.element_at(F.array(*map(F.lit, _REFS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", x.normalize_book(ref).alias("book"), x.testament(ref).alias("testament"), x.book_position(ref).alias("position"))


@query(cte("v_gold") + "SELECT canonical_sermon_id, strftime(CAST(preaching_date AS DATE), '%d/%m/%Y') AS shown FROM v_gold")
def t47_fmt_date(spark, sf_dir):
    return view(spark, sf_dir, "v_gold").select("canonical_sermon_id", x.fmt_date("preaching_date").alias("shown"))


@query(cte("v_gold") + """SELECT canonical_sermon_id, CASE WHEN s <= 0 THEN '' WHEN s // 3600 > 0 THEN (s // 3600) || 'h ' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'min' WHEN s // 60 > 0 THEN (s // 60) || ' min' ELSE s || 's' END AS long,
  CASE WHEN s // 60 >= 1 THEN (s // 60) || 'min' ELSE '' END AS short FROM (SELECT canonical_sermon_id, CAST(floor(duration_seconds) AS BIGINT) AS s FROM v_gold)""")
def t48_fmt_duration(spark, sf_dir):
    return view(spark, sf_dir, "v_gold").select("canonical_sermon_id", x.fmt_duration("duration_seconds").alias("long"), x.fmt_minutes("duration_seconds").alias("short"))


@query("""SELECT o_orderkey, CASE WHEN b < 1024 THEN CAST(CAST(b AS BIGINT) AS VARCHAR) || ' B' WHEN b < 1048576 THEN CASE WHEN b / 1024 >= 100 THEN printf('%.0f', round_even(b / 1024, 0)) ELSE printf('%.1f', round_even(b / 1024, 1)) END || ' KB'
  ELSE CASE WHEN b / 1048576 >= 100 THEN printf('%.0f', round_even(b / 1048576, 0)) ELSE printf('%.1f', round_even(b / 1048576, 1)) END || ' MB' END AS shown FROM (SELECT o_orderkey, CAST(floor(o_totalprice) * (o_orderkey % 3 * o_orderkey % 97 + 0.0) AS DOUBLE) AS b FROM orders)""")
def t49_fmt_bytes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", x.fmt_bytes((F.floor("o_totalprice") * ((F.col("o_orderkey") % 3 * F.col("o_orderkey") % 97).cast("double"))).cast("double")).alias("shown"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS day FROM orders")
def t52_to_iso_date(spark, sf_dir):
    made = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSS")).otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    return table(spark, sf_dir, "orders").select("o_orderkey", x.to_iso_date(made).alias("day"))


@query("SELECT event_id, sha256(CAST(user_id AS VARCHAR)) AS hash FROM events")
def t53_anon_hash(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", x.anon_hash(F.col("user_id").cast("string")).alias("hash"))


@query(r"SELECT page_id, lower(regexp_extract(url, '^(?:[^:/?#]+:)?//([^/?#:]*)', 1)) AS host FROM pages")
def t54_ref_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", u.ref_host("url").alias("host"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS inferred FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, strftime(o_orderdate, '%Y') FROM orders WHERE o_orderkey % 2 = 1")
def t55_infer_study_date(spark, sf_dir):
    title = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Aula "), F.date_format("o_orderdate", "dd-MM-yyyy"))).otherwise("Aula")
    return table(spark, sf_dir, "orders").select("o_orderkey", x.infer_study_date(title, F.lit(""), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("inferred"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a b' WHEN 1 THEN p_brand ELSE p_name END AS label FROM part")
def t57_element_label(spark, sf_dir):
    visible = F.when(F.col("p_partkey") % 3 == 0, " a \n b ").otherwise(" ")
    alt = F.when(F.col("p_partkey") % 3 == 1, F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", x.element_label(visible, F.lit(""), alt, "p_name").alias("label"))


@query(cte("v_candidates") + r"""SELECT video_id, CASE WHEN duration = 'P0D' THEN 0.0 WHEN duration = '' THEN NULL ELSE CAST(regexp_extract(duration, '([0-9]+)H', 1) AS DOUBLE) * 3600 + CAST(regexp_extract(duration, '([0-9]+)M', 1) AS DOUBLE) * 60 END AS seconds,
  duration NOT IN ('', 'P0D') AS positive FROM v_candidates""")
def d03_d04_durations(spark, sf_dir):
    return view(spark, sf_dir, "v_candidates").select("video_id", t.iso_duration_seconds("duration").alias("seconds"), t.has_positive_duration(F.lit(None), "duration").alias("positive"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '2001-01-01' WHEN o_orderkey % 3 = 1 THEN '1990-05-05' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS oldest FROM orders")
def d10_oldest_date(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    videos = F.when(k == 1, F.array(F.lit("1999-01-01"), F.lit("1990-05-05"), F.lit(""))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "orders").select("o_orderkey", t.oldest_date(F.when(k == 0, "2001-01-01"), videos, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("oldest"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS TIMESTAMP) AS VARCHAR) END AS instant FROM orders")
def d11_to_instant(spark, sf_dir):
    made = F.when(F.col("o_orderkey") % 4 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(t.to_instant(made), "yyyy-MM-dd HH:mm:ss").alias("instant"))
