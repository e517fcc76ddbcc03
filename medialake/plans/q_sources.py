"""Queries over scans of landed files and the jobs that shape them."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialake.bindings import table
from medialake.functions import text as x
from medialake.plans import studies, talks
from medialake.plans.q_jobs import NOW
from medialake.plans.registry import query
from medialake.sources import readers
from medialake.sources.scratch import fresh_path


def _day(c):
    return F.date_format(c, "yyyy-MM-dd")


@query("SELECT p_partkey, x.domain, CASE x.domain WHEN 'category' THEN p_brand ELSE p_type END AS term, p_name AS title, 'publish' AS status FROM part, (VALUES ('category'), ('post_tag')) x(domain)")
def s03_talk_export(spark, sf_dir):
    """Exports of a thousand items each, written as XML documents and scanned."""
    path = fresh_path(spark, "export")
    cell = lambda tag, value: F.concat(F.lit(f"<{tag}>"), value, F.lit(f"</{tag}>"))
    term = lambda domain, value: F.concat(F.lit(f'<category domain="{domain}">'), value, F.lit("</category>"))
    item = F.concat(F.lit("<item>"), cell("title", F.col("p_name")), cell("wp:post_id", F.col("p_partkey").cast("string")), cell("wp:status", F.lit("publish")), term("category", F.col("p_brand")), term("post_tag", F.col("p_type")), F.lit("</item>"))
    head, tail = '<rss xmlns:wp="w" xmlns:content="c"><channel>', "</channel></rss>"
    documents = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 1000)).agg(F.concat(F.lit(head), F.array_join(F.collect_list(item), ""), F.lit(tail)).alias("value"))
    documents.select("value").write.option("maxRecordsPerFile", 1).text(path)
    read = readers.read_wxr(spark, path).select(F.col("post_id").cast("long").alias("p_partkey"), "title", "status", F.explode("category").alias("c"))
    return read.select("p_partkey", "title", "status", F.col("c._domain").alias("domain"), F.col("c._VALUE").alias("term"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)")
def s05_latest_export(spark, sf_dir):
    """One export a year; the last by name is read."""
    path = fresh_path(spark, "exports")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.year("o_orderdate").alias("year"))
    o.repartition("year").write.partitionBy("year").json(path)
    return spark.read.schema("o_orderkey long, o_orderpriority string").json(readers.latest_export(spark, path, "*.json"))


@query("SELECT CAST(c_nationkey AS VARCHAR) AS nation, CAST(sum(octet_length(encode(c_name)) + 1) AS BIGINT) AS bytes FROM customer GROUP BY 1")
def s09_file_inventory(spark, sf_dir):
    """Sizes of files in folders by nation, against the bytes that were written."""
    path = fresh_path(spark, "files")
    table(spark, sf_dir, "customer").select(F.col("c_name").alias("value"), "c_nationkey").write.partitionBy("c_nationkey").text(path)
    files = readers.file_inventory(spark, path)
    return files.groupBy(F.regexp_extract("path", r"c_nationkey=(\d+)", 1).alias("nation")).agg(F.sum("length").alias("bytes"))


_POSTS = "SELECT *, 'https://example.org/' || o_orderkey AS link, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders WHERE o_orderkey % 10 <> 0 AND strftime(o_orderdate, '%Y-%m-%d') <= '1997-06-30'"


@query(
    f"WITH posts AS ({_POSTS}), best AS (SELECT d, max(link) AS link FROM posts GROUP BY d) SELECT d AS preaching_date, link AS source_item_id, 'Vida ' || o_orderkey AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'Ana de Souza' ELSE '' END AS preacher_name,"
    " 'Romanos ' || (o_orderkey % 16 + 1) AS text_reference, o_orderpriority AS serie, CASE WHEN o_orderkey % 2 = 0 THEN link || '.mp3' END AS source_url FROM posts JOIN best USING (d, link)"
)
def e02_load_posts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    link, even = F.concat(F.lit("https://example.org/"), "o_orderkey"), F.col("o_orderkey") % 2 == 0
    term = lambda value, domain: F.struct(value.alias("_VALUE"), F.lit(domain).alias("_domain"))
    items = o.select(
        link.alias("link"), F.concat(F.lit("Vida "), "o_orderkey", F.lit(" - Romanos "), (F.col("o_orderkey") % 16 + 1).cast("string")).alias("title"),
        F.when(even, F.concat(F.lit('<a href="'), link, F.lit('.mp3">x</a> por Ana Souza'))).otherwise("<p>texto</p>").alias("content"),
        F.concat(_day("o_orderdate"), F.lit(" 10:00:00")).alias("post_date"), F.when(F.col("o_orderkey") % 10 == 0, "draft").otherwise("publish").alias("status"),
        F.array(term(F.lit("Mensagens"), "category"), term(F.concat(F.lit("Série: "), "o_orderpriority"), "post_tag")).alias("category"),
    )
    books = spark.createDataFrame([(i, b, b.title()) for i, b in enumerate(x.CANON)], "position int, folded string, book string")
    aliases = spark.createDataFrame([("ana", "Ana de Souza")], "alias string, name string")
    _, meta, media = talks.load_posts(items, aliases, books, NOW, "1997-06-30", "Mensagens")
    return meta.join(media.select("canonical_sermon_id", "source_url"), "canonical_sermon_id", "left").select("preaching_date", "source_item_id", "title", "preacher_name", "text_reference", "serie", "source_url")


@query("SELECT 'wordpress:' || p_partkey AS study_key, CASE WHEN p_partkey = 1 THEN 'weekly' ELSE 'ctb' END AS study_type, p_name AS title, CAST(CASE WHEN p_partkey BETWEEN 1900 AND 2099 THEN p_partkey ELSE 2000 + p_partkey % 20 END AS VARCHAR) AS study_date, 'https://example.org/f' || p_partkey || '.pdf' AS canonical_url FROM part WHERE p_partkey % 5 <> 0")
def e04_discover_studies(spark, sf_dir):
    """Root pages that link a hundred pages each, some not public; one weekly root with a page below it and one elsewhere.

    A page's date is its post's, but for those whose file name reads as a year.
    """
    p = table(spark, sf_dir, "part")
    key, none = F.col("p_partkey").cast("string"), F.lit("")
    anchor = lambda target: F.concat(F.lit('<a href="'), target, F.lit('">x</a>'))
    address = F.concat(F.lit("https://example.org/s"), key)

    def page(ident, title, slug, link, content, date, status=F.lit("publish"), parent=none):
        fields = {"post_id": ident, "title": title, "slug": slug, "link": link, "content": content, "post_date": date, "status": status, "post_parent": parent, "post_type": F.lit("page"), "attachment_url": none, "mime_type": none}
        return [c.alias(n) for n, c in fields.items()]

    date = F.concat((F.col("p_partkey") % 20 + 2000).cast("string"), F.lit("-03-01 10:00:00"))
    own = p.select(*page(key, F.col("p_name"), F.concat(F.lit("s"), key), address, anchor(F.concat(F.lit("https://example.org/f"), key, F.lit(".pdf"))), date, F.when(F.col("p_partkey") % 5 == 0, "draft").otherwise("publish"), F.when(F.col("p_partkey") == 1, "w").otherwise("0")))
    group = p.groupBy(F.floor(F.col("p_partkey") / 100).cast("string").alias("g")).agg(F.array_join(F.collect_list(anchor(address)), " ").alias("links"))
    day = F.lit("2000-01-01 00:00:00")
    roots = group.select(*page(F.concat(F.lit("r"), "g"), F.lit("CTB"), F.lit("ctb"), F.concat(F.lit("https://example.org/r"), "g"), F.col("links"), day))
    weekly = spark.range(1).select(*page(F.lit("w"), F.lit("Semanais"), F.lit("semanais"), F.lit("https://example.org/w"), F.concat(anchor(F.lit("https://example.org/s1")), anchor(F.lit("https://example.org/s2"))), day))
    found, resources = studies.discover_studies(own.unionByName(roots).unionByName(weekly), {"semanais": "weekly", "ctb": "ctb"}, "semanais")
    return found.join(resources.select("study_key", "canonical_url"), "study_key", "left").select("study_key", "study_type", "title", "study_date", "canonical_url")


@query(
    "WITH v AS (SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders), low AS (SELECT o_custkey, min(d) AS oldest FROM v GROUP BY 1) SELECT CAST(c_custkey AS VARCHAR) AS playlist_id, CASE c_custkey % 4 WHEN 0 THEN 'weekly' WHEN 1 THEN 'ctb' ELSE 'lecture_or_conference' END AS study_type,"
    " oldest AS oldest_video_date, CAST(o_orderkey AS VARCHAR) AS video_id, d AS effective_date, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS place FROM customer JOIN low ON c_custkey = low.o_custkey JOIN v ON c_custkey = v.o_custkey WHERE c_custkey % 4 <> 3 AND d >= '1995-01-01'"
)
def e06_study_bronze(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("Estudo ", "CTB ", "Retiro ", "Culto "))), (F.col("c_custkey") % 4 + 1).cast("int"))
    playlists = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("playlist_id"), F.concat(kind, "c_name").alias("title"))
    o = table(spark, sf_dir, "orders")
    video, odd = F.col("o_orderkey").cast("string").alias("video_id"), F.col("o_orderkey") % 2 == 1
    items = o.select(F.col("o_custkey").cast("string").alias("playlist_id"), video, F.col("o_orderkey").alias("position"))
    videos = o.select(
        video, F.col("o_orderpriority").alias("title"), F.when(odd, F.concat(F.lit("Data "), F.date_format("o_orderdate", "dd/MM/yyyy"))).otherwise("").alias("description"),
        F.when(odd, "2030-01-01T15:00:00Z").otherwise(F.concat(_day("o_orderdate"), F.lit("T15:00:00Z"))).alias("published_at"),
    )
    shaped = studies.shape_study_bronze(playlists, items, videos, "1995-01-01")
    return shaped.select("playlist_id", "study_type", "oldest_video_date", F.posexplode("videos").alias("place", "v")).select("playlist_id", "study_type", "oldest_video_date", "place", "v.video_id", "v.effective_date")


@query(
    "SELECT 'wordpress:pfd:' || p_partkey AS study_key, 'r' || (p_partkey // 100) || ':pfd:' || p_partkey AS source_item_id, 'pfd' AS study_type, CAST(2000 + p_partkey % 20 AS VARCHAR) AS study_date, 'https://example.org/r' || (p_partkey // 100) AS source_url,"
    " 'https://example.org/wp-content/uploads/' || (2000 + p_partkey % 20) || '/05/PFD-' || p_partkey || '.pdf' AS canonical_url FROM part WHERE p_partkey > 0"
)
def e04_numbered_studies(spark, sf_dir):
    """Weekly root pages that link a hundred numbered files each, some twice: every number is a study of its own, dated by the year it was put up."""
    p = table(spark, sf_dir, "part").where("p_partkey > 0")
    key = F.col("p_partkey").cast("string")
    file = F.concat(F.lit("https://example.org/wp-content/uploads/"), (F.col("p_partkey") % 20 + 2000).cast("string"), F.lit("/05/PFD-"), key, F.lit(".pdf"))
    anchor = F.concat(F.lit('<a href="'), file, F.lit('">PFD '), key, F.lit("</a>"))
    group = F.floor(F.col("p_partkey") / 100).cast("string")
    pages = p.groupBy(group.alias("g")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(anchor, anchor)).otherwise(anchor).alias("a"))))["a"], " ").alias("content"))
    none = F.lit("")
    fields = {"post_id": F.concat(F.lit("r"), "g"), "title": F.lit("Semanais"), "slug": F.lit("semanais"), "link": F.concat(F.lit("https://example.org/r"), "g"), "content": F.col("content"), "post_date": F.lit("2000-01-01 00:00:00"), "status": F.lit("publish"), "post_parent": none, "post_type": F.lit("page"), "attachment_url": none, "mime_type": none}
    found, resources = studies.discover_studies(pages.select(*[c.alias(n) for n, c in fields.items()]), {"semanais": "weekly"}, "semanais")
    return found.join(resources.select("study_key", "canonical_url"), "study_key").select("study_key", "source_item_id", "study_type", "study_date", "source_url", "canonical_url")
