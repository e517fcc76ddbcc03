"""Joins of the media domain. No side is broadcast by hint: the adaptive planner does so behind its size check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialake.functions.similar import first_alike
from medialake.functions.text import is_blank, let, text
from medialake.functions.urls import canonical_url, query_value
from medialake.operators.pick import latest, rows_by
from medialake.sources.scratch import fresh_path, stored


def with_parent(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent, key)


def resource_text(resources: DataFrame, studies: DataFrame, assets: DataFrame, texts: DataFrame) -> DataFrame:
    """Each resource with its study and the latest text of its asset."""
    newest = latest(texts, ["asset_id"], ["transcript_version"])
    return resources.join(studies, "study_id").join(assets, "resource_id").join(newest, "asset_id")


def assets_with_date(assets: DataFrame, meta: DataFrame, key: str = "canonical_sermon_id") -> DataFrame:
    dates = meta.groupBy(key).agg(F.max("preaching_date").alias("preaching_date"))
    return assets.join(dates, key, "left")


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work whose key is not among what is done."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def exists_flag(df: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    marks = other.select(key).distinct().withColumn(name, F.lit(1))
    return df.join(marks, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def unless_sibling(df: DataFrame, group: str, blocker: Column, candidate: Column) -> DataFrame:
    """Rows that are no candidates, and candidates of groups without a blocking row."""
    blocked = df.where(blocker).select(group).distinct()
    return df.where(~candidate).unionByName(df.where(candidate).join(blocked, group, "left_anti").select(df.columns))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.where(~is_blank(key)).join(parent.select(key).distinct(), key, "left_anti")


def missing_downstream(src: DataFrame, dst: DataFrame, key: str, order: list[str], source: str = "source_system") -> DataFrame:
    """First row, with all its sources, of every key that the target lacks."""
    lost = src.join(dst.select(key).distinct(), key, "left_anti")
    sources = lost.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(source)), ", ").alias("sources"))
    return rows_by(lost, [key], [F.col(c) for c in order], largest=False).drop(source).join(sources, key)


def enrich_content(events: DataFrame, talks: DataFrame, studies: DataFrame) -> DataFrame:
    """Content ids with title and speaker of talk or study; without one the id itself."""
    t = talks.select(F.lit("sermon").alias("content_type"), F.col("canonical_sermon_id").alias("content_id"), F.col("title").alias("__t"), F.col("preacher_name").alias("__p"))
    s = studies.select(F.lit("study").alias("content_type"), F.col("study_id").alias("content_id"), F.col("title").alias("__t"), F.lit(None).cast("string").alias("__p"))
    out = events.join(t.unionByName(s), ["content_type", "content_id"], "left")
    return out.withColumns({"content_title": F.coalesce(F.nullif(F.col("__t"), F.lit("")), F.col("content_id")), "content_speaker": text("__p")}).drop("__t", "__p")


def attach_memberships(videos: DataFrame, items: DataFrame) -> DataFrame:
    """Videos with the sorted titles of the playlists they are in."""
    lists = items.select("video_id", "playlist_title").distinct().groupBy("video_id").agg(F.array_sort(F.collect_list("playlist_title")).alias("playlists"))
    return videos.join(lists, "video_id", "left").withColumn("playlists", F.coalesce("playlists", F.array().cast("array<string>")))


def merge_details(videos: DataFrame, details: DataFrame, key: str = "video_id") -> DataFrame:
    """Fields of the details over those of the listing, where the details have them."""
    shared = [c for c in details.columns if c != key]
    renamed = details.select(key, *[F.col(c).alias(f"__{c}") for c in shared])
    out = videos.join(renamed, key, "left")
    for c in shared:
        out = out.withColumn(c, F.coalesce(f"__{c}", c) if c in videos.columns else F.col(f"__{c}"))
    return out.drop(*[f"__{c}" for c in shared])


def replace_titles(resources: DataFrame, titles: DataFrame) -> DataFrame:
    """Labels from looked-up titles by ``(kind, ref_id)``; ``replaced`` says where the label changed."""
    out = resources.join(titles.select("kind", "ref_id", F.col("title").alias("__title")), ["kind", "ref_id"], "left")
    changed = ~is_blank("__title") & ~F.col("__title").eqNullSafe(F.col("label"))
    return out.withColumn("replaced", F.coalesce(changed, F.lit(False))).withColumn("label", F.when(F.col("replaced"), F.col("__title")).otherwise(F.col("label"))).drop("__title")


def match_books(titles: DataFrame, books: DataFrame, key: str, title: str, alike: bool = False) -> DataFrame:
    """Titles with the first book, in canon order, that they hold as a word; every row stays a row.

    ``books(position, folded, book)`` has 66 rows; more than 100 raise. They
    travel as one array, in which each title looks for itself. With ``alike`` a
    book that stands in the title as part of a word counts too where one of the
    title's words is alike to it; only such titles send anything to Python.
    """
    if books.count() > 100:
        raise ValueError("more than 100 books")
    listed = books.agg(F.array_sort(F.collect_list(F.struct("position", "folded", "book", F.concat(F.lit(" "), "folded", F.lit(" ")).alias("word")))).alias("__books"))
    words = F.concat(F.lit(" "), F.regexp_replace(F.col(title), "[^a-z0-9]+", " "), F.lit(" "))
    held = let(words, lambda w: F.filter("__books", lambda b: w.contains(b["word"])))  # a title is taken apart once, not for each book
    found = titles.crossJoin(F.broadcast(listed)).withColumn("__first", F.get(held, F.lit(0)))  # one row
    if alike:
        before = F.filter("__books", lambda b: F.col(title).contains(b["folded"]) & (F.col("__first").isNull() | (b["position"] < F.col("__first.position"))))
        near = F.nullif(F.transform(before, lambda b: b["folded"]), F.array().cast("array<string>"))
        place = F.array_position(F.transform("__books", lambda b: b["folded"]), first_alike(F.when(near.isNotNull(), F.col(title)), near))
        found = found.withColumn("__place", place).withColumn("__first", F.coalesce(F.get("__books", (F.col("__place") - 1).cast("int")), F.col("__first")))
    return found.select(*[titles[c] for c in titles.columns], F.col("__first.book").alias("book"), F.col("__first.folded").alias("folded"))


def batches(ids: DataFrame, ident: str, n: int = 50) -> DataFrame:
    """Distinct ids in order, in lists of at most ``n``: ``batch, ids``; null is no id.

    The ids are sorted into ranges, which are stored so that a lost one comes
    back as it was; only the sizes of the ranges, one row each, meet in one task.
    """
    spark = ids.sparkSession
    path = fresh_path(spark, "ranges")
    placed = ids.where(F.col(ident).isNotNull()).select(ident).distinct().repartitionByRange(ident).withColumn("__range", F.spark_partition_id())
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    number = F.row_number().over(Window.partitionBy("__range").orderBy(ident)) - 1
    numbered = placed.withColumn("__at", number).join(sizes, "__range").withColumn("batch", F.floor((F.col("__at") + F.col("__before")) / n))
    return numbered.groupBy("batch").agg(F.array_sort(F.collect_list(ident)).alias("ids"))


def calendar_gaps(expected: DataFrame, actual: DataFrame, exceptions: DataFrame, key: str = "day") -> DataFrame:
    return expected.join(actual.select(key).distinct(), key, "left_anti").join(exceptions, key, "left")


def resolve_links(links: DataFrame, pages: DataFrame, url: str = "url") -> DataFrame:
    """Links with the page they lead to: by the page id in the query, else by the page's own address."""
    ident = F.coalesce(F.nullif(query_value(url, "page_id"), F.lit("")), F.nullif(query_value(url, "p"), F.lit("")))
    by_id = pages.select(F.col("post_id").alias("__id"), F.col("post_id").alias("__a"))
    by_link = pages.groupBy(canonical_url("link").alias("__link")).agg(F.min("post_id").alias("__b"))
    out = links.withColumns({"__id": ident, "__link": canonical_url(url)}).join(by_id, "__id", "left").join(by_link, "__link", "left")
    return out.withColumn("page_id", F.coalesce("__a", "__b")).drop("__id", "__link", "__a", "__b")


def descendants(df: DataFrame, ident: str, parent: str, root: str, depth: int | None = None) -> DataFrame:
    """Ids at or below a root with their least ``level``, down to ``depth`` or to the end.

    Where every id has one parent, pointers are doubled: each round an id looks
    where the id it points to points, so a path of n steps takes log2(n) rounds,
    and what has not reached the root by then hangs on a cycle or leads nowhere.
    Ids with several parents are searched level by level.
    """
    rows = df.select(F.col(ident).alias("id"), F.col(parent).alias("parent")).where("id IS NOT NULL").distinct()
    several = rows.groupBy("id").agg(F.count("parent").alias("n")).where("n > 1")
    out = _by_levels(rows, root, depth) if not several.isEmpty() else _by_doubling(rows, root)
    return out if depth is None else out.where(F.col("level") <= depth)


def _by_doubling(rows: DataFrame, root: str) -> DataFrame:
    top = F.lit(root)
    found = stored(rows.where(F.col("id") == top).select("id").distinct().withColumn("level", F.lit(0)), "found")
    if found.isEmpty():
        return found
    start = rows.where((F.col("id") != top) & F.col("parent").isNotNull()).select("id", F.col("parent").alias("at"), F.lit(1).alias("level"))
    settled = [stored(start.where(F.col("at") == top), "settled")]
    going = stored(start.where(F.col("at") != top), "going")
    for _ in range(max(1, going.count()).bit_length() + 1):
        if going.isEmpty():
            break
        known = going
        for s in settled:
            known = known.unionByName(s)
        ahead = known.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("level").alias("more"))
        moved = stored(going.join(ahead, "at").select("id", F.col("next").alias("at"), (F.col("level") + F.col("more")).alias("level")), "moved")
        settled.append(moved.where(F.col("at") == top))
        going = moved.where(F.col("at") != top)
    for s in settled:
        found = found.unionByName(s.select("id", "level"))
    return found


def _by_levels(rows: DataFrame, root: str, depth: int | None) -> DataFrame:
    """Outwards from the root, each level stored; ids found before are not followed again, so cycles end."""
    found = last = stored(rows.where(F.col("id") == F.lit(root)).select("id").distinct().withColumn("level", F.lit(0)), "level")
    level = 0
    while (depth is None or level < depth) and not last.isEmpty():
        level += 1
        below = rows.join(last.select(F.col("id").alias("parent")), "parent").select("id").distinct()
        last = stored(below.join(found, "id", "left_anti").withColumn("level", F.lit(level)), "level")
        found = found.unionByName(last)
    return found


def reparent(children: DataFrame, mapping: DataFrame, key: str = "study_key") -> DataFrame:
    return children.join(mapping, key).drop(key)


def reconcile(candidates: DataFrame, assets: DataFrame, files: DataFrame) -> DataFrame:
    """Eligible resources with their asset, if any, and the size of its file, if it is there."""
    return candidates.join(assets, "resource_id", "left").join(files, "path", "left")


def asset_of(events: DataFrame, media: DataFrame, resources: DataFrame) -> DataFrame:
    """Events with path and length of what they play: a talk's audio, or a study's resource."""
    talk = media.select(F.lit("sermon").alias("content_type"), F.col("canonical_sermon_id").alias("content_id"), F.lit("").alias("resource_id"), F.col("local_path").alias("__path"), F.col("duration_seconds").alias("__seconds"))
    study = resources.select(F.lit("study").alias("content_type"), F.col("study_id").alias("content_id"), "resource_id", F.col("local_path").alias("__path"), F.col("duration_seconds").alias("__seconds"))
    keyed = events.withColumn("__r", F.when(F.col("content_type") == "study", text("resource_id")).otherwise(""))
    both = talk.unionByName(study).withColumnRenamed("resource_id", "__r")
    return keyed.join(both, ["content_type", "content_id", "__r"], "left").withColumnsRenamed({"__path": "asset_path", "__seconds": "asset_seconds"}).drop("__r")


def union_tagged(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    out = None
    for name, df in frames.items():
        one = df.withColumn(tag, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def key_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").orderBy(key)


def require_values(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """``df`` itself; raises where a value never occurs."""
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    absent = [r[0] for r in wanted.join(df.select(column).distinct(), column, "left_anti").collect()]
    if absent:
        raise ValueError(f"missing values: {sorted(absent)}")
    return df
