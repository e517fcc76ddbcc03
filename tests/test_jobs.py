"""Jobs, stored tables, sources and streams on small inputs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from medialake.functions.text import CANON
from medialake.operators import aggs, filters, joins, pick
from medialake.plans import quality, serving, studies, talks
from medialake.sources import readers
from medialake.sources import tables as k
from medialake.sources.scratch import fresh_path
from medialake.streaming import events as stream

NOW = dt.datetime(2026, 10, 22)


def videos(spark, rows):
    full = [(v, title, d, p, None, f"https://youtube.com/watch?v={v}", False, live, dur, "1", pl) for v, title, d, p, live, dur, pl in rows]
    return spark.createDataFrame(full, readers.VIDEO)


def test_load_videos(spark):
    aliases = spark.createDataFrame([("ana", "Ana Souza")], "alias string, name string")
    rows = [
        ("v1", "Fé | Romanos 1 | Ana", "", "2026-10-18T15:00:00Z", None, "PT1H", []),
        ("v2", "Fé ao vivo | Rm 1 | Bia Lima", "", "2026-10-18T20:00:00Z", None, "P0D", ["Série: Graça [Caio]"]),
        ("v3", "Aviso", "", "2026-10-18T20:00:00Z", None, "PT1M", []),
        ("v4", "Outra | Jo 3 | Ana", "Data 11/10/2026", "2026-10-18T20:00:00Z", None, "PT1H", []),
    ]
    provenance, meta, media = talks.load_videos(videos(spark, rows), aliases, NOW)
    got = {r.preaching_date: r for r in meta.collect()}
    assert provenance.count() == 4 and set(got) == {"2026-10-18", "2026-10-11"} and media.count() == 2
    one = got["2026-10-18"]
    assert (one.source_item_id, one.title, one.preacher_name, one.text_reference, one.serie) == ("v1", "Fé", "Ana Souza", "Romanos 1", "Graça")
    only = talks.load_videos(videos(spark, rows), aliases, NOW, date="2026-10-11")
    assert only[0].count() == 4 and [r.source_item_id for r in only[1].collect()] == ["v4"]
    with pytest.raises(ValueError):
        talks.load_videos(videos(spark, rows), aliases, NOW, date="11/10/2026")


def wxr(path, items):
    fields = lambda i: "".join(f"<{k_}>{v}</{k_}>" for k_, v in i.items() if k_ != "category") + "".join(f'<category domain="{d}">{v}</category>' for d, v in i.get("category", []))
    body = "".join(f"<item>{fields(i)}</item>" for i in items)
    path.write_text(f'<?xml version="1.0"?><rss xmlns:wp="w" xmlns:content="c"><channel>{body}</channel></rss>')


def post(post_id, title, link, content, date="2020-02-05 10:00:00", status="publish", kind="page", parent="0", name="", **more):
    return {"title": title, "link": link, "content:encoded": f"<![CDATA[{content}]]>", "wp:post_id": post_id, "wp:post_date": date, "wp:post_name": name, "wp:status": status, "wp:post_parent": parent, "wp:post_type": kind} | more


def test_load_posts(spark, tmp_path):
    wxr(
        tmp_path / "export.xml",
        [
            post("1", "Graça - I Coríntios 13:1 a 3", "https://example.org/1", '<a href="https://example.org/Ana_05_02_20.mp3">x</a> por Beto', category=[("category", "Mensagens"), ("post_tag", "Série: Amor")]),
            post("2", "Rascunho", "https://example.org/2", "x", status="draft", category=[("category", "Mensagens")]),
            post("3", "Modelo", "https://example.org/3", "Nome Sobrenome", category=[("category", "Mensagens")]),
        ],
    )
    items = readers.read_wxr(spark, readers.latest_export(spark, str(tmp_path), "*.xml"))
    books = spark.createDataFrame([(i, b, b.title()) for i, b in enumerate(CANON)], "position int, folded string, book string")
    aliases = spark.createDataFrame([("ana", "Ana Souza")], "alias string, name string")
    _, meta, media = talks.load_posts(items, aliases, books, NOW, "2030-01-01", "Mensagens")
    (one,) = meta.collect()
    assert (one.preaching_date, one.title, one.preacher_name, one.text_reference, one.serie) == ("2020-02-05", "Graça", "Ana Souza", "1 Corintios 13:1-3", "Amor")
    assert [r.mime_type for r in media.collect()] == ["audio/mpeg"]
    with pytest.raises(FileNotFoundError):
        readers.latest_export(spark, str(tmp_path), "*.zip")


def test_discover_studies(spark, tmp_path):
    link = lambda n: f'<a href="https://example.org/{n}">{n}</a>'
    wxr(
        tmp_path / "pages.xml",
        [
            post("10", "CTB", "https://example.org/ctb", link("s1"), name="ctb"),
            post("20", "Materiais", "https://example.org/materiais", link("w1") + link("w2") + '<a href="/uploads/2015/PFD_3.pdf">PFD três</a>', name="weekly"),
            post("11", "Estudo CTB: Fé [Ana]", "https://example.org/s1", 'em 05/02/2020 <a href="x.pdf"> A </a><a href="https://www.example.org/s1">eu</a><img src="i.png"/> ver https://youtu.be/abc e https://example.org/x.pdf', parent="10", name="s1"),
            post("21", "Semana", "https://example.org/w1", "2014-11-02", parent="20", name="w1"),
            post("22", "Fora", "https://example.org/w2", "x", parent="10", name="w2"),
            post("23", "Rascunho", "https://example.org/w3", "x", parent="20", name="w3", status="draft"),
        ],
    )
    found, resources = studies.discover_studies(readers.read_wxr_pages(spark, str(tmp_path / "pages.xml")), {"ctb": "ctb", "weekly": "weekly"}, "weekly")
    got = {r.study_key: r for r in found.collect()}
    assert set(got) == {"wordpress:11", "wordpress:21", "wordpress:pfd:3"}
    assert (got["wordpress:11"].title, got["wordpress:11"].study_date, got["wordpress:21"].study_date, got["wordpress:pfd:3"].study_date) == ("Fé", "2020-02-05", "2014-11-02", "2015")
    kinds = sorted((r.resource_type, r.canonical_url) for r in resources.where("study_key = 'wordpress:11'").collect())
    assert kinds == [("pdf", "https://example.org/x.pdf"), ("youtube", "https://youtube.com/watch?v=abc")]


def test_study_payload_and_merge(spark, tmp_path):
    payload = {"schema_version": 2, "captured_at": "x", "complete_snapshot": True, "playlists": [{"playlist_id": "p", "title": "Estudo: Fé", "published_at": "2026-08-01T00:00:00Z", "url": "https://youtube.com/playlist?list=p", "study_type": "ctb", "videos": [{"video_id": "a", "title": "A", "description_date": "2026-07-20", "url": "https://youtu.be/a", "position": 1}, {"video_id": "a", "title": "A", "url": "https://youtu.be/a", "position": 2}]}]}
    (tmp_path / "p.json").write_text(json.dumps(payload))
    own, res = studies.load_study_payload(readers.read_study_payload(spark, str(tmp_path / "p.json")))
    (one,) = own.collect()
    assert (one.title, one.study_date, one.study_type) == ("Fé", "2026-07-20", "ctb") and res.count() == 2
    site = spark.createDataFrame([("wordpress:1", "1", "weekly", "Fé", "2007-03-04", "https://example.org/fe")], own.schema)
    site_res = spark.createDataFrame([("wordpress:1", "youtube", "A", "https://youtu.be/a", 1, "https://youtube.com/watch?v=a", "r")], res.schema)
    merged, resources, origins = studies.merge_studies((site, site_res), (own, res), NOW)
    (gold,) = merged.collect()
    assert (gold.study_date, gold.source_system, gold.resource_count, gold.study_type) == ("2007-03-04", "wordpress,youtube", 2, "ctb")
    assert origins.count() == 2 and resources.where("sources = 'wordpress,youtube'").count() == 1
    (tmp_path / "old.json").write_text(json.dumps(payload | {"schema_version": 1}))
    with pytest.raises(Exception, match="schema_version 1"):
        readers.read_study_payload(spark, str(tmp_path / "old.json")).collect()


def test_upsert_policies(spark):
    old = spark.createDataFrame([(1, "a", "s", 1.0), (2, "b", " ", 2.0)], "k int, t string, s string, d double")
    new = spark.createDataFrame([(1, "", " ", None), (3, "c", "x", 3.0)], "k int, t string, s string, d double")
    got = {r.k: tuple(r)[1:] for r in k.upsert(old, new, ["k"], {"t": k.Policy.COALESCE_NONEMPTY, "s": k.Policy.COALESCE_TRIMMED, "d": k.Policy.COALESCE}).collect()}
    assert got == {1: ("a", "s", 1.0), 2: ("b", " ", 2.0), 3: ("c", "x", 3.0)}
    table = k.Table(spark, fresh_path(spark, "t"), "k int, t string, s string, d double")
    assert table.read().count() == 0
    for _ in range(2):
        table.upsert(new, ["k"])
    assert table.read().count() == 2


def test_snapshot_and_ledger(spark):
    root = fresh_path(spark, "snap")
    issues = spark.createDataFrame([("r", "e")], "metric_key string, entity_id string")
    k.write_snapshot(spark, root, "run1", aggs.metric_rows(issues, [("r", True), ("q", False)], issues), issues, NOW)
    k.open_run(spark, f"{root}/runs", "run2", "quality", "", NOW)
    assert {(r.run_id, r.status) for r in k.runs(spark, f"{root}/runs").collect()} == {("run1", "success"), ("run2", "running")}
    path = fresh_path(spark, "csv")
    bad = spark.createDataFrame([("2026-01-01", "=1+1", "-x", "w", "m", "e", "@d", "+l")], ", ".join(f"{c} string" for c in k.CSV_COLUMNS))
    k.export_csv(bad, path)
    row = spark.read.option("header", True).csv(path).first()
    assert row.title == "'=1+1" and row.preacher_name == "'-x" and row.detail == "'@d" and row.link == "'+l"
    good, failed = k.split_errors(spark.createDataFrame([(1, None), (2, "timeout")], "id int, error string"))
    assert good.count() == 1 and k.raise_on_errors(failed, "id", ignore=True) == 1
    with pytest.raises(RuntimeError, match="1 rows"):
        k.raise_on_errors(failed, "id", ignore=False)


def test_quality_snapshot(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "gold": frame([("2026-09-27", "2026-09-27", "T", "Ana", "S", "Rm 1", "https://youtube.com/watch?v=x", "x.example/y", 60.0)], "canonical_sermon_id string, preaching_date string, title string, preacher_name string, serie string, text_reference string, youtube_link string, wordpress_link string, duration_seconds double"),
        "metadata": frame([("2026-09-27", "youtube", "v", "T", "Ana"), ("2026-10-01", "wordpress", "w", "U", "")], "canonical_sermon_id string, source_system string, source_item_id string, title string, preacher_name string"),
        "media": frame([("2026-09-27", "audio", "/a.mp3", 3000.0), ("zzz", "audio", "/z.mp3", None)], "canonical_sermon_id string, asset_type string, local_path string, duration_seconds double"),
        "files": frame([("/a.mp3", 10)], "path string, length long"),
        "texts": frame([("2026-09-27", "2026-10-01", 1, "palavra " * 120)], "canonical_sermon_id string, created_at string, transcript_version int, transcript_text string"),
        "exceptions": frame([("2026-10-04", "chuva")], "preaching_date string, reason string"),
        "runs": frame([("r", "failed", NOW)], "run_id string, status string, calculated_at timestamp"),
        "link_status": frame([("https://youtube.com/watch?v=x", 429, "")], "url string, code int, error string"),
    }
    issues, metrics = quality.quality_snapshot(tables, dt.date(2026, 9, 27), NOW, quality.Limits(grace_days=10))
    got = {r.metric_key: r.value for r in metrics.collect()}
    want = dict.fromkeys(dict(quality.RULES), 0) | {"total_sermons": 1, "youtube_link": 1, "wordpress_link": 1, "invalid_link": 1, "silver_missing_gold": 1, "orphan_media": 1, "missing_sundays": 1, "justified_missing_sundays": 1, "failed_pipeline_runs_7d": 1, "stale_pipeline": 1}
    assert got == want
    assert issues.select("issue_id").distinct().count() == issues.count()


def test_enrichment_and_detail(spark):
    gold = spark.createDataFrame([("r1", "s", "audio", "u", "A [0123456789ab]", 1, "x", 1.0, 1), ("r2", "s", "youtube", "v", "B", 2, None, None, 0), ("r3", "s", "pdf", "w", "C", 3, None, None, 0)], "resource_id string, study_id string, resource_type string, canonical_url string, label string, position int, download_link string, duration_seconds double, transcript_available int")
    assets = spark.createDataFrame([("a1", "r1", "s", "/d/a.mp3", 2640.0), ("a2", "r2", "s", "/d/b.mp3", 1.0)], "asset_id string, resource_id string, study_id string, local_path string, duration_seconds double")
    texts = spark.createDataFrame([("a1",)], "asset_id string")
    out = {r.resource_id: r for r in studies.publish_enrichment(gold, assets, texts).collect()}
    assert (out["r1"].download_link, out["r1"].transcript_available, out["r2"].download_link, out["r2"].transcript_available) == ("/media/a.mp3", 1, None, 0)
    study = spark.createDataFrame([("s", "T")], "study_id string, title string")
    res = studies.publish_enrichment(gold, assets, texts).withColumn("mime_type", F.lit(""))
    (detail,) = serving.study_detail(study, res, "s").collect()
    assert [g.grp for g in detail.groups] == ["audio", "documents", "youtube"]
    assert (detail.groups[0]["items"][0].label, detail.groups[0]["items"][0].duration) == ("A", "44 min")


def batch(visitor, events, **more):
    blank = dict.fromkeys(("content_type", "content_id", "resource_id", "page_path", "position_seconds", "duration_seconds", "listened_seconds", "playback_rate", "referrer"))
    return {"visitor_id": visitor, "session_id": "s", "content_length": 10, "user_agent": "Mozilla", "origin": "", "host": "example.org", "events": [blank | e for e in events]} | more


def test_event_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    play = {"event_id": "e1", "event_type": "audio_play", "content_type": "sermon", "content_id": "1", "listened_seconds": "99", "playback_rate": "9", "page_path": "//x"}
    lines = [
        batch("v1", [play, {"event_id": "e2", "event_type": "page_view", "page_path": "/a"}, {"event_id": "e3", "event_type": "audio_play"}, {"event_type": "unknown"}]),
        batch("v1", [play]),
        batch("v2", [{"event_id": "e9", "event_type": "page_view"}], user_agent="SomeBot"),
        batch("v3", [{"event_id": f"n{i}", "event_type": "page_view"} for i in range(60)]),
    ]
    (folder / "a.json").write_text("\n".join(map(json.dumps, lines)))
    root = fresh_path(spark, "events")
    events, visitors = stream.event_tables(spark, root)
    stream.ingest_events(readers.event_batches(spark, str(folder)), events, visitors, f"{root}/c")
    got = {r.event_id: r for r in events.read().collect()}
    assert len(got) == 52 and {"e1", "e2"} <= set(got) and "e9" not in got
    assert got["e1"].listened_seconds == 60 and got["e1"].playback_rate == 4 and got["e1"].page_path == ""
    assert got["e1"].visitor_id_hash != "v1" and visitors.read().count() == 2
    (folder / "b.json").write_text(json.dumps(lines[1]))
    stream.ingest_events(readers.event_batches(spark, str(folder)), events, visitors, f"{root}/c")
    assert events.read().count() == 52
    # another stream over the same batches: known ids are not stored again, first sights stay
    before = {r.visitor_id_hash: r.first_seen_at for r in stream.known_visitors(visitors).collect()}
    stream.ingest_events(readers.event_batches(spark, str(folder)), events, visitors, f"{root}/other")
    assert events.read().count() == 52
    assert {r.visitor_id_hash: r.first_seen_at for r in stream.known_visitors(visitors).collect()} == before


def test_repeated_and_old_batches(spark):
    events, visitors = stream.event_tables(spark, fresh_path(spark, "events"))
    now = dt.datetime(2024, 3, 10, 12)

    def at(ident, days, visitor="v"):
        return (ident, now - dt.timedelta(days=days), visitor)

    def batch(*rows):
        short = spark.createDataFrame(list(rows), "event_id string, occurred_at timestamp, visitor_id_hash string")
        return short.select(*[c if c in short.columns else F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in stream.EVENTS.split(", "))])

    then = stream.store_batch(events, visitors, 5, "w", now - dt.timedelta(days=4))
    write = stream.store_batch(events, visitors, 5, "w", now)
    then(batch(at("a", 8), at("b", 5.4), at("b", 5.4), at("c", 4, "u")), 0)
    for _ in range(2):  # the second run of a batch replaces the first
        write(batch(at("c", 1), at("d", 1), at("e", 9)), 1)
    assert sorted(r.event_id for r in events.read(now - dt.timedelta(days=5)).collect()) == ["c", "d"]
    assert sorted(r.event_id for r in events.read().collect()) == ["b", "c", "d"]  # b is on the horizon's day
    seen = {r.visitor_id_hash: (r.first_seen_at, r.last_seen_at) for r in stream.known_visitors(visitors).collect()}
    assert seen["v"][1] == now - dt.timedelta(days=1) and seen["u"] == (now - dt.timedelta(days=4),) * 2
    write(batch(), 2)
    assert events.read().count() == 3


def test_picks_do_not_depend_on_order(spark):
    rows = [(i % 7, i, f"v{i % 3}" if i % 2 else "", i % 5) for i in range(200)]
    a = spark.createDataFrame(rows, "g int, i int, t string, p int").repartition(5)
    b = spark.createDataFrame(rows[::-1], "g int, i int, t string, p int").repartition(2)
    for f in (lambda d: pick.survivorship(d, "g", ["t"], [F.col("p"), F.col("i")]), lambda d: pick.latest(d, ["g"], ["p", "i"])):
        assert sorted(map(tuple, f(a).collect())) == sorted(map(tuple, f(b).collect()))


def test_scopes_and_required_values(spark):
    df = spark.createDataFrame([("2026-01-01",), ("2026",), ("2025-12-01",)], "d string")
    assert filters.date_scope(df, "d", 30, exact="2026-01-01").count() == 1
    assert filters.date_scope(df, "d").count() == 3
    assert [r.d for r in filters.date_scope(df, "d", 10, today=dt.date(2026, 1, 5)).collect()] == ["2026-01-01", "2026"]
    with pytest.raises(ValueError):
        filters.date_scope(df, "d", exact="01/01/2026")
    with pytest.raises(ValueError):
        filters.date_scope(df, "d", 0, strict=True)
    with pytest.raises(ValueError):
        aggs.count_required(df, "d", ["2027"])
    with pytest.raises(ValueError):
        joins.require_values(df, "d", ["2027"])
    with pytest.raises(LookupError):
        filters.target(df, "2027", column="d")


def test_descendants_with_a_cycle(spark):
    tree = spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "b"), ("d", "x")], "id string, parent string")
    assert {r.id for r in joins.descendants(tree, "id", "parent", "a", depth=10).collect()} == {"a", "b", "c"}


def test_alias_dimension(spark, tmp_path):
    (tmp_path / "p.yaml").write_text('# names\npreachers:\n  João: "João da Silva"\n  ana: Ana\n')
    assert {(r.alias, r.name) for r in readers.load_alias_dim(spark, str(tmp_path / "p.yaml")).collect()} == {("joao", "João da Silva"), ("ana", "Ana")}


def test_landed_pages(spark):
    pages = spark.createDataFrame([("p", 1, [("a",), ("",), ("b",)]), ("p", 2, [("c",)])], "playlist_id string, page int, items array<struct<video_id:string>>")
    assert [(r.video_id, r.position) for r in readers.memberships(pages).orderBy("position").collect()] == [("a", 1), ("b", 2), ("c", 3)]
    listed = spark.createDataFrame([([("p1", "Estudo B"), ("p2", "Culto"), ("p3", "Estudo Á")],)], "items array<struct<playlist_id:string,title:string>>")
    assert [r.playlist_id for r in readers.flatten_pages(listed, "playlists").collect()] == ["p3", "p1"]
