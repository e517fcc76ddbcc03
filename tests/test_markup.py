"""Links of pages: the parser on malformed pages, and expressions against the parser on well-formed ones."""

import random

import pytest
from pyspark.sql import functions as F

from medialake.functions import markup
from medialake.plans.studies import extract_links

ADDRESS = "https://host.net/"
CASES = {
    "every kind of element in document order": (
        '<video src=v.mp4>old <b>player</b></video><a href="a">A</a><audio src="s.mp3" title=T></audio><img src=i.png alt="Alt"><iframe src=f></iframe><object data=o.pdf>doc</object><embed src=e><source src=q.ogg>',
        [("video", "v.mp4", "old player"), ("a", "a", "A"), ("audio", "s.mp3", "T"), ("img", "i.png", "Alt"), ("iframe", "f", "page"), ("object", "o.pdf", "doc"), ("embed", "e", "page"), ("source", "q.ogg", "page")],
    ),
    "an anchor within one ends the first": ('<a href=1>one <a href=2>two</a> three', [("a", "1", "one"), ("a", "2", "two")]),
    "an open anchor reaches to the end of its paragraph": ("<p><a href=1>one</p> two <a href=2>three", [("a", "1", "one"), ("a", "2", "three")]),
    "a weak end tag does not close a strong element": ("<a href=1>x<div>y</a>z</div>w", [("a", "1", "xyzw")]),
    "angle brackets in quotes": ("<a title='b > c' href=\"x?a>b\">d</a><img alt=\"<i>\" src='y'>", [("a", "x?a>b", "d"), ("img", "y", "<i>")]),
    "comments hide tags": ("<!-- <a href=1>no</a> --><a href=2>yes<!-- not this --></a><!-- open <a href=3>", [("a", "2", "yes")]),
    "scripts hide tags": ("<script>var s = '<a href=1>no</a>';</script><style>a > b{}</style><a href=2>yes</a>", [("a", "2", "yes")]),
    "names in any case, no quotes, the first of two attributes": ("<A HREF=1 href=2>x</A><IMG\nSRC='3'/>", [("a", "1", "x"), ("img", "3", "page")]),
    "data-href is not href": ('<a data-href="no" href="yes">x</a><a name="n">y</a><a data-src="no">z</a>', [("a", "yes", "x")]),
    "entities in targets and labels": ('<a href="x?a=1&amp;b=2">&lt;b&gt; &eacute;</a><a href="y&#46;pdf">z</a>', [("a", "x?a=1&b=2", "<b> é"), ("a", "y.pdf", "z")]),
    "targets that lead nowhere": ('<a href="#t">x</a><a href="mailto:a@b">y</a><a href="">z</a><a href="javascript:f()">w</a><a href>v</a><a href="ok.">u</a>', [("a", "ok", "u")]),
    "not a tag": ("1 < 2 and <3 <a href=1>x</a> < a href=2>", [("a", "1", "x")]),
    "cut off in a tag": ("<a href=1>x</a><a href=2", [("a", "1", "x")]),
}


def links(spark, pages, title="page"):
    rows = spark.createDataFrame([(k, p, ADDRESS + "dir/page", title) for k, p in enumerate(pages)], "page_id long, html string, url string, title string")
    out = {k: [] for k in range(len(pages))}
    for r in extract_links(rows, title="title").orderBy("page_id", "position").collect():
        assert r.position == len(out[r.page_id]) + 1
        out[r.page_id].append((r.element_tag, r.url.removeprefix(ADDRESS + "dir/"), r.label, r.is_raw))
    return [out[k] for k in range(len(pages))]


def test_malformed_pages(spark):
    got = links(spark, [page for page, _ in CASES.values()])
    for name, found, (_, want) in zip(CASES, got, CASES.values()):
        assert found == [(*w, False) for w in want], name


def test_addresses_in_text(spark):
    page = (
        '<a href="https://host.net/a.pdf">a</a> https://host.net/a.pdf, https://www.host.net/b.mp3. (//host.net/c.pdf) https://host.net/b.mp3 https://host.net/page'
        " <script>var u = 'https://host.net/s.pdf';</script>&#104;ttps://host.net/d.pdf <!-- https://host.net/no.pdf -->"
    )
    assert links(spark, [page])[0] == [("a", ADDRESS + "a.pdf", "a", False)[:1] + ("https://host.net/a.pdf".removeprefix(ADDRESS + "dir/"), "a", False)] + [
        ("", u, "page", True) for u in ("https://www.host.net/b.mp3", "https://host.net/c.pdf", "https://host.net/s.pdf", "https://host.net/d.pdf")
    ]


def test_odd_pages(spark):
    long = "<p>word</p>" * 20_000 + '<a href="end">x</a>' + "<b>" * 5_000
    assert links(spark, [None, "", "plain text", "<", "<a", long]) == [[], [], [], [], [], [("a", "end", "x", False)]]


def random_page(rng, trouble):
    words = ["red", "blue &amp; green", "x", "a > b", "é", "  two\n words "]
    def piece(depth=0):
        kind = rng.randrange(9 if not trouble else 13)
        text = rng.choice(words)
        if kind < 3:
            return text
        if kind == 3:
            quote = rng.choice("\"'")
            return f"<a class=c href={quote}p{rng.randrange(99)}.pdf{quote} title={quote}t{quote}>{text if rng.random() < 0.8 else ''}<b>{rng.choice(words)}</b></a>"
        if kind == 4:
            return f"<img alt='{rng.choice(['', 'pic'])}' src=i{rng.randrange(9)}.png>"
        if kind == 5:
            return f"<p>{text}<br/><i>{text}</i>"
        if kind == 6:
            return f"<!-- {text} <a href=no>no</a> -->"
        if kind == 7:
            return "<script type='x'>if (a < b) { c = '<a href=no>'; d = '</a>'; }</script>"
        if kind == 8 and depth < 3:
            return f"<div>{piece(depth + 1)}{piece(depth + 1)}</div>"
        return rng.choice(["<a href=u>", "</a>", "</div>", "<a title='>' href=q>z</a>", "<video src=v>w</video>", "&copy;", "</p>", "<td>"])

    return "".join(piece() for _ in range(rng.randrange(1, 14)))


@pytest.mark.parametrize("trouble", [False, True])
def test_expressions_read_as_the_parser(spark, sf_small, trouble):
    rng = random.Random(6)
    pages = [random_page(rng, trouble) for _ in range(400)]
    if not trouble:
        pages += [r.html for r in spark.read.parquet(f"{sf_small}/pages.parquet").select("html").collect()]
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "k long, html string").withColumn("plain", markup.is_plain(F.col("html")))
    got = rows.select("k", "plain", markup.elements("html").alias("e")).collect()
    squeezed = lambda found: [(x["tag"], x["target"], " ".join(x["label"].split()), x["title"].strip(), x["alt"].strip()) for x in found]
    for r in got:
        want = markup.walk(pages[r.k])
        assert squeezed(r.e.found) == squeezed(want["found"]), pages[r.k]
        assert r.e.words == want["words"]
    share = sum(r.plain for r in got) / len(got)
    assert share > 0.8 if not trouble else 0.05 < share < 0.9
