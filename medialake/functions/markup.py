"""Links of HTML pages in document order.

Well-formed pages are read by expressions. Pages that these could misread (open
or nested anchors, markers inside quotes or scripts, addresses in the text) go
through an event-driven parser with a stack of open elements, in Arrow batches;
other pages send nothing to Python.
"""

from __future__ import annotations

from html import unescape as unescape_entities
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from medialake.functions.text import text, unescape

#: Kinds of elements that lead somewhere, and the attribute that says where (fixed values).
TARGETS = {"a": "href", "audio": "src", "embed": "src", "iframe": "src", "img": "src", "object": "data", "source": "src", "video": "src"}
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an element which is open on top.
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDED_BY = {"a": {"a", "table", "td", "th", "fieldset"}, "p": _BLOCKS, "li": {"li"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
#: An end tag passes over open elements as strong as its own at most.
STRENGTH = {"div": 1, "td": 2, "th": 2, "tr": 3, "thead": 4, "tbody": 4, "tfoot": 4, "table": 5, "head": 6, "body": 6, "html": 7}

_FIELDS = ("tag", "target", "label", "title", "alt")
FOUND = ArrayType(StructType([StructField(c, StringType()) for c in _FIELDS]))
WALKED = StructType([StructField("found", FOUND), StructField("words", StringType())])


class _Walk(HTMLParser):
    """Elements with targets in order of their start tags, and all text; a label is the text while its element is open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.words: list[str] = []
        self.found: list[dict] = []
        self.open: list[tuple[str, dict | None, int]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.open and tag in ENDED_BY.get(self.open[-1][0], ()):
            self._end()
        given: dict[str, str] = {}
        for name, value in attrs:
            given.setdefault(name, value or "")
        entry = None
        if TARGETS.get(tag) in given:
            entry = {"tag": tag, "target": given[TARGETS[tag]], "label": "", "title": given.get("title", ""), "alt": given.get("alt", "")}
            self.found.append(entry)
        if tag not in VOID:
            self.open.append((tag, entry, len(self.words)))

    def handle_endtag(self, tag: str) -> None:
        strength = STRENGTH.get(tag, 0)
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                while len(self.open) > at:
                    self._end()
                return
            if STRENGTH.get(self.open[at][0], 0) > strength:
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML

    def handle_data(self, data: str) -> None:
        self.words.append(data)

    def _end(self) -> None:
        _, entry, start = self.open.pop()
        if entry is not None:
            entry["label"] = "".join(self.words[start:])


def walk(html: str) -> dict:
    """``found``, and as ``words`` the text if it may hold addresses; what is still open at a page's end is closed there."""
    page = _Walk()
    page.feed(html)
    page.close()
    while page.open:
        page._end()
    words = unescape_entities("".join(page.words))
    return {"found": page.found, "words": words if "//" in words else None}


#: Pages that a task holds taken apart at once; what they gave lies in Arrow arrays.
SLICE = 64


@F.arrow_udf(WALKED)
def _walked(pages: pa.Array) -> pa.Array:
    fields = pa.struct([(c, pa.string()) for c in _FIELDS])
    shape = pa.struct([("found", pa.list_(fields)), ("words", pa.string())])
    done = [pa.array([None if p is None else walk(p) for p in pages.slice(at, SLICE).to_pylist()], shape) for at in range(0, len(pages), SLICE)]
    return pa.concat_arrays(done) if done else pa.array([], shape)


_TAG = r"""</?[A-Za-z][^\s<>"'/]*+(?:[^<>"']*+(?:"[^"<>]*+"|'[^'<>]*+'))*+[^<>"']*+>"""
_LINKING = r"(?is)<a\b[^>]*+>.*?</a\s*>|<(?:embed|img|source)\b[^>]*+>"


# An anchor with text, images, breaks and inline elements that hold text alone; a title that holds text alone.
_CLOSED = r"""(?i)<a\b[^<>]*+>[^<]*+(?:(?:<(?:img|br)\b[^<>]*+>|<(b|i|u|em|strong|span|small|sup|sub|font|code|q)\b[^<>]*+>[^<]*+</\1\s*+>)[^<]*+)*+</a\s*+>|<title\b[^<>]*+>[^<]*+</title\s*+>"""


def _marks(c: Column, pattern: str) -> Column:
    return F.regexp_replace(F.lower(F.array_join(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), "")), r"\s", "")


def _bare(html: Column) -> Column:
    """A page without comments and the bodies of scripts and styles."""
    return F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), r"(?is)<(script|style)\b[^<>]*+>.*?</\1\s*>", "")


def is_plain(html: Column) -> Column:
    """Whether expressions read a page as the parser does: closed comments and scripts, anchors complete in
    themselves, no markers in quotes, the entities that :func:`unescape` knows, and no address but in tags."""
    bare, visible = _bare(html), F.regexp_replace(F.regexp_replace(_bare(html), _TAG, ""), r"<![A-Za-z][^<>]*+>", "")
    bodies = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<(?:script|style)\b[^<>]*+>(.*?)</(?:script|style)\s*>"), F.lit(1)), " ")
    return (
        _marks(html, r"(?i)<!--|-->|</?(?:script|style)\b").rlike("^(?:<!---->|<script</script|<style</style)*+$")
        & ~F.regexp_replace(bare, _CLOSED, "").rlike(r"(?i)</?(?:a|title)\b")
        & ~bare.rlike(r"(?i)</?(?:textarea|xmp|plaintext|noembed|noframes|noscript|iframe|audio|video|object|svg|math|table|fieldset)\b|&(?!(?:amp|lt|gt|quot|nbsp|#39);)[A-Za-z#]|&amp;[A-Za-z0-9#]+;|\x00|\r")
        & ~visible.contains("<")
        & ~unescape(visible).contains("//")
        & ~bodies.contains("//")
    )


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute in double, single or no quotes; null where the tag does not have it."""
    forms = F.regexp_extract_all(tag, F.lit(rf"""(?is)(?<=[\s"'/]){name}\s*=\s*("[^"]*+"|'[^']*+'|[^\s"'>]++)"""), F.lit(1))
    return F.regexp_replace(F.try_element_at(forms, F.lit(1)), r"""^["']|["']$""", "")


def _listed(html: Column) -> Column:
    """The elements of a plain page, as the parser lists them."""

    def entry(whole: Column) -> Column:
        head = F.regexp_extract(whole, r"(?s)^<[^>]*+>", 0)
        tag = F.lower(F.regexp_extract(head, r"^<(\w+)", 1))
        target = F.when(tag == "a", attribute(head, "href")).otherwise(attribute(head, "src"))
        label = F.when(tag == "a", unescape(F.regexp_replace(whole, r"(?s)<[^>]*+>", ""))).otherwise("")
        given = lambda name: F.coalesce(unescape(attribute(head, name)), F.lit(""))
        return F.struct(tag.alias("tag"), unescape_or_null(target).alias("target"), label.alias("label"), given("title").alias("title"), given("alt").alias("alt"))

    return F.filter(F.transform(F.regexp_extract_all(_bare(html), F.lit(_LINKING), F.lit(0)), entry), lambda x: x["target"].isNotNull())


def unescape_or_null(c: Column) -> Column:
    return F.when(c.isNotNull(), unescape(c))


def elements(html: Column | str) -> Column:
    """``struct<found, words>``: elements with a target in document order, and the text where it may hold addresses.

    ``found`` has tag, target, label (the element's text), title and alt. ``words``
    is null for pages without addresses in their text. A null page has no elements.
    """
    page = text(html)
    seen = _walked(F.when(~is_plain(page), page))
    return F.coalesce(seen, F.struct(_listed(page).cast(FOUND).alias("found"), F.lit(None).cast("string").alias("words")))
