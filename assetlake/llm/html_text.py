"""Main text of web pages, with the site's templates taken out.

Element subtrees are hashed and counted per host on Spark; a subtree that recurs on many pages of
its host is template, not text, and goes. What the markup itself says is no text (navigation,
forms, scripts, adverts, comments) goes on every page, so that single pages of a host come out
right too. Where a page marks its article, paragraphs within it are text however often they
recur; of other elements there, all are counted, but none goes that holds over half of the page's
text.

The project keeps no web pages: this operator is general, and takes any table of markup.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

#: A template recurs on this many different pages of its host, however many pages that has.
MIN_PAGES = 5

# HTML element names by their role, and class words of what is no text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend "
    "li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = set(
    "nav footer aside form script style noscript template iframe object svg canvas button select "
    "textarea input dialog menu head title noembed noframes audio video map".split()
)
CONTAINERS = set("div section ul ol dl table figure details center fieldset header".split())
ROLES = set(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu "
    "menubar toolbar tablist".split()
)
CLASSES = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice popup modal newsletter subscribe signup sidebar "
    "comment comments commentlist respond disqus share sharing social related breadcrumb "
    "breadcrumbs menu nav navbar navigation footer widget pagination pager skip toolbar".split()
)
#: An open element of the second kind ends where one of the first begins.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}

TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*+|[^<>]*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TOKEN = re.compile(r"[a-z0-9]+")
HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"

EXTRACTED_DDL = "page_id long, url string, text string, n_chars long, n_template long"


class Node:
    __slots__ = ("tag", "label", "dropped", "article", "main", "first", "parts")

    def __init__(self, tag, label, dropped, article, main, first):
        self.tag, self.label, self.dropped = tag, label, dropped
        self.article, self.main, self.first = article, main, first
        self.parts = []


def _attributes(text: str) -> dict[str, str]:
    return {
        m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)
    }


def _is_dropped(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if tag in ("html", "body", "main") or not attrs:
        return False
    words = set(TOKEN.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()))
    style = attrs.get("style", "").replace(" ", "").lower()
    return bool(
        words & CLASSES
        or attrs.get("role", "").lower() in ROLES
        or "hidden" in attrs
        or attrs.get("aria-hidden", "").lower() == "true"
        or "display:none" in style
    )


class Page:
    """Blocks of text of a page, and the elements that a template could consist of."""

    def __init__(self, html: str):
        self.blocks: list[str] = []
        self.kept: list[tuple[bool, bool]] = []
        self.elements: list[tuple[int, int, int, str, bool]] = []
        self.stack = [Node("", "", False, False, False, 0)]
        self.open: dict[str, int] = {}
        self.buffer: list[str] = []
        self._parse(html)

    def _parse(self, html: str) -> None:
        at = 0
        while m := TAG.search(html, at):
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    self._text(m[0][9:].removesuffix("]]>"))
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, m[3])
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                at = close.start() if close else len(html)
        if at < len(html):
            self._text(html[at:])
        while len(self.stack) > 1:
            self._pop()
        self._flush()

    def _text(self, text: str) -> None:
        if not self.stack[-1].dropped:
            self.buffer.append(text)

    def _flush(self) -> None:
        if self.buffer:
            block = " ".join(unescape("".join(self.buffer)).split())
            self.buffer = []
            if block:
                top = self.stack[-1]
                self.blocks.append(block)
                self.kept.append((top.article, top.main))
                top.parts.append(block)

    def _pop(self) -> None:
        node = self.stack[-1]
        if node.tag in BLOCKS:
            self._flush()
        self.stack.pop()
        self.open[node.tag] -= 1
        if node.tag in BLOCKS and not node.dropped:
            shape = "\0".join([node.tag, node.label, *node.parts])
            name = xxhash.xxh3_64_intdigest(shape.encode("utf-8", "replace"))
            self.stack[-1].parts.append(f"\1{name}")
            if len(self.blocks) > node.first:
                self.elements.append((name, node.first, len(self.blocks), node.tag, node.article))

    def _close_to(self, tags: set[str], within: set[str]) -> None:
        """Close the innermost open element of `tags`, unless one of `within` is closer."""
        if not any(self.open.get(t) for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                while len(self.stack) > i:
                    self._pop()
                return
            if self.stack[i].tag in within:
                return

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._close_to({"p"}, BLOCKS - {"p"})
            self._flush()
        elif tag == "br":
            self._text(" ")
        if tag in ENDS:
            self._close_to(*ENDS[tag])
        if tag in VOID or (attributes.endswith("/") and tag not in BLOCKS):
            return
        top = self.stack[-1]
        dropped, label = top.dropped, ""
        if not dropped:
            attrs = _attributes(attributes) if attributes.strip() else {}
            label = attrs.get("class", "")
            dropped = _is_dropped(tag, attrs, top.article)
            if dropped and tag not in BLOCKS:
                self._text(" ")
        # within an article's header only headings are text
        if not dropped and top.tag == "header" and top.article:
            dropped = tag not in ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup")
        self.stack.append(
            Node(
                tag,
                label,
                dropped,
                top.article or (tag == "article" and not dropped),
                top.main or (tag == "main" and not dropped),
                len(self.blocks),
            )
        )
        self.open[tag] = self.open.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        if tag == "p" and not self.open.get("p"):
            self._flush()
        elif self.open.get(tag):
            self._close_to({tag}, set() if tag in BLOCKS else BLOCKS)

    def result(self) -> tuple[list[str], list[tuple[int, int, int, bool]]]:
        """Blocks of the main part, and the elements that may be template.

        (hash, first block, end, whether the page keeps it even if it is template)
        """
        kind = 0 if any(a for a, _ in self.kept) else 1 if any(m for _, m in self.kept) else None
        main = [kind is None or k[kind] for k in self.kept]
        place = [0]
        for m in main:
            place.append(place[-1] + m)
        blocks = [b for b, m in zip(self.blocks, main) if m]
        size, total = [0], 0
        for b in blocks:
            total += len(b)
            size.append(total)
        elements = []
        for name, first, last, tag, article in self.elements:
            if tag in ("html", "body", "main", "article") or (article and tag not in CONTAINERS):
                continue
            a, b = place[first], place[last]
            # elements outside the main part have no blocks in it, but count
            signed = name - (1 << 64) if name >> 63 else name
            elements.append((signed, a, b, article and 2 * (size[b] - size[a]) > total))
        return blocks, elements


def _elements(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct elements of each page, which is known by a hash of its blocks."""
    for table in tables:
        out = []
        for host, key, html in zip(*(table.column(c).to_pylist() for c in table.schema.names)):
            blocks, elements = Page(html).result()
            page = xxhash.xxh3_64_intdigest("\n".join(blocks).encode("utf-8", "replace"))
            page -= (page >> 63) << 64
            out += [(host, key, page, h) for h in sorted({e[0] for e in elements})]
        yield pa.record_batch(
            {
                "host": pa.array([o[0] for o in out], pa.string()),
                "page_key": pa.array([o[1] for o in out], pa.int64()),
                "page": pa.array([o[2] for o in out], pa.int64()),
                "hash": pa.array([o[3] for o in out], pa.int64()),
            }
        )


def _extracted(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in tables:
        texts, removed = [], []
        for html, gone in zip(table.column("html").to_pylist(), table.column("gone").to_pylist()):
            blocks, elements = Page(html).result()
            drop = [False] * len(blocks)
            for name, first, last, stays in elements if gone else ():
                if name in gone and not stays:
                    drop[first:last] = [True] * (last - first)
            texts.append("\n".join(b for b, d in zip(blocks, drop) if not d))
            removed.append(sum(drop))
        yield pa.record_batch(
            {
                "page_id": table.column("page_id"),
                "url": table.column("url"),
                "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "n_template": pa.array(removed, pa.int64()),
            }
        )


def extract_text(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Main text of every page.

    pages: `page_id`, `url`, `html`; other columns are ignored. A subtree is template if it
    stands on `min_pages` different pages of its host or more. Pages of a host whose main blocks
    are all the same count as one: a page is not template because copies of it exist.

    Returns one row per input row: `page_id`, `url`, `text` (blocks in page order, one line each,
    white space as single blanks, character references decoded), `n_chars` (code points) and
    `n_template` (blocks removed as template).

    Null or empty html: empty text. Null url, or one without a host: its pages form one host.
    Repeated rows come out alike and count as one page. Markup that is not closed or nested
    wrongly is closed as browsers do for blocks. Empty table: no rows.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumns(
        {
            "host": F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")),
            "page_key": F.xxhash64("page_id", "url", "html"),
        }
    )
    elements = rows.select("host", "page_key", "html").mapInArrow(
        _elements, "host string, page_key long, page long, hash long"
    )
    templates = (
        elements.groupBy("host", "hash")
        .agg(F.count_distinct("page").alias("n"))
        .filter(F.col("n") >= min_pages)
        .select("host", "hash")
    )
    # rows of one key are alike; a page has few elements
    gone = (
        elements.join(templates, ["host", "hash"])
        .groupBy("page_key")
        .agg(F.collect_set("hash").alias("gone"))
    )
    return (
        rows.join(gone, "page_key", "left")
        .select("page_id", "url", "html", "gone")
        .mapInArrow(_extracted, EXTRACTED_DDL)
    )
