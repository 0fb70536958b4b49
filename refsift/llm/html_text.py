"""Main text of web pages: differencing against the page of the nearest URL.

A page is cut into lines (the text between block-level tags; white space inside one becomes one space). What is no text
(scripts, styles, form controls, embedded objects, markup comments) makes no line. The page is paired with the page of
its host whose path is nearest (the neighbour in path order with the longer common beginning, of equals the one before),
and then with the neighbour on its other side. Both pages' lines are aligned by longest common subsequence, and the
shared ones are deleted.

What makes two lines equal: menus, adverts and footers have other words on every page, but the same place in the
template. So a line of page furniture is compared by its slot, the path of elements and classes that it lies in, and the
lines that follow each other in one slot (the entries of a menu) are one unit whatever their number. Furniture is what
lies in an element that by tag, role, class or id is a menu, header, footer, sidebar, notice, advert, form or comment of
readers, and, on a page that marks its article (`article` or `main`), all that lies outside of it. Every other line is
compared by its text.

Furniture that a neighbour shares goes, and so does furniture that one of the FURTHER pages before it on its host shares
(an advert that not every page has). Furniture that none of them shares stays: it is this page's own. Only a page that is
alone on its host, where there is nothing to compare it with, loses its furniture by its elements' names; n_named counts
those lines, n_shared those that differencing deleted.
Lines of a marked article stay: a passage that two articles share belongs to both. On a page without a mark, shared
lines go unless that would delete more than half of the text that is no furniture: then the two may be copies of one
article rather than pages of one template, and the other neighbour is tried. Lines that both neighbours share go
whatever their part of the text is, if both are other pages than this one: of another title (or none), and with text
that this one lacks and the other way round. Three edited copies in a row without titles can't be told from a template,
and lose what they share.

Hosts of any size are handled in ranges of path order, see `ordered`; a range is a task, of about ROWS pages.

Defined cases: null and empty html give an empty text; a null url, or one without `://`, has the empty host and path;
pages that share a url are neighbours by page_id; repeated rows are neighbours of each other, and copies; a table of one
page has no neighbours; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from html import unescape
from itertools import zip_longest
from os.path import commonprefix
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, tidy
from .ordered import dealt

ROWS = 1024
#: Earlier pages of the host, beside the two neighbours, that furniture is compared with.
FURTHER = 6
NAMES = ["page_id", "url", "text", "n_chars", "n_shared", "n_named"]

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre section select summary"
    " table tbody td template textarea tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
RAW_TAGS = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Neither they nor what they hold is text of the page.
SILENT_TAGS = frozenset("canvas head iframe noscript object option select svg template textarea title".split())
#: Page furniture, by tag, by role and by words of a class or id.
FURNITURE_TAGS = frozenset("aside footer form header menu nav".split())
FURNITURE_ROLES = frozenset("alert banner complementary contentinfo form menu menubar navigation search toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer"
    " header masthead menu nav navbar navigation newsletter notice notices pagination promo promoted replies respond sidebar signup"
    " sponsor sponsored subscribe".split()
)
ARTICLE_TAGS = frozenset(("article", "main"))
#: A tag closes an open one of its kind when these begin anew.
CLOSES_ITSELF = frozenset("p li dd dt tr td th option".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_TITLE = re.compile(r"<title\b[^>]*>([^<]*)", re.I)
_WORD = re.compile(r"[a-z0-9]+")


class Block(NamedTuple):
    text: str
    tag: str
    marked: bool  # inside article or main
    named: bool  # inside an element that is furniture by its name
    slot: str  # the elements it lies in


class Element(NamedTuple):
    tag: str
    silent: bool
    named: bool
    mark: bool
    slot: str


def _element(tag: str, attributes: str, inside: bool, above: str) -> tuple[bool, str]:
    """Whether an element is furniture by its name, and its slot. inside: of an article, whose own header holds its
    heading; above: the slot of the element that it lies in."""
    named = tag in FURNITURE_TAGS and not (inside and tag == "header")
    words: list[str] = []
    judged = not (tag in ARTICLE_TAGS and not inside or tag in ("body", "html"))
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role":
            named |= judged and value in FURNITURE_ROLES
        else:
            found = _WORD.findall(value)
            words += found
            named |= judged and not FURNITURE_WORDS.isdisjoint(found)
    return named, f"{above}/{tag}" + "".join(f".{w}" for w in sorted({w for w in words if w.isalpha()}))


def blocks(html: str | None) -> list[Block]:
    """The lines of a page, furniture included, in page order."""
    html = html or ""
    out: list[Block] = []
    stack: list[Element] = []
    silent = named = marked = 0  # open elements of each kind
    buffer: list[str] = []
    tag_of = ""

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                out.append(Block(text, tag_of, marked > 0, named > 0, stack[-1].slot if stack else ""))

    def pop() -> str:
        nonlocal silent, named, marked
        one = stack.pop()
        silent -= one.silent
        named -= one.named
        marked -= one.mark
        return one.tag

    at = 0
    while True:
        m = _TAG.search(html, at)
        part = html[at : m.start() if m else len(html)]
        if part and not silent:
            buffer.append(unescape(part) if "&" in part else part)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        attributes = m[3] or m[6] or ""
        if m[1] or m[4]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
            if k is not None:
                if any(x.tag in BLOCK_TAGS for x in stack[k:]):
                    flush()
                while pop() != tag:
                    pass
            continue
        if tag in VOID_TAGS:
            if tag == "br" and not silent:
                buffer.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            if tag in BLOCK_TAGS:
                flush()
            continue
        if tag in BLOCK_TAGS:
            flush()
            if tag in ARTICLE_TAGS and (silent or named) and not marked:  # an element that was never closed
                while silent or named:
                    pop()
            elif tag == "body":
                while silent or named:
                    pop()
            if tag in CLOSES_ITSELF and stack:
                k = len(stack) - 1
                while k >= 0 and stack[k].tag not in BLOCK_TAGS:
                    k -= 1
                if k >= 0 and stack[k].tag == tag:
                    while len(stack) > k:
                        pop()
        if attributes.endswith("/"):
            continue
        is_named, slot = _element(tag, attributes, marked > 0, stack[-1].slot if stack else "")
        hush = tag in SILENT_TAGS
        if tag not in BLOCK_TAGS:  # furniture within a line is no line of its own, and no part of a slot
            hush, is_named, slot = hush or is_named, False, stack[-1].slot if stack else ""
        mark = tag in ARTICLE_TAGS and not (is_named or named or hush or silent)
        stack.append(Element(tag, hush, is_named, mark, slot))
        silent += hush
        named += is_named
        marked += mark
        tag_of = tag if tag in BLOCK_TAGS else tag_of
    flush()
    return out


def shared(mine: list[str], other: list[str]) -> set[int]:
    """Places in mine of one longest common subsequence (Hunt and Szymanski)."""
    head, most = 0, min(len(mine), len(other))  # what both begin and end with is in some longest one
    while head < most and mine[head] == other[head]:
        head += 1
    tail = 0
    while tail < most - head and mine[-1 - tail] == other[-1 - tail]:
        tail += 1
    where: dict[str, list[int]] = {}
    for j in range(len(other) - 1 - tail, head - 1, -1):
        where.setdefault(other[j], []).append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    for i in range(head, len(mine) - tail):
        for j in where.get(mine[i], ()):
            k = bisect_left(ends, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            elif j < ends[k]:
                ends[k], chains[k] = j, link
    out = {*range(head), *range(len(mine) - tail, len(mine))}
    link = chains[-1] if chains else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


class Unit(NamedTuple):
    key: tuple[str, str]
    furniture: bool
    lines: list[Block]


def units(page: list[Block]) -> list[Unit]:
    """What is aligned: a line of text by itself, the lines of furniture that follow each other in one slot together."""
    has_article = any(b.marked and not b.named for b in page)
    out: list[Unit] = []
    for b in page:
        if not (b.named or has_article and not b.marked):
            out.append(Unit(("text", b.text), False, [b]))
        elif out and out[-1].key == ("slot", b.slot):
            out[-1].lines.append(b)
        else:
            out.append(Unit(("slot", b.slot), True, [b]))
    return out


class Told(NamedTuple):
    lines: list[Block]
    shared: int  # lines that differencing deleted
    named: int  # lines of furniture of a page without neighbours


def differenced(own: list[Block], neighbours: list[list[Block]], copies: tuple[bool, ...] = (), further: list[list[Block]] = []) -> Told:  # noqa: B006  read only
    """The lines of the main text; neighbours: the nearest page's first; copies: which of them have the page's title;
    further: other pages of the host, which furniture alone is compared with."""
    mine, others = units(own), [units(n) for n in neighbours]
    found = [shared([u.key for u in mine], [u.key for u in other]) for other in others]
    gone = {i for g in found for i in g if mine[i].furniture}
    for other in further:
        if all(i in gone for i, u in enumerate(mine) if u.furniture):
            break
        gone |= {i for i in shared([u.key for u in mine], [u.key for u in units(other)]) if mine[i].furniture}
    if not any(b.marked and not b.named for b in own):
        prose = {i for i, u in enumerate(mine) if not u.furniture}
        size = sum(len(mine[i].lines[0].text) for i in prose)
        same = [g & prose for g in found]
        gone |= next((g for g in same if 2 * sum(len(mine[i].lines[0].text) for i in g) <= size), set())
        least = [min(len(prose), sum(not u.furniture for u in other)) for other in others]
        apart = [len(g) < n and not c for g, n, c in zip_longest(same, least, copies[: len(same)], fillvalue=False)]
        if len(same) > 1 and all(apart):
            gone |= set.intersection(*same)
    left = {i for i, u in enumerate(mine) if u.furniture and i not in gone} if not neighbours else set()
    kept = [b for i, u in enumerate(mine) if i not in gone and i not in left for b in u.lines]
    return Told(kept, *(sum(len(mine[i].lines) for i in some) for some in (gone, left)))


def main_text(own: list[Block], neighbours: list[list[Block]], copies: tuple[bool, ...] = ()) -> list[Block]:
    """The lines of the main text."""
    return differenced(own, neighbours, copies).lines


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class _Page(NamedTuple):
    range: int
    ghost: int
    host: str
    path: str
    page_id: object
    url: str | None
    title: str
    blocks: list[Block]


def _told(before: _Page | None, page: _Page, after: _Page | None, further: list[_Page]) -> Told:
    near = [x for x in (before, after) if x is not None and x.range == page.range and x.host == page.host]
    near.sort(key=lambda x: -len(commonprefix([x.path, page.path])))
    copies = tuple(bool(page.title) and x.title == page.title for x in near)
    return differenced(page.blocks, [x.blocks for x in near], copies, [x.blocks for x in further if x.range == page.range and x.host == page.host])


def title_of(html: str | None) -> str:
    m = _TITLE.search(html or "")
    return " ".join(m[1].split()) if m else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared, n_named: one row per row of pages."""
    space = Workspace(pages.sparkSession, "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    plain = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    spread, ranges = dealt(plain, F.struct("host", "path", "page_id"), ROWS, space, before=True, after=True, wrap=False)
    ranged = spread.repartitionById(ranges, "_rs_range").sortWithinPartitions("_rs_range", "_rs_ghost", "_rs_key", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: _Page | None = None
        page: _Page | None = None
        rows: list[tuple] = []
        earlier: deque[_Page] = deque(maxlen=FURTHER)  # before the page before

        def told(after: _Page | None) -> None:
            if page is not None and page.ghost == 0:
                found = _told(before, page, after, [*earlier][::-1])
                rows.append((page.page_id, page.url, "\n\n".join(b.text for b in found.lines), found.shared, found.named))

        def batch_of(ids: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            texts = pa.array(columns[2], pa.string())
            counts = [[len(t) for t in columns[2]], columns[3], columns[4]]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], ids), pa.array(columns[1], pa.string()), texts, *(pa.array(c, pa.int64()) for c in counts)], names=NAMES)

        ids = None
        for batch in batches:
            ids = batch.schema.field(2).type
            for r, g, i, url, html, host, path in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                after = _Page(r, g, host, path, i, url, title_of(html), blocks(html))
                told(after)
                if before is not None:
                    earlier.append(before)
                before, page = page, after
                if len(rows) >= 512:
                    yield batch_of(ids)
                    rows.clear()
        told(None)
        if rows:
            yield batch_of(ids)

    return ranged.select("_rs_range", "_rs_ghost", "page_id", "url", "html", "host", "path").mapInArrow(tidy(run), f"page_id {kind}, url string, text string, n_chars long, n_shared long, n_named long")
