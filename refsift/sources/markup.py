"""Structure of full-text XML and of article pages, by a parser with a stack of open elements, in Arrow functions.

A row is parsed by itself, in one pass; null where there is no usable content."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Least lengths of a usable content.
LEAST_XML, LEAST_PAGE = 500, 200
# What is dropped from a page, and the class of a division that holds an article.
DROPPED = ("script", "style", "nav", "footer", "header")
ARTICLE_CLASS = re.compile(r"article|content|paper")
#: Elements that end a line.
LINES = frozenset("address article aside blockquote br dd div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr li main ol p pre section table td th tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def sections_of(xml: str | None) -> str | None:
    """Sections in document order, nested ones too: the title as `###`, then the section's own paragraphs, each with all
    the text inside it. A section without paragraphs of its own is left out; XML that isn't well-formed has none."""
    try:
        root = ElementTree.fromstring(xml or "")  # noqa: S314  no external entities are read
    except ElementTree.ParseError:
        return None
    out = []
    for section in root.iter("sec"):
        paragraphs = [text for p in section.findall("p") if (text := "".join(p.itertext()).strip())]
        title = section.find("title")
        if paragraphs:
            head = [f"### {title.text}"] if title is not None and title.text else []
            out.append("\n\n".join(head + paragraphs))
    return "\n\n".join(out) or None


class _Page(HTMLParser):
    """Text of a page with the places where the first container of each kind begins and ends."""

    KINDS = ("article", "div", "main", "body")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.open: list[str] = []
        self.silent = 0
        self.begun: dict[str, tuple[int, int]] = {}  # kind -> depth, first part
        self.found: dict[str, tuple[int, int]] = {}  # kind -> first part, end

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in LINES:
            self.parts.append("\n")
        if tag in VOID:
            return
        wanted = tag in self.KINDS and (tag != "div" or any(ARTICLE_CLASS.search(c) for k, v in attrs if k == "class" for c in (v or "").split()))
        if wanted and not self.silent and tag not in self.begun and tag not in self.found:
            self.begun[tag] = len(self.open), len(self.parts)
        self.open.append(tag)
        self.silent += tag in DROPPED

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in LINES:
            self.parts.append("\n")

    def _close_upto(self, depth: int) -> None:
        while len(self.open) > depth:
            tag = self.open.pop()
            self.silent -= tag in DROPPED
            if self.begun.get(tag, (-1, 0))[0] == len(self.open):
                self.found[tag] = self.begun.pop(tag)[1], len(self.parts)

    def handle_endtag(self, tag: str) -> None:
        depth = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i] == tag), None)
        if depth is not None:
            self._close_upto(depth)
        if tag in LINES:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)

    def text(self) -> str:
        self.close()
        self._close_upto(0)
        first, end = next((self.found[k] for k in self.KINDS if k in self.found), (0, len(self.parts)))
        lines = re.sub(r"[ \t]+", " ", "".join(self.parts[first:end]))
        return re.sub(r"\s*\n\s*\n\s*", "\n\n", re.sub(r" ?\n ?", "\n", lines)).strip()


def article_of(html: str | None) -> str | None:
    """Text of the first `article`, else of the first division of an article's class, else of `main`, else of the body,
    without scripts, styles and menus; a container ends where its own end tag is, whatever it nests. Null below
    LEAST_PAGE signs."""
    page = _Page()
    page.feed(html or "")
    text = page.text()
    return text if len(text) >= LEAST_PAGE else None


@F.pandas_udf(StringType())
def _sections(xml: pd.Series) -> pd.Series:
    return xml.map(sections_of)


@F.pandas_udf(StringType())
def _article(html: pd.Series) -> pd.Series:
    return html.map(article_of)


def xml_sections(xml: Column) -> Column:
    return _sections(xml)


def xml_flat(xml: Column) -> Column:
    """All text of the XML with white space as single spaces; null up to LEAST_XML signs."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(xml, r"<[^>]+>", " "), r"\s+", " "), r"^\s+|\s+$", "")
    return F.when(F.length(plain) > LEAST_XML, plain)


def article_text(html: Column) -> Column:
    return _article(html)
