"""Captured web pages: text, main content, links, key fingerprint.

A page is parsed where its row lies: one map over Arrow batches, no shuffle. Of a batch, ``PAGES`` pages at a time are strings of
Python and leave before the next ones are made. Nothing is fetched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse.sources.articles import FAILED_MARKER

PAGES = 64

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_NOT_TEXT = frozenset(("script", "style", "template"))


class _Text(HTMLParser):
    """Character data of a page, or of the first element that matches a simple selector."""

    def __init__(self, selector: str | None):
        super().__init__(convert_charrefs=True)
        tag, _, css_class = (selector or "").partition(".")
        self.tag, self.css_class = tag, css_class
        self.depth = 0 if selector else 1
        self.skipped = 0
        self.whole = selector is None
        self.found = self.whole
        self.done = False
        self.parts: list[str] = []

    def handle_starttag(self, tag, attrs):
        self.skipped += tag in _NOT_TEXT
        if self.whole or self.done or tag in _VOID:
            return
        if self.depth:
            self.depth += tag == self.tag
        elif tag == self.tag and (not self.css_class or self.css_class in (dict(attrs).get("class") or "").split()):
            self.depth, self.found = 1, True

    def handle_endtag(self, tag):
        if tag in _NOT_TEXT and self.skipped:
            self.skipped -= 1
        if not self.whole and self.depth and tag == self.tag:
            self.depth -= 1
            self.done = self.depth == 0

    def handle_data(self, data):
        if self.depth and not self.done and not self.skipped:
            self.parts.append(data)


def _extract(html: str | None, selector: str | None) -> str | None:
    if html is None:
        return None
    parser = _Text(selector)
    parser.feed(html)
    parser.close()
    return "".join(parser.parts) if parser.found else None


def _parse(pages: DataFrame, key: str, html: str, selector: str | None, out: str, on_error: str | None) -> DataFrame:
    def one(page):
        try:
            value = _extract(page, selector)
        except Exception:
            value = None
        return on_error if value is None else value

    return _mapped(pages, key, html, one, out, "string", pa.string())


def _mapped(pages: DataFrame, key: str, html: str, one: Callable, out: str, kind: str, arrow: pa.DataType) -> DataFrame:
    """``one`` of every page, some pages at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), PAGES):
                some = batch.slice(lo, PAGES)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([one(p.as_py()) for p in some.column(1)], arrow)], [key, out])

    source = pages.select(key, html)
    return source.mapInArrow(run, f"{key} {source.schema[key].dataType.simpleString()}, {out} {kind}")


def page_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Whole page without mark-up; a page that cannot be read carries the failure marker."""
    return _parse(pages, key, html, None, "text", FAILED_MARKER)


def page_content(pages: DataFrame, selector: str = "article", key: str = "page_id", html: str = "html") -> DataFrame:
    """Text of the first element matching ``tag`` or ``tag.class``; pages without one are left out."""
    return _parse(pages, key, html, selector, "content", None).where(F.col("content").isNotNull())


class _Links(HTMLParser):
    """Targets of the elements at the end of a path of steps, ``tag``, ``.class`` or ``tag.class``.

    ``a > b`` asks for a child and ``a b`` for a descendant. Attributes come decoded, whatever their quotes.
    """

    def __init__(self, selector: str, attribute: str):
        super().__init__(convert_charrefs=True)
        self.steps: list[tuple[str, str, bool]] = []  # tag, class, whether it must be the child of the step before
        child = False
        for part in selector.replace(">", " > ").split():
            if part == ">":
                child = True
            else:
                tag, _, css_class = part.partition(".")
                self.steps.append((tag, css_class, child))
                child = False
        self.attribute = attribute
        self.open: list[tuple[str, list[str]]] = []
        self.links: list[str] = []

    @staticmethod
    def _fits(step, element) -> bool:
        return (not step[0] or step[0] == element[0]) and (not step[1] or step[1] in element[1])

    def _path(self, depth: int, step: int) -> bool:
        """Whether the element at ``depth`` ends the first ``step + 1`` steps."""
        if not self._fits(self.steps[step], self.open[depth]):
            return False
        if step == 0:
            return True
        if self.steps[step][2]:
            return depth > 0 and self._path(depth - 1, step - 1)
        return any(self._path(above, step - 1) for above in range(depth))

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        self.open.append((tag, (values.get("class") or "").split()))
        if values.get(self.attribute) is not None and self._path(len(self.open) - 1, len(self.steps) - 1):
            self.links.append(values[self.attribute])
        if tag in _VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):  # an end tag closes what was left open inside its element
            if self.open[i][0] == tag:
                del self.open[i:]
                break


def page_links(pages: DataFrame, selector: str = "a", key: str = "page_id", html: str = "html",
               attribute: str = "href") -> DataFrame:
    """One row per target of the elements that match ``selector``, numbered in document order."""
    def find(page: str | None) -> list[str]:
        parser = _Links(selector, attribute)
        parser.feed(page or "")
        parser.close()
        return parser.links

    found = _mapped(pages, key, html, find, "links", "array<string>", pa.list_(pa.string()))
    return found.select(key, F.posexplode("links").alias("pos", "link"))


def fingerprint(value: Column) -> Column:
    """SHA-224 of the UTF-8 text, in hexadecimal."""
    return F.sha2(value, 224)
