"""Text of pages, and spans of documents: Arrow batches, as their boundaries depend on what came before."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finlattice.session import ship_package

SPAN, EARLIEST, OVERLAP = 1600, 1200, 160
HIDDEN = {"script", "style", "head", "noscript", "template", "ix:header"}
BREAKS = {"p", "div", "br", "tr", "li", "h1", "h2", "h3", "h4", "h5", "h6", "table", "article", "section", "header", "footer", "nav", "ul", "ol", "title"}
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "col", "area", "base", "source", "embed", "track", "param"}


def span_bounds(text: str) -> list[tuple[int, int]]:
    """(start, end) of successive spans: at most SPAN characters, cut at the last space from EARLIEST on, each beginning OVERLAP before the last one's end."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + SPAN)
        if end < len(text):
            space = text.rfind(" ", at + EARLIEST, end)
            end = space if space > 0 else end
        out.append((at, end))
        if end >= len(text):
            break
        at = max(at + 1, end - OVERLAP)
    return out


def spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, span, start, stop, text) of each document's spans; empty and null texts have none."""
    ship_package(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = [(k, i, s, e, t[s:e]) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, (s, e) in enumerate(span_bounds(t))]
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], [key, "span", "start", "stop", "text"])

    return docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, f"{key} bigint, span int, start int, stop int, text string")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.line, self.hidden = [], [], []

    def _end_line(self):
        if text := " ".join("".join(self.line).split()):
            self.lines.append(text)
        self.line = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in BREAKS:
            self._end_line()
        if tag not in VOID and (self.hidden or tag in HIDDEN or "hidden" in a or "display:none" in (a.get("style") or "").replace(" ", "")):
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
        if tag in BREAKS:
            self._end_line()

    def handle_data(self, data):
        if not self.hidden:
            self.line.append(data)


def html_text(html: str) -> str:
    """Visible text, a paragraph to a line."""
    p = _Text()
    p.feed(html)
    p.close()
    p._end_line()
    return "\n".join(p.lines)


def page_text(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, text) of each page; null pages have empty text."""
    ship_package(pages.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([html_text(h) for h in b.column(1).to_pylist()], pa.string())], [key, "text"])

    return pages.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(html), F.lit("")).alias("h")).mapInArrow(run, f"{key} bigint, text string")
