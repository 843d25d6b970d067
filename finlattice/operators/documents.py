"""Naming of a filing's documents, contents and differences of pages, phrase hits with context."""

from __future__ import annotations

import difflib
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finlattice.operators.text import html_text
from finlattice.session import ship_package

# What exhibits are called, by number. Fixed values of the filing rules.
EXHIBITS = {
    "2": "Plan of acquisition", "3": "Articles and bylaws", "4": "Rights of security holders", "10": "Material contract", "21": "Subsidiaries", "23": "Consent", "31": "Certification", "32": "Certification", "99": "Additional exhibit",
}
FORMS = {
    "10-K": "Annual report", "10-Q": "Quarterly report", "8-K": "Current report", "20-F": "Annual report (foreign)", "40-F": "Annual report (Canadian)", "6-K": "Current report (foreign)",
    "DEF 14A": "Proxy statement", "S-1": "Registration statement", "3": "Initial ownership", "4": "Change in ownership", "5": "Annual ownership", "13F-HR": "Institutional holdings",
}
MAX_HITS, BEFORE, AFTER, MAX_HUNKS = 5, 80, 120, 200


def _named(c: Column, names: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[c]


def form_label(form: Column) -> Column:
    """The form in words, an amendment said so; forms without a name stay as they are."""
    base = F.split(form, "/")[0]
    return F.concat(F.coalesce(_named(base, FORMS), base), F.when(form.endswith("/A"), " (amended)").otherwise(""))


def labelled_documents(docs: DataFrame) -> DataFrame:
    """Adds label, kind, rank and is_primary: the form itself first, then earnings releases, then exhibits by number, then the rest."""
    kind = F.upper(F.trim("doc_type"))
    number = F.regexp_extract(kind, r"^EX-(\d+)", 1)
    release = (number == "99") & F.lower(F.coalesce("description", F.lit(""))).rlike("press release|earnings|results")
    label = F.when(release, "Earnings release").when(number != "", F.concat(F.lit("Exhibit "), F.regexp_extract(kind, r"^EX-([\d.]+)", 1), F.lit(": "), F.coalesce(_named(number, EXHIBITS), F.lit("exhibit")))).otherwise(form_label(kind))
    what = F.when(release, "release").when(number != "", "exhibit").when(kind.isin("GRAPHIC", "ZIP", "XML", "JSON"), "other").otherwise("form")
    rank = F.when(what == "form", 0).when(release, 1).when(what == "exhibit", 100 + F.nullif(number, F.lit("")).cast("int")).otherwise(1000)
    d = docs.withColumn("label", label).withColumn("kind", what).withColumn("rank", rank)
    first = F.row_number().over(Window.partitionBy("cik", "accession").orderBy("rank", "seq"))
    return d.withColumn("is_primary", first == 1)


class _Headings(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.level, self.text = [], 0, []

    def handle_starttag(self, tag, attrs):
        if re.fullmatch("h[1-6]", tag):
            self.level, self.text = int(tag[1]), []

    def handle_endtag(self, tag):
        if self.level and tag == f"h{self.level}":
            if title := " ".join("".join(self.text).split()):
                self.out.append((self.level, title))
            self.level = 0

    def handle_data(self, data):
        if self.level:
            self.text.append(data)


def contents(html: str) -> list[tuple[int, str]]:
    """(level, title) of a page's headings, in order."""
    p = _Headings()
    p.feed(html)
    return p.out


def _rows(docs: DataFrame, columns: list[str], make, schema: str, kinds: list) -> DataFrame:
    ship_package(docs.sparkSession)
    names = [s.split()[0] for s in schema.split(", ")]

    def run(batches):
        for b in batches:
            rows = [r for values in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in make(*values)]
            cells = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names)

    return docs.select(*columns).mapInArrow(run, schema)


def tables_of_contents(pages: DataFrame, key: str, html: str) -> DataFrame:
    make = lambda k, h: [(k, i, level, title) for i, (level, title) in enumerate(contents(h or ""))]
    return _rows(pages, [key, html], make, f"{key} bigint, position int, level int, title string", [pa.int64(), pa.int32(), pa.int32(), pa.string()])


def phrase_hits(pages: DataFrame, key: str, html: str, phrase: str) -> DataFrame:
    """(key, hit, context): up to MAX_HITS places a page for display, case and white space aside, and what stands around them."""
    pattern = re.compile(r"\s+".join(map(re.escape, phrase.split())), re.IGNORECASE)

    def make(k, h):
        text = html_text(h or "")
        return [(k, i, text[max(0, m.start() - BEFORE) : m.end() + AFTER]) for i, m in zip(range(MAX_HITS), pattern.finditer(text), strict=False)]

    return _rows(pages, [key, html], make, f"{key} bigint, hit int, context string", [pa.int64(), pa.int32(), pa.string()])


def version_changes(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, hunk, kind, old_text, new_text): what a version changes, by lines; more than MAX_HUNKS of them end in one row of kind `more`."""

    def make(k, a, b):
        a, b = (a or "").splitlines(), (b or "").splitlines()
        ops = [o for o in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if o[0] != "equal"]
        rows = [(k, i, kind, "\n".join(a[p:q]), "\n".join(b[r:s])) for i, (kind, p, q, r, s) in enumerate(ops[:MAX_HUNKS])]
        return rows + ([(k, MAX_HUNKS, "more", str(len(ops) - MAX_HUNKS), None)] if len(ops) > MAX_HUNKS else [])

    return _rows(pairs, [key, old, new], make, f"{key} bigint, hunk int, kind string, old_text string, new_text string", [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()])
