"""XBRL instances and linkbases, ownership XML and filing indexes: Arrow batches over file bytes, with limits."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from finlattice.session import ship_package

MAX_BYTES, MAX_NODES, MAX_DEPTH = 64 << 20, 500_000, 64
XBRLI, XLINK, LINK, XBRLDI = "{http://www.xbrl.org/2003/instance}", "{http://www.w3.org/1999/xlink}", "{http://www.xbrl.org/2003/linkbase}", "{http://xbrl.org/2006/xbrldi}"


class MarkupError(ValueError):
    """A file that isn't read: too large, too deep, with a document type, or not XML."""


def tree(data: bytes, max_bytes: int = MAX_BYTES, max_nodes: int = MAX_NODES) -> ET.Element:
    if len(data) > max_bytes:
        raise MarkupError("file is too large")
    if b"<!DOCTYPE" in data[:4096].upper() or b"<!ENTITY" in data.upper():
        raise MarkupError("document types are refused")
    parser, depth, nodes, root = ET.XMLPullParser(("start", "end")), 0, 0, None
    try:
        for at in range(0, len(data), 1 << 16):
            parser.feed(data[at : at + (1 << 16)])
            for event, node in parser.read_events():
                if event == "start":
                    depth, nodes, root = depth + 1, nodes + 1, node if root is None else root
                    if depth > MAX_DEPTH or nodes > max_nodes:
                        raise MarkupError("document is too deep or has too many parts")
                else:
                    depth -= 1
        parser.close()
    except ET.ParseError as e:
        raise MarkupError(str(e)) from e
    if root is None:
        raise MarkupError("file is empty")
    return root


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def facts(data: bytes) -> list[tuple]:
    """(concept, namespace, value, unit, decimals, is_nil, start, end, dimensions) of each fact of an instance."""
    root = tree(data)
    contexts, units = {}, {}
    for c in root.iter(f"{XBRLI}context"):
        p = c.find(f"{XBRLI}period")
        text = lambda n, p=p: (x.text or "").strip() if p is not None and (x := p.find(f"{XBRLI}{n}")) is not None else None
        pairs = [(m.get("dimension", ""), (m.text or "").strip()) for m in c.iter(f"{XBRLDI}explicitMember")]
        pairs += [(m.get("dimension", ""), "".join(m.itertext()).strip()) for m in c.iter(f"{XBRLDI}typedMember")]
        dims = "".join(f"{a.rpartition(':')[2]}={m.rpartition(':')[2]};" for a, m in sorted(pairs)) or None
        contexts[c.get("id")] = (text("startDate"), text("instant") or text("endDate"), dims)
    for u in root.iter(f"{XBRLI}unit"):
        measures = lambda e: "*".join((m.text or "").strip().rpartition(":")[2] for m in e.iter(f"{XBRLI}measure"))
        top, bottom = (u.find(f".//{XBRLI}{n}") for n in ("unitNumerator", "unitDenominator"))
        units[u.get("id")] = f"{measures(top)}/{measures(bottom)}" if top is not None and bottom is not None else measures(u)
    out = []
    for f in root.iter():
        if (ref := f.get("contextRef")) in contexts and len(f) == 0:
            nil = f.get("{http://www.w3.org/2001/XMLSchema-instance}nil") == "true"
            start, end, dims = contexts[ref]
            out.append((local(f.tag), f.tag[1:].partition("}")[0], None if nil else (f.text or "").strip(), units.get(f.get("unitRef")), f.get("decimals"), nil, start, end, dims))
    return out


def arcs(data: bytes, kind: str) -> list[tuple]:
    """(role, parent, child, order, weight, preferred_label) of the presentation or calculation arcs of a linkbase or schema."""
    out = []
    for link in tree(data).iter(f"{LINK}{kind}Link"):
        where: dict[str | None, list[str]] = {}  # a label may name several locators: an arc then stands for every pair
        for loc in link.iter(f"{LINK}loc"):
            where.setdefault(loc.get(f"{XLINK}label"), []).append(loc.get(f"{XLINK}href", "").rpartition("#")[2])
        for a in link.iter(f"{LINK}{kind}Arc"):
            if a.get("use") == "prohibited":
                continue
            for parent in where.get(a.get(f"{XLINK}from"), [None]):
                for child in where.get(a.get(f"{XLINK}to"), [None]):
                    out.append((link.get(f"{XLINK}role"), parent, child, float(a.get("order") or 0), float(a.get("weight", "1")), a.get("preferredLabel")))
    return out


def transactions(data: bytes) -> list[tuple]:
    """(issuer, owner, security, day, code, shares, price, balance, ownership) of a Form 3, 4 or 5."""
    root = tree(data, 8 << 20, 50_000)
    text = lambda e, path: (x.text or "").strip() or None if e is not None and (x := e.find(path)) is not None else None
    issuer = text(root, "issuer/issuerCik")
    owners = [o for r in root.findall("reportingOwner") if (o := text(r, "reportingOwnerId/rptOwnerCik"))]
    if not issuer or not owners:
        raise MarkupError("issuer or owner is missing")
    out = []
    for t in [*root.iter("nonDerivativeTransaction"), *root.iter("derivativeTransaction"), *root.iter("nonDerivativeHolding"), *root.iter("derivativeHolding")]:
        v = lambda p, t=t: text(t, f"{p}/value")
        row = (v("securityTitle"), v("transactionDate"), text(t, "transactionCoding/transactionCode"), v("transactionAmounts/transactionShares"), v("transactionAmounts/transactionPricePerShare"), v("postTransactionAmounts/sharesOwnedFollowingTransaction"), v("ownershipNature/directOrIndirectOwnership"))
        out += [(issuer, o, *row) for o in owners]
    return out


def holdings(data: bytes) -> list[tuple]:
    """(issuer_name, title, cusip, value, shares, kind, put_call) of a 13F information table; numbers stay text, as they may be wider than a decimal column."""
    out = []
    for t in tree(data).iter():
        if local(t.tag) == "infoTable":
            v = {local(e.tag): (e.text or "").strip() for e in t.iter()}
            out.append((v.get("nameOfIssuer"), v.get("titleOfClass"), (v.get("cusip") or "").upper() or None, v.get("value"), v.get("sshPrnamt"), v.get("sshPrnamtType"), v.get("putCall")))
    return out


class _Index(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows, self.cells, self.href, self.in_cell = [], None, None, False

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.cells, self.href = [], None
        elif tag == "td" and self.cells is not None:
            self.cells.append("")
            self.in_cell = True
        elif tag == "a" and self.in_cell:
            self.href = dict(attrs).get("href")

    def handle_endtag(self, tag):
        if tag == "td":
            self.in_cell = False
        elif tag == "tr" and self.cells:
            if len(self.cells) >= 5 and self.href:
                self.rows.append((*self.cells[:5], self.href))
            self.cells = None

    def handle_data(self, data):
        if self.in_cell and self.cells:
            self.cells[-1] += data


def filing_documents(html: bytes) -> list[tuple]:
    """(seq, description, filename, doc_type, size, url) of the rows of a filing's index page."""
    p = _Index()
    p.feed(html.decode("utf-8", "replace"))
    number = lambda s: int(s.strip()) if s.strip().isdigit() else None
    return [(number(s), d.strip(), href.rpartition("/")[2], t.strip(), number(n), href) for s, d, _, t, n, href in p.rows]


PARSERS = {
    "facts": (facts, "concept string, namespace string, value string, unit string, decimals string, is_nil boolean, start string, end string, dimensions string"),
    "presentation": (lambda b: arcs(b, "presentation"), "role string, parent string, child string, arc_order double, weight double, preferred_label string"),
    "calculation": (lambda b: arcs(b, "calculation"), "role string, parent string, child string, arc_order double, weight double, preferred_label string"),
    "transactions": (transactions, "issuer string, owner string, security string, day string, code string, shares string, price string, balance string, ownership string"),
    "holdings": (holdings, "issuer_name string, title string, cusip string, value string, shares string, kind string, put_call string"),
    "documents": (filing_documents, "seq int, description string, filename string, doc_type string, size bigint, url string"),
}
KINDS = {"string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64()}


def parsed(files: DataFrame, parser: str, path: str = "path", content: str = "content") -> DataFrame:
    """(path, error, parser's columns) of each file (binaryFile rows): a file that isn't read gives one row with the reason, never none and never a guess."""
    ship_package(files.sparkSession)
    columns = [c.split() for c in PARSERS[parser][1].split(", ")]

    def run(batches):
        parse = PARSERS[parser][0]
        for b in batches:
            rows = []
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += [(p, None, *r) for r in parse(data or b"")]
                except MarkupError as e:
                    rows.append((p, str(e), *[None] * len(columns)))
            cells = zip(*rows, strict=True) if rows else [()] * (2 + len(columns))
            kinds = [pa.string(), pa.string(), *(KINDS[k] for _, k in columns)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["path", "error", *(n for n, _ in columns)])

    return files.select(path, content).mapInArrow(run, f"path string, error string, {PARSERS[parser][1]}")


def file_roles(names: list[str]) -> dict[str, str]:
    """Which file of a filing is the instance, schema and each linkbase, by suffix; the inline instance's extract wins."""
    out: dict[str, str] = {}
    for role, suffix in (("calculation", "_cal.xml"), ("definition", "_def.xml"), ("label", "_lab.xml"), ("presentation", "_pre.xml"), ("schema", ".xsd")):
        if found := sorted(n for n in names if n.lower().endswith(suffix)):
            out[role] = found[0]
    rest = sorted(n for n in names if n.lower().endswith(".xml") and n not in out.values() and n.lower() not in ("filingsummary.xml",) and not n.lower().startswith("r"))
    if found := [n for n in rest if n.lower().endswith("_htm.xml")] or rest:
        out["instance"] = found[0]
    return out
