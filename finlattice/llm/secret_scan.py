"""Secret scans over an incremental ledger of content-addressed blobs and rule versions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlattice.llm._common import documents, texts

# Rules, fixed values. The base kinds stand in the order in which spans that start together are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KEY_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?-----")
KEY_END = re.compile(r"-----END (?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?-----")
#: What follows the first line of a key that has no last one: header fields and lines of base64.
KEY_BODY = re.compile(r"(?:[ \t]*+\r?+\n(?:[ \t]*+[A-Za-z][A-Za-z0-9-]*+: [^\n]*+|[ \t]*+[A-Za-z0-9+/=]++(?=[ \t\r]*+(?:\n|\Z|-----BEGIN ))|(?=[ \t\r]*+\n)))*+")
HOST_TOKEN = re.compile(r"gh[opsur]_[A-Za-z0-9]{36,}")
CHAT_TOKEN = re.compile(r"xox[abeoprs]-[A-Za-z0-9-]{10,}")
WEB_KEY = re.compile(r"AIza[A-Za-z0-9_-]{35}")
PAY_KEY = re.compile(r"[rs]k_live_[A-Za-z0-9]{16,}")
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{16,}+")
LOGIN = re.compile(r"://[^\s/:@]{1,64}:[^\s/:@]{8,128}@")
KINDS = ("assign", "access", "hex", "private", "host_token", "chat_token", "web_key", "pay_key", "signed", "login")
#: Version of each kind's rule, raised when that rule changes: blobs are then scanned anew for that kind alone.
VERSIONS = (1, 1, 1, 2, 2, 1, 1, 1, 1, 1)
BASE = 3
_WORDS = ("pass", "secret", "token", "api")
_HEX_RUN = re.compile(rb"[0-9a-f]{32}")
FINDINGS = "blob binary, kind int, version int, start_at int, end_at int"
LEDGER = "blob binary, kind int, version int"


def keys(text: str) -> list[tuple[int, int]]:
    """Private keys from the first line through the last; where the next key comes first or no last line does, through the lines that look like a key's."""
    out, ends = [], [m.end() for m in KEY_END.finditer(text)]
    begins = list(KEY_BEGIN.finditer(text))
    j = at = 0
    for i, m in enumerate(begins):
        if m.start() < at:
            continue
        while j < len(ends) and ends[j] <= m.end():
            j += 1
        limit = begins[i + 1].start() if i + 1 < len(begins) else len(text)
        at = ends[j] if j < len(ends) and ends[j] <= limit else KEY_BODY.match(text, m.end()).end()
        out.append((m.start(), at))
    return out


def _rules(text: str):
    """The spans of each kind, by kind; a rule is tried only on texts that hold what it must."""
    low = text.lower()
    yield 0, lambda: [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if any(w in low for w in _WORDS) else ()
    yield 1, lambda: [m.span() for m in ACCESS.finditer(text)] if "AKIA" in text else ()
    yield 2, lambda: [m.span() for m in HEX.finditer(text)] if _HEX_RUN.search(text.encode()) else ()
    yield 3, lambda: keys(text) if "PRIVATE KEY" in text else ()
    for kind, mark, rule in ((4, "gh", HOST_TOKEN), (5, "xox", CHAT_TOKEN), (6, "AIza", WEB_KEY), (7, "k_live_", PAY_KEY), (8, "eyJ", SIGNED), (9, "://", LOGIN)):
        yield kind, lambda mark=mark, rule=rule: [m.span() for m in rule.finditer(text)] if mark in text else ()


def scan(text: str, kinds=None) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start, then kind; of the kinds asked for, else of all."""
    return sorted(((k, *span) for k, find in _rules(text) if kinds is None or k in kinds for span in find()), key=lambda s: (s[1], s[0]))


def empty_ledger(spark: SparkSession) -> DataFrame:
    """(blob, kind, version): which rule has read which blob before; and none has."""
    return spark.createDataFrame([], LEDGER)


def current(rows: DataFrame) -> DataFrame:
    """The ledger or findings rows of today's rule versions."""
    return rows.where(F.col("version") == F.element_at(F.array(*map(F.lit, VERSIONS)), F.col("kind") + 1))


def scan_unseen(versions: DataFrame, ledger: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, new ledger rows) of the pairs of a blob in versions and a rule version that the ledger doesn't hold.

    versions: one row per historical version of a path. A blob's address is the SHA-256 of its bytes; of the rows that hold a blob with
    unseen pairs the one with the least id carries it to the scan, so only that row's text is read, by the unseen rules alone.
    Append both results to their tables to make the next run incremental, as scan_stored() does.
    """
    t = texts(versions, id_col, text_col).withColumn("blob", F.unhex(F.sha2("text", 256)))
    every = F.array(*map(F.lit, range(len(KINDS))))
    known = current(ledger).groupBy("blob").agg(F.collect_set("kind").alias("known"))  # at most one entry a kind
    todo = (
        t.groupBy("blob").agg(F.min("doc_id").alias("carrier")).join(known, "blob", "left")
        .select("blob", "carrier", F.when(F.col("known").isNull(), every).otherwise(F.array_except(every, "known")).alias("kinds")).where(F.size("kinds") > 0)
    )
    key = lambda c: F.coalesce(F.col(c), F.lit(-(1 << 63)))
    # Joined on row and blob: spread evenly however many paths share a blob. The small side is hashed, so texts aren't sorted.
    chosen = todo.select("blob", key("carrier").alias("row"), F.when(F.size("kinds") < len(KINDS), F.col("kinds")).alias("kinds")).hint("shuffle_hash")
    carried = t.select("blob", "text", key("doc_id").alias("row")).join(chosen, ["row", "blob"]).select("blob", "text", "kinds")

    def run(batches):
        for batch in batches:
            rows = [(blob, s[0], VERSIONS[s[0]], *s[1:]) for blob, text, kinds in zip(*batch.columns, strict=True) for s in scan(text.as_py(), kinds.as_py())]
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            kinds = (pa.binary(), *[pa.int32()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["blob", "kind", "version", "start_at", "end_at"])

    findings = carried.mapInArrow(run, FINDINGS).distinct()
    seen = todo.select("blob", F.explode("kinds").alias("kind")).select("blob", "kind", F.element_at(F.array(*map(F.lit, VERSIONS)), F.col("kind") + 1).alias("version"))
    return findings, seen


def scan_stored(versions: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """spans_by_path() of versions, with a ledger and findings kept as Parquet under folder (which a cluster's machines share).

    Each call scans only pairs of blob and rule version that no earlier call has, and appends to both tables: findings first, so a
    run that is lost between them scans again and its findings, read without repeats, come out the same.
    """
    spark = versions.sparkSession
    held = {}
    for name, schema in (("ledger", LEDGER), ("findings", FINDINGS)):
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{folder}/{name}")
        held[name] = spark.read.schema(schema).parquet(f"{folder}/{name}")
    findings, seen = scan_unseen(versions, held["ledger"], id_col, text_col)
    findings.write.mode("append").parquet(f"{folder}/findings")
    seen.write.mode("append").parquet(f"{folder}/ledger")
    stored = spark.read.schema(FINDINGS).parquet(f"{folder}/findings")
    return spans_by_path(versions, current(stored).distinct(), id_col, text_col)


def spans_by_path(versions: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, blob, spans array<struct<start_at, kind, end_at>>) of every row of versions; the array is empty where nothing was found."""
    paths = texts(versions, id_col, text_col).select("doc_id", F.unhex(F.sha2("text", 256)).alias("blob"))
    found = findings.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start_at", "kind", "end_at"))).alias("spans"))
    none = F.array().cast("array<struct<start_at:int,kind:int,end_at:int>>")
    return paths.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None, stored: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """spans_by_path() of docs after a scan of what the ledger lacks; stored: findings of the blobs in the ledger.

    Null texts count as empty and have no spans. Rows that repeat, tie or have null ids each get a row. Extra columns are not read.
    """
    findings, _ = scan_unseen(docs, empty_ledger(docs.sparkSession) if ledger is None else ledger, id_col, text_col)
    return spans_by_path(docs, findings if stored is None else findings.unionByName(current(stored)).distinct(), id_col, text_col)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans (start, kind, end) replaced by a mark that names the first one's kind."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]} removed]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length_col: str = "n_chars") -> DataFrame:
    """The rows of docs, all columns, with every secret masked; length_col, where there is one, follows the text.

    All rows stay, repeated ones and null ids too; null and empty texts stay as they are, and other columns may have any name. No rows give none.
    """
    findings, _ = scan_unseen(docs, empty_ledger(docs.sparkSession), id_col, text_col)
    found = findings.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start_at", "kind", "end_at"))).alias("spans"))
    rows = docs.select(F.struct("*").alias("row"), F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)).alias("blob"))
    joined = rows.join(found.hint("shuffle_hash"), "blob", "left").select("row", "spans")
    names, types = docs.columns, docs.schema

    def run(batches):
        for b in batches:
            columns = dict(zip(names, b.column(0).flatten(), strict=True))
            hit = [i for i, s in enumerate(b.column(1)) if s.is_valid]
            if hit:
                text = columns[text_col].to_pylist()
                for i in hit:
                    text[i] = masked(text[i], [(s["start_at"], s["kind"], s["end_at"]) for s in b.column(1)[i].as_py()])
                if length_col in columns:
                    kind, size = columns[length_col].type, columns[length_col].to_pylist()
                    for i in hit:
                        size[i] = len(text[i])
                    columns[length_col] = pa.array(size, kind)
                columns[text_col] = pa.array(text, columns[text_col].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return joined.mapInArrow(run, types)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.array(*map(F.lit, KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(named, s["kind"] + 1), s["start_at"].cast("string"), s["end_at"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scan_documents(documents(spark, sf_dir)).select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(BASE)),
        F.sha2(text(F.filter("spans", lambda s: s["kind"] < BASE)), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
