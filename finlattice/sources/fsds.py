"""Quarterly data sets: tab-separated text, typed with nothing dropped silently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Typed columns of each file; other columns stay text. Fixed by the published format.
TYPED = {
    "sub": {"cik": "bigint", "period": "date", "fy": "int", "filed": "date", "nciks": "int"},
    "num": {"ddate": "date", "qtrs": "int", "value": "double"},
    "pre": {"report": "int", "line": "int", "inpth": "int", "negating": "int"},
    "tag": {"custom": "int", "abstract": "int"},
}


#: Where Windows-1252 differs from Latin-1.
_LATIN = [(chr(b), bytes([b]).decode("cp1252")) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """(at, line): the lines of a file, UTF-8 where they are, else Windows-1252."""
    old = F.translate(F.decode(F.col("value").cast("binary"), "ISO-8859-1"), "".join(a for a, _ in _LATIN), "".join(b for _, b in _LATIN))
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.coalesce(F.try_validate_utf8("value"), old).alias("line"))


def fields(line, width: int):
    """An array of `width` fields; a quoted field that holds tabs is put together again, short lines get nulls at the end."""
    parts = F.split(line, "\t")
    open_ = lambda s: (F.length(s) - F.length(F.replace(s, F.lit('"'), F.lit("")))) % 2 == 1
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("held"))
    step = lambda a, p: F.when(a["held"].isNotNull(), F.when(open_(p), F.struct(F.concat(a["out"], F.array(F.concat(a["held"], F.lit("\t"), p))).alias("out"), F.lit(None).cast("string").alias("held"))).otherwise(F.struct(a["out"].alias("out"), F.concat(a["held"], F.lit("\t"), p).alias("held")))).when(
        open_(p), F.struct(a["out"].alias("out"), p.alias("held"))).otherwise(F.struct(F.concat(a["out"], F.array(p)).alias("out"), F.lit(None).cast("string").alias("held")))
    joined = F.aggregate(parts, start, step, lambda a: F.when(a["held"].isNull(), a["out"]).otherwise(parts))
    whole = F.when(F.size(parts) > width, joined).otherwise(parts)
    return F.transform(whole, lambda p: F.nullif(F.regexp_replace(p, r'^"(.*)"$', "$1"), F.lit("")))


def read_table(spark: SparkSession, path: str, table: str) -> tuple[DataFrame, DataFrame]:
    """(rows, log): typed rows of a file, or of a folder of files that each open with the same header line, and one row that counts raw, loaded and rejected lines and values that didn't parse (they read as null)."""
    lines = decoded(spark, path)
    head = lines.orderBy("at").limit(1).first()
    names = [n.strip().lower() for n in head.line.rstrip("\r").split("\t")] if head else []
    body = lines.where(F.col("line") != head.line).where(F.trim("line") != "").select(F.regexp_replace("line", r"\r$", "").alias("line")) if head else lines
    split = body.withColumn("f", fields(F.col("line"), len(names)))
    good = split.where(F.size("f") <= len(names))
    text = good.select(*(F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)))
    if "dimh" in names and "segments" not in names:
        text = text.withColumnRenamed("dimh", "segments")

    def typed(n: str):
        kind = TYPED.get(table, {}).get(n)
        if kind == "date":
            return F.try_to_date(n, "yyyyMMdd")
        return F.col(n).try_cast(kind) if kind else F.col(n)

    rows = text.select(*(typed(n).alias(n) for n in text.columns))
    bad = [F.count_if(F.col(n).isNotNull() & typed(n).isNull()) for n in text.columns if n in TYPED.get(table, {})]
    unparsed = sum(bad[1:], bad[0]) if bad else F.lit(0).cast("long")
    counts = text.agg(F.count("*").alias("loaded_rows"), unparsed.alias("unparsed_values"))
    log = split.agg(F.count("*").alias("raw_rows"), F.count_if(F.size("f") > len(names)).alias("rejected_rows")).crossJoin(counts)  # one row each
    return rows, log.select(F.lit(table).alias("table"), "raw_rows", "loaded_rows", "rejected_rows", "unparsed_values")


def quarters(first: str, last: str) -> list[str]:
    """Quarter names such as 2024q1, both ends included."""
    n = lambda q: int(q[:4]) * 4 + int(q[5]) - 1
    return [f"{k // 4}q{k % 4 + 1}" for k in range(n(first), n(last) + 1)]
