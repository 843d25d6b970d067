"""Daily filing indexes: lines of five fields between bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = r"^(\d+)\|([^|]*)\|([^|]+)\|(\d{4})-?(\d{2})-?(\d{2})\|(\S+)$"


def daily_index(lines: DataFrame, line: str = "value") -> DataFrame:
    """Stub filings from index lines; what isn't a row (banner, header) is left out."""
    g = lambda k: F.regexp_extract(F.trim(line), LINE, k)
    rows = lines.where(F.trim(line).rlike(LINE))
    return rows.select(
        F.regexp_extract(g(7), r"(\d{10}-\d{2}-\d{6})", 1).alias("accession"), g(1).cast("bigint").alias("cik"), F.trim(g(2)).alias("name"), F.trim(g(3)).alias("form"),
        F.try_to_date(F.concat(g(4), g(5), g(6)), "yyyyMMdd").alias("filed_date"), g(7).alias("path"), F.lit("daily_index").alias("source"),
    ).where("accession <> ''")


def ownership_index(lines: DataFrame, line: str = "value") -> DataFrame:
    """Rows of ownership forms; a row of such a form that doesn't parse stops the run rather than go missing."""
    wanted = r"\|(3|4|5|3/A|4/A|5/A|13F-HR|13F-HR/A|SC 13[DG](/A)?|SCHEDULE 13[DG](/A)?)\|"
    mine = lines.where(F.col(line).rlike(wanted))
    checked = mine.select(F.when(F.trim(line).rlike(LINE), F.col(line)).otherwise(F.raise_error(F.concat(F.lit("malformed index row: "), F.col(line)))).alias("value"))
    return daily_index(checked)
