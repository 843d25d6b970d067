"""Submissions, company facts and ticker files: JSON text to typed rows, exploded by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACT = "struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string,frame:string>"
FACTS = f"struct<cik:bigint,facts:map<string,map<string,struct<label:string,units:map<string,array<{FACT}>>>>>>"
COLUMNS = {
    "accessionNumber": "string", "filingDate": "string", "reportDate": "string", "acceptanceDateTime": "string", "act": "string", "form": "string", "core_type": "string", "fileNumber": "string", "filmNumber": "string",
    "items": "string", "size": "bigint", "isXBRL": "int", "isInlineXBRL": "int", "primaryDocument": "string", "primaryDocDescription": "string",
}
ARRAYS = "struct<" + ",".join(f"{c}:array<{t}>" for c, t in COLUMNS.items()) + ">"
HEADER = ("name", "sic", "sicDescription", "fiscalYearEnd", "entityType", "stateOfIncorporation")


def company_facts(files: DataFrame, body: str = "value") -> DataFrame:
    """One row per fact from rows of companyfacts JSON: taxonomy, concept, unit and period, values as filed."""
    j = files.select(F.from_json(body, FACTS).alias("j")).select("j.cik", F.explode("j.facts").alias("taxonomy", "concepts"))
    j = j.select("cik", "taxonomy", F.explode("concepts").alias("concept", "c")).select("cik", "taxonomy", "concept", F.col("c.label").alias("label"), F.explode("c.units").alias("unit", "values"))
    v = j.select("cik", "taxonomy", "concept", "label", "unit", F.explode("values").alias("v"))
    date = lambda c: F.try_to_date(F.col(c), "yyyy-MM-dd")
    return v.select(
        "cik", "taxonomy", "concept", "unit", date("v.start").alias("period_start"), date("v.end").alias("period_end"), F.col("v.val").alias("value"), F.col("v.accn").alias("accession"),
        "v.fy", "v.fp", "v.form", date("v.filed").alias("filed"), "v.frame", "label",
    )


def filings(files: DataFrame, body: str = "value", page_cik: str | None = None) -> DataFrame:
    """Filings from submissions JSON, whose columns are parallel arrays. With page_cik the rows are overflow pages, which hold the arrays alone."""
    arrays = F.from_json(body, ARRAYS) if page_cik else F.from_json(body, f"struct<cik:string,filings:struct<recent:{ARRAYS}>>")
    cik = F.col(page_cik).cast("bigint") if page_cik else F.col("j.cik").cast("bigint")
    a = files.select("*", arrays.alias("j")).select(cik.alias("cik"), F.col("j" if page_cik else "j.filings.recent").alias("a"))
    rows = a.select("cik", F.explode(F.arrays_zip(*(F.coalesce(F.col(f"a.{c}"), F.array().cast(f"array<{k}>")).alias(c) for c, k in COLUMNS.items()))).alias("r")).select("cik", "r.*")
    date = lambda c: F.try_to_date(F.col(c), "yyyy-MM-dd")
    return rows.select(
        F.col("accessionNumber").alias("accession"), "cik", "form", "core_type", date("filingDate").alias("filed_date"), date("reportDate").alias("report_date"),
        F.try_to_timestamp(F.col("acceptanceDateTime"), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX")).cast("timestamp_ntz").alias("acceptance_datetime"), "act", F.col("fileNumber").alias("file_number"), F.col("filmNumber").alias("film_number"),
        F.filter(F.transform(F.split(F.coalesce("items", F.lit("")), ","), lambda i: F.trim(i)), lambda i: i != "").alias("items"), "size", (F.col("isXBRL") == 1).alias("is_xbrl"), (F.col("isInlineXBRL") == 1).alias("is_inline_xbrl"),
        F.col("primaryDocument").alias("primary_doc"), F.col("primaryDocDescription").alias("primary_doc_description"), F.lit("submissions").alias("source"), F.year(date("filingDate")).alias("year"),
    )


def headers(files: DataFrame, body: str = "value") -> DataFrame:
    """Company headers; keys without a column of their own stay as JSON in header_extra."""
    m = files.select(F.from_json(body, "map<string,string>").alias("m"))
    other = F.map_filter("m", lambda k, _: ~k.isin("cik", "filings", "tickers", "exchanges", *HEADER))
    return m.select(F.col("m")["cik"].cast("bigint").alias("cik"), *(F.nullif(F.col("m")[c], F.lit("")).alias(F_NAMES[c]) for c in HEADER), F.to_json(other).alias("header_extra"))


F_NAMES = {"name": "name", "sic": "sic", "sicDescription": "sic_description", "fiscalYearEnd": "fiscal_year_end", "entityType": "entity_type", "stateOfIncorporation": "state_of_incorporation"}


def tickers(files: DataFrame, body: str = "value") -> DataFrame:
    """(cik, ticker, exchange, ordinal) of either shape of the ticker file: rows under fields and data, or objects under numbers."""
    listed = F.from_json(body, "struct<fields:array<string>,data:array<array<string>>>")
    a = files.select(listed.alias("j")).where("j.data IS NOT NULL").select("j.fields", F.posexplode("j.data").alias("ordinal", "d"))
    at = lambda n: F.get("d", F.array_position("fields", n).cast("int") - 1)
    a = a.select(at("cik").cast("bigint").alias("cik"), F.upper(at("ticker")).alias("ticker"), at("exchange").alias("exchange"), "ordinal")
    b = files.select(F.from_json(body, "map<string,struct<cik_str:bigint,ticker:string,title:string>>").alias("m"), listed.alias("j")).where("j.data IS NULL").select(F.explode("m").alias("k", "v"))
    b = b.select(F.col("v.cik_str").alias("cik"), F.upper("v.ticker").alias("ticker"), F.lit(None).cast("string").alias("exchange"), F.col("k").cast("int").alias("ordinal"))
    return a.unionByName(b)
