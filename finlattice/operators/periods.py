"""The fiscal period spine: which filing reports which fiscal year or quarter, its amendments and its earnings release."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finlattice.functions import core as C
from finlattice.operators.joins import next_anchor


def results_rows(filings: DataFrame) -> DataFrame:
    f = filings.withColumn("family", C.form_family("form")).withColumn("amended", C.is_amendment("form")).withColumn("transition", F.coalesce(C.base_form("form").rlike("KT|QT"), F.lit(False)))
    return f.where(F.col("family").isin("annual", "quarterly") & F.col("report_date").isNotNull() & F.col("filed_date").isNotNull())


def labelled(filings: DataFrame, companies: DataFrame) -> DataFrame:
    """Results filings with fiscal_year, fiscal_quarter and label_method: from the next annual anchor, else the nominal year end, else the calendar."""
    r = results_rows(filings).join(companies.select("cik", F.substring("fiscal_year_end", 1, 2).cast("int").alias("fye_month"), F.substring("fiscal_year_end", 3, 2).cast("int").alias("fye_day")), "cik", "left")
    month, day = F.coalesce("fye_month", F.lit(12)), F.coalesce("fye_day", F.lit(31))
    r = r.withColumn("m", month).withColumn("d", day)
    anchors = r.where("family = 'annual' AND NOT amended AND NOT transition").select("cik", "report_date")
    r = next_anchor(r, anchors, "cik", F.date_sub("report_date", 14), F.col("report_date"), [c for c in r.columns if c != "cik"])
    by_anchor = F.when(F.datediff("anchor", "report_date") <= 330, C.quarter_of_months(C.months_apart("anchor", "report_date")))
    r = r.withColumn("qa", F.when(by_anchor.isin(1, 2, 3), by_anchor)).withColumn("nominal", C.year_end_after("report_date", "m", "d"))
    r = r.withColumn("qn", C.quarter_of_months(C.months_apart("nominal", "report_date")))
    annual = F.col("family") == "annual"
    calendar = F.when(F.quarter("report_date") == 4, 3).otherwise(F.quarter("report_date"))
    year_of = lambda c: C.fiscal_year_of(c, "m", "d")
    named = F.col("qn").isin(1, 2, 3)
    return r.select(
        "cik", "accession", "form", "filed_date", "report_date", "amended", "transition", "family",
        F.when(annual, year_of("report_date")).when(F.col("qa").isNotNull(), year_of("anchor")).when(named, year_of("nominal")).otherwise(F.year("report_date")).alias("fiscal_year"),
        F.when(annual, 4).when(F.col("qa").isNotNull(), F.col("qa")).when(named, F.col("qn")).otherwise(calendar).alias("fiscal_quarter"),
        F.when(annual, "period_end").when(F.col("qa").isNotNull(), "anchor").when(named, "nominal_fye").otherwise("fallback").alias("label_method"),
    )


def period_spine(filings: DataFrame, companies: DataFrame) -> DataFrame:
    """One row per (cik, fiscal year, quarter, transition): the latest original as results filing, all others and amendments listed, and the first release in the window after the period."""
    r = labelled(filings, companies)
    order = F.struct("filed_date", "accession")
    g = r.groupBy("cik", "fiscal_year", "fiscal_quarter", "transition").agg(
        F.max(F.when(~F.col("amended"), F.struct(order.alias("o"), F.col("accession"), F.col("form"), F.col("filed_date"), F.col("report_date"), F.col("label_method")))).alias("best"),
        F.max(F.struct(order.alias("o"), F.col("report_date"))).alias("any"),
        F.array_sort(F.collect_set("accession")).alias("all"),
    )
    end = F.coalesce("best.report_date", "any.report_date")
    quarter = F.col("fiscal_quarter")
    p = g.select(
        "cik", C.period_label("fiscal_year", "fiscal_quarter", "transition").alias("period_label"), "fiscal_year", quarter.cast("byte").alias("fiscal_quarter"),
        F.when(F.col("transition"), "transition").when(quarter == 4, "annual").otherwise("quarter").alias("period_type"), end.alias("period_end"),
        F.col("best.accession").alias("results_accession"), F.col("best.form").alias("results_form"), F.col("best.filed_date").alias("results_filed_date"),
        F.filter("all", lambda a: ~a.eqNullSafe(F.col("best.accession"))).alias("amendment_accessions"), F.coalesce("best.label_method", F.lit("amendment_only")).alias("label_method"),
    )
    release = filings.where((C.base_form("form") == "8-K") & F.exists("items", lambda i: i == "2.02")).select("cik", F.col("accession").alias("earnings_release_accession"), F.col("filed_date").alias("earnings_release_filed_date"))
    window = F.when(F.col("fiscal_quarter") == 4, 90).otherwise(60)
    found = F.struct("earnings_release_filed_date", "earnings_release_accession")
    p = next_anchor(p, release, "cik", F.date_add("period_end", 1), F.col("earnings_release_filed_date"), [c for c in p.columns if c != "cik"], "__release", found)
    near = F.col("__release.earnings_release_filed_date") <= F.date_add("period_end", window)
    release = F.when(near, F.col("__release"))
    return p.select(*(c for c in p.columns if c != "__release"), *(release[c].alias(c) for c in ("earnings_release_filed_date", "earnings_release_accession")))


def finalize_facts(facts: DataFrame) -> DataFrame:
    """Adds duration_days, duration_kind and is_current: of one company's facts for a concept, unit and period the latest filed, ties to the greater accession."""
    w = Window.partitionBy("cik", "taxonomy", "concept", "unit", "period_start", "period_end").orderBy(F.desc_nulls_last("filed"), F.desc_nulls_last("accession"))
    days = F.datediff("period_end", "period_start") + 1
    return facts.withColumn("duration_days", days).withColumn("duration_kind", C.duration_kind("period_start", "period_end")).withColumn("is_current", F.row_number().over(w) == 1)


def universe(tickers: DataFrame, filings: DataFrame, headers: DataFrame, today: str) -> DataFrame:
    """Companies with their primary ticker, last filings and whether they are active (a financial report within 548 days)."""
    primary = tickers.groupBy("cik").agg(F.min_by(F.struct("ticker", "exchange"), "ordinal").alias("t"))
    fin = C.form_family("form").isin("annual", "quarterly")
    stats = filings.groupBy("cik").agg(
        F.max("filed_date").alias("last_filing_date"), F.max(F.when(fin, F.struct("filed_date", "accession", "form"))).alias("last"), F.count("*").alias("filing_count"))
    j = headers.join(primary, "cik", "left").join(stats, "cik", "left")
    recent = F.datediff(F.lit(today).cast("date"), F.col("last.filed_date")) <= 548
    return j.select(*headers.columns, F.col("t.ticker").alias("ticker"), F.col("t.exchange").alias("exchange"), F.col("t").isNotNull().alias("is_listed"), F.coalesce(recent, F.lit(False)).alias("is_active"),
        "last_filing_date", F.col("last.filed_date").alias("last_financial_report_date"), F.col("last.form").alias("last_financial_report_form"), F.coalesce("filing_count", F.lit(0).cast("long")).alias("filing_count"))
