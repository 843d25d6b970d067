"""Coverage, invariants and serving reads: filing lists, reader sets, releases, company pages, golden companies, touched companies, runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finlattice.functions import core as C
from finlattice.operators.windows import first_per_key


def filings_list(filings: DataFrame, form: str | None = None, since: str | None = None, until: str | None = None, limit: int | None = None) -> DataFrame:
    """Filings of a form and of dates from since to until, both included, newest first. Rows without a date fail a bound."""
    out = filings
    if form is not None:
        out = out.where(F.col("form") == form)
    if since is not None:
        out = out.where(F.col("filed_date") >= F.lit(since).cast("date"))
    if until is not None:
        out = out.where(F.col("filed_date") <= F.lit(until).cast("date"))
    out = out.orderBy(F.desc_nulls_last("filed_date"), F.desc("accession"))
    return out if limit is None else out.limit(limit)


def touched_companies(filings: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """(cik) of the companies with a filing whose form starts with one of the prefixes."""
    starts = F.lit(False)
    for p in prefixes:
        starts = starts | F.startswith("form", F.lit(p))
    return filings.where(starts).select("cik").distinct()


def replace_touched(target: DataFrame, source: DataFrame, keys: Sequence[str], touched: DataFrame) -> DataFrame:
    """target with the rows of touched keys taken from source: an incremental load of what a run has changed. Keys that source lacks go."""
    t = touched.select(*keys).distinct()
    return target.join(t, list(keys), "left_anti").unionByName(source.join(t, list(keys), "left_semi"))


def reader_set(wanted: DataFrame, tickers: DataFrame, companies: DataFrame, filings: DataFrame) -> DataFrame:
    """Each wanted row (row_id, ticker, cik, form, year) with its company and newest tagged filing of the form, and year if given; else an error, never a guess.

    A reused ticker goes to its current owner, then to the primary listing, then to the least company number.
    """
    owner = first_per_key(tickers.withColumn("t", F.upper("ticker")), ["t"], [F.desc_nulls_last("is_current"), F.desc_nulls_last("is_primary"), F.asc("cik")]).select("t", F.col("cik").alias("owner"))
    w = wanted.withColumn("t", F.upper("ticker")).join(owner, "t", "left").withColumn("cik", F.coalesce("cik", "owner")).drop("t", "owner")
    f = filings.where("is_xbrl").select("cik", "form", "accession", "filed_date")
    year_fits = F.col("year").isNull() | (F.year("filed_date") == F.col("year"))
    hit = w.join(f, ["cik", "form"]).where(year_fits).groupBy("row_id").agg(F.max_by(F.struct("accession", "filed_date"), F.struct("filed_date", "accession")).alias("hit"))
    j = w.join(hit, "row_id", "left").join(companies.select("cik", "name"), "cik", "left")
    lost = F.concat(F.lit("no XBRL "), F.col("form"), F.lit(" filing"), F.coalesce(F.concat(F.lit(" filed in "), F.col("year").cast("string")), F.lit("")))
    error = F.when(F.col("cik").isNull(), F.concat(F.lit("ticker "), F.col("ticker"), F.lit(" not in the universe"))).when(F.col("hit").isNull(), lost)
    return j.select("row_id", "cik", "name", "form", F.col("hit.accession").alias("accession"), F.col("hit.filed_date").alias("filed_date"), error.alias("error"))


def release_coverage(periods: DataFrame, newest: int = 8, most_days: int = 90) -> DataFrame:
    """Per company its newest periods, how many have an earnings release, and how many releases lie outside the days after the period's end."""
    p = periods.withColumn("n", F.row_number().over(Window.partitionBy("cik").orderBy(F.desc("period_end"), F.desc("period_label")))).where(F.col("n") <= newest)
    lag = F.datediff("earnings_release_filed_date", "period_end")
    return p.groupBy("cik").agg(F.count("*").alias("periods"), F.count("earnings_release_accession").alias("released"), F.count_if(~lag.between(1, most_days)).alias("odd_lags"), F.max(lag).alias("longest_lag"))


def duration_distribution(facts: DataFrame) -> DataFrame:
    """Facts, companies and concepts by kind of duration."""
    kind = C.duration_kind("period_start", "period_end")
    return facts.groupBy(kind.alias("duration_kind")).agg(F.count("*").alias("facts"), F.count_distinct("cik").alias("companies"), F.count_distinct("concept").alias("concepts"))


def company_pages(companies: DataFrame, tickers: DataFrame, filings: DataFrame, periods: DataFrame) -> DataFrame:
    """One row a company: its header, tickers in listing order, latest filing and period, and when the next report is due (the usual lag after the next quarter's end)."""
    t = tickers.groupBy("cik").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "ticker"))), lambda x: x["ticker"]).alias("tickers"))
    f = filings.groupBy("cik").agg(F.max_by(F.struct("accession", "form", "filed_date"), F.struct("filed_date", "accession")).alias("latest"), F.count("*").alias("filings"))
    lag = F.datediff("results_filed_date", "period_end")
    p = periods.groupBy("cik").agg(F.max("period_end").alias("last_period_end"), F.percentile(lag, F.lit(0.5)).alias("usual_lag"))
    due = F.date_add(F.last_day(F.add_months("last_period_end", 3)), F.ceil("usual_lag").cast("int"))
    j = companies.join(t, "cik", "left").join(f, "cik", "left").join(p, "cik", "left")
    return j.select("cik", "name", F.coalesce("tickers", F.array().cast("array<string>")).alias("tickers"), F.col("latest.accession").alias("latest_accession"), F.col("latest.form").alias("latest_form"), F.coalesce("filings", F.lit(0).cast("long")).alias("filings"), "last_period_end", due.alias("next_expected"))


#: A period's label (fixed format).
LABEL = r"^(FY\d{4}|Q[1-3] \d{4})T?$"


def golden_companies(wanted: DataFrame, periods: DataFrame, lines: DataFrame, newest: int = 20) -> DataFrame:
    """(cik, passed, reason): the first invariant that a company breaks over its newest periods, in the order a reader would look.

    wanted: (cik); lines: (accession, statement, n) of primary statement lines. Checks: periods exist, labels are well formed and distinct, an annual
    one is among them, each has a results filing, and the newest one's filing has an income statement and a balance sheet, with its checks passed.
    """
    p = periods.withColumn("k", F.row_number().over(Window.partitionBy("cik").orderBy(F.desc("period_end"), F.desc("period_label")))).where(F.col("k") <= newest)
    g = p.groupBy("cik").agg(
        F.count("*").alias("n"), F.count_if(~F.col("period_label").rlike(LABEL)).alias("malformed"), F.count_distinct("period_label").alias("labels"), F.count_if(F.col("fiscal_quarter") == 4).alias("annual"),
        F.count_if(F.col("results_accession").isNull()).alias("unfiled"), F.min_by("results_accession", "k").alias("accession"), F.count_if(~F.coalesce("checks_passed", F.lit(True))).alias("failed"),
    )
    have = lines.where("n > 0").groupBy("accession").agg(F.collect_set("statement").alias("have"))
    j = wanted.join(g, "cik", "left").join(have, "accession", "left")
    shows = lambda s: F.coalesce(F.array_contains("have", s), F.lit(False))
    reason = (
        F.when(F.col("n").isNull(), "no periods").when(F.col("malformed") > 0, "malformed period labels").when(F.col("labels") < F.col("n"), "duplicate period labels").when(F.col("annual") == 0, "no annual period")
        .when(F.col("unfiled") > 0, "periods with no results filing").when(~shows("IS"), "no income statement").when(~shows("BS"), "no balance sheet").when(F.col("failed") > 0, "arithmetic checks failed")
    )
    return j.select("cik", reason.isNull().alias("passed"), reason.alias("reason"))


def seeded_sample(rows: DataFrame, keys: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """n rows as a seed picks them: the same ones on any cluster, as the order is a hash of the keys."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def run_row(kind: str, run_id: str, started: Column, failures: DataFrame, filings: DataFrame) -> DataFrame:
    """One run_log row: what a run has found, and its failures in order."""
    f = failures.agg(F.array_sort(F.collect_list("failure")).alias("failures"))
    n = filings.agg(F.count("*").alias("new_filings"), F.array_sort(F.collect_set(F.col("filed_date").cast("string"))).alias("index_dates"))
    one = f.crossJoin(n)  # one row each
    status = F.when(F.size("failures") == 0, "ok").otherwise("partial")
    return one.select(F.lit(run_id).alias("run_id"), F.lit(kind).alias("kind"), started.alias("started_at"), F.current_timestamp().cast("timestamp_ntz").alias("finished_at"), status.alias("status"), "index_dates", "new_filings", "failures", F.lit(None).cast("string").alias("error"))


def pending_quarters(published: DataFrame, load_log: DataFrame, required: Sequence[str]) -> DataFrame:
    """Quarters that are out but not loaded whole: some required file has no log row, or lost rows. What a crash has left is pending again."""
    whole = load_log.where(F.col("loaded_rows") + F.col("rejected_rows") >= F.col("raw_rows")).where(F.col("table").isin(*required)).groupBy("quarter").agg(F.count_distinct("table").alias("k"))
    return published.join(whole, "quarter", "left").where(F.coalesce("k", F.lit(0)) < len(required)).select("quarter")


def rerank_candidates(spans: DataFrame, question: Sequence[str], limit: int) -> DataFrame:
    """Spans to rerank, in order: the opening span of each version first, then the rest by words shared with the question.

    spans: (span_id, version_id, start_offset, words array<string>).
    """
    words = [w for w in dict.fromkeys(question) if w not in STOP]
    s = spans.withColumn("shared", F.size(F.array_intersect("words", F.array(*map(F.lit, words)).cast("array<string>"))))
    covers = s.groupBy("version_id").agg(F.min(F.struct("start_offset", "span_id")).alias("c")).select(F.col("c.span_id").alias("span_id"), F.col("c.start_offset").alias("at"), "version_id")
    first = covers.orderBy("at", "version_id").limit(limit).select("span_id", F.lit(0).alias("round"), F.col("at").alias("k"), F.col("version_id").cast("string").alias("tie"))
    rest = s.join(first.select("span_id"), "span_id", "left_anti").orderBy(F.desc("shared"), "span_id").limit(limit)
    both = first.unionByName(rest.select("span_id", F.lit(1).alias("round"), (-F.col("shared")).cast("long").alias("k"), F.lpad(F.col("span_id").cast("string"), 20, "0").alias("tie")))
    return both.orderBy("round", "k", "tie").limit(limit).select("span_id", "round")


#: Words that no overlap counts (fixed values).
STOP = {"the", "a", "an", "of", "is", "in", "and", "or", "to", "for", "what", "does", "this", "it", "by"}
