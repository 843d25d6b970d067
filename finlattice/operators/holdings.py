"""Institutional positions quarter over quarter, and insider series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finlattice.functions.core import previous_quarter


def institution_cards(holdings: DataFrame, filings: DataFrame) -> DataFrame:
    """(manager, cusip, period, shares, prior_shares, summary) for each manager's latest quarter.

    holdings: (manager, period, cusip, shares), any number of rows each; filings: (manager, period, uncertain), one row a filing. A comparison is
    made only where both quarters have exactly one filing and neither is uncertain.
    """
    f = filings.groupBy("manager", "period").agg(F.count("*").alias("filings"), F.bool_or("uncertain").alias("uncertain"))
    latest = f.withColumn("n", F.row_number().over(Window.partitionBy("manager").orderBy(F.desc("period")))).where("n = 1").select("manager", "period", "filings", "uncertain", previous_quarter("period").alias("before"))
    prior = f.select("manager", F.col("period").alias("before"), F.col("filings").alias("prior_filings"), F.col("uncertain").alias("prior_uncertain"))
    m = latest.join(prior, ["manager", "before"], "left")
    h = holdings.groupBy("manager", "period", "cusip").agg(F.sum("shares").alias("shares"), F.count("*").alias("rows"))
    now = m.select("manager", "period").join(h, ["manager", "period"]).select("manager", "cusip", "shares", "rows")
    old = m.select("manager", F.col("before").alias("period")).join(h, ["manager", "period"]).select("manager", "cusip", F.col("shares").alias("prior_shares"), F.col("rows").alias("prior_rows"))
    j = now.join(old, ["manager", "cusip"], "full_outer").join(m, "manager")
    safe = (F.col("filings") == 1) & ~F.col("uncertain") & (F.coalesce("prior_filings", F.lit(0)) == 1) & ~F.coalesce("prior_uncertain", F.lit(True))
    held, had = F.col("shares").isNotNull(), F.col("prior_shares").isNotNull()
    several = (F.coalesce("rows", F.lit(0)) > 1) | (F.coalesce("prior_rows", F.lit(0)) > 1)
    summary = (
        F.when(~held, F.when(safe & had, "No longer reported").otherwise("Current position unknown"))
        .when(F.col("uncertain") | (F.col("filings") > 1), "Amendment or confidential omission").when(several, "Several rows, not combined")
        .when(held & had & safe, F.when(F.col("shares") > F.col("prior_shares"), "Increased").when(F.col("shares") < F.col("prior_shares"), "Reduced").otherwise("Unchanged"))
        .when(~had & F.col("prior_filings").isNotNull(), F.when(safe, "Newly reported").otherwise("Newly reported, baseline uncertain")).otherwise("First observed")
    )
    return j.select("manager", "cusip", "period", "shares", "prior_shares", summary.alias("summary"))


def insider_series(transactions: DataFrame, points: int = 50) -> DataFrame:
    """Per (issuer, owner, security, form of ownership) the last balances by day; days whose filings disagree are dropped."""
    key = ["issuer", "owner", "security", "ownership"]
    d = transactions.groupBy(*key, "day").agg(F.count_distinct("balance").alias("k"), F.max("balance").alias("balance")).where("k = 1")
    return d.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("day")))).where(F.col("n") <= points).drop("n", "k")


def mapped_issuers(mapping: DataFrame) -> DataFrame:
    """(cusip, cik) where sources agree; a CUSIP that they map to several companies is refused."""
    return mapping.groupBy(F.upper(F.trim("cusip")).alias("cusip")).agg(F.count_distinct("cik").alias("k"), F.max("cik").alias("cik")).where("k = 1").drop("k")


def ingested(stored: DataFrame, arrived: DataFrame, key: str = "filing", at: str = "arrived_at") -> DataFrame:
    """Versions of filings (key, content_hash, at, first, is_current, revised) after an arrival that may repeat old ones.

    A content that is known stays as it is, so loading twice changes nothing, and an old version that comes again doesn't become current; a source
    whose content has changed is flagged revised. The current version is the one that was first seen last, ties to the greater hash.
    """
    both = stored.select(key, "content_hash", at).unionByName(arrived.select(key, "content_hash", at))
    seen = both.groupBy(key, "content_hash").agg(F.min(at).alias("first"))
    w = Window.partitionBy(key)
    newest = F.row_number().over(w.orderBy(F.desc("first"), F.desc("content_hash"))) == 1
    return seen.select("*", newest.alias("is_current"), (F.count("*").over(w) > 1).alias("revised"))


def event_cards(events: DataFrame) -> DataFrame:
    """One card a disclosure of (filing, issuer, form, event_date, filed_date, people array<struct<name, shares, percent>>): who reports and what each of them states.

    Each person's figures stand for themselves: shares of a group are never added up.
    """
    who = F.array_join(F.transform("people", lambda p: F.coalesce(p["name"], F.lit("Unnamed reporting person"))), "; ")
    metric = lambda p, f, label, unit: F.when(p[f].isNotNull(), F.concat(F.coalesce(p["name"], F.lit("Reporting person")), F.lit(f": {label} "), p[f].cast("string"), F.lit(unit)))
    each = F.flatten(F.transform("people", lambda p: F.array(metric(p, "shares", "shares", ""), metric(p, "percent", "percent", "%"))))
    people = F.coalesce("people", F.array().cast(dict(events.dtypes)["people"]))
    badge = F.when(F.col("form").rlike("/A$"), "Amendment").otherwise("Disclosed beneficial ownership")
    return events.withColumn("people", people).select(
        "filing", "issuer", F.when(F.size("people") > 0, who).otherwise("Reporting persons unavailable").alias("name"), F.coalesce("event_date", "filed_date").alias("date"), badge.alias("badge"), F.array_compact(each).alias("metrics")
    )


def notification_events(filings: DataFrame, positions: DataFrame, mapping: DataFrame, followed: DataFrame, since: Column) -> DataFrame:
    """(cik, filing, form, filed_date) since a date of followed companies: filings about them, and managers' filings that hold a security mapped to them."""
    f = filings.where(F.col("filed_date") >= since)
    about = f.join(followed.select(F.col("cik").alias("issuer")).distinct(), "issuer", "left_semi").select(F.col("issuer").alias("cik"), "filing", "form", "filed_date")
    held = positions.join(mapping.select("cusip", "cik"), "cusip").join(followed.select("cik").distinct(), "cik", "left_semi").select("cik", "filing").distinct()
    return about.unionByName(held.join(f.where("issuer IS NULL").select("filing", "form", "filed_date"), "filing").select("cik", "filing", "form", "filed_date")).distinct()


def ownership_coverage(states: DataFrame, positions: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row: filings by state, the last success, and positions whose security no mapping knows."""
    s = states.agg(
        *(F.count_if(F.col("status") == x).alias(x) for x in ("parsed", "pending", "failed", "unsupported")), F.max("last_successful_at").alias("last_successful_at"), F.count_if(F.col("issuer").isNull() & (F.col("status") != "parsed")).alias("unassigned"))
    unmatched = positions.join(mapping.select("cusip").distinct(), "cusip", "left_anti").agg(F.count("*").alias("unmatched_positions"))
    return s.crossJoin(unmatched)  # one row each


def sync_queue(registered: DataFrame, states: DataFrame, limit: int, attempts: int = 3) -> DataFrame:
    """Filings to process next, at most `limit`: those never tried by date, then failures with attempts left, least tried first."""
    j = registered.join(states.select("filing", "status", "tries"), "filing", "left")
    open_ = F.col("status").isNull() | (F.col("status") == "pending") | ((F.col("status") == "failed") & (F.col("tries") < attempts))
    return j.where(open_).orderBy(F.coalesce("tries", F.lit(0)), "filed_date", "filing").limit(limit).select("filing", F.coalesce("tries", F.lit(0)).alias("tries"))
