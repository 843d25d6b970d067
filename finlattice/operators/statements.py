"""As-reported statements from the quarterly data sets: one function a step, all keyed by filing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finlattice.functions import core as C
from finlattice.operators.checks import is_subtotal
from finlattice.operators.windows import first_per_key, next_flagged, totals_else_breakdown


def lines(pre: DataFrame, sub: DataFrame, tag: DataFrame) -> DataFrame:
    """Presented lines of each filing with its period and the concept's traits; one tag row per (tag, version)."""
    s = sub.select("adsh", "cik", "form", "period", "fp", F.col("filed").alias("filed_date"))
    t = first_per_key(tag, ["tag", "version"], [F.desc_nulls_last("abstract"), F.asc_nulls_last("tlabel")]).select("tag", "version", "custom", "abstract", "datatype", "iord", "crdr", "tlabel")
    p = pre.where(F.col("stmt").isNotNull() & F.col("line").isNotNull()).join(s, "adsh").join(t, ["tag", "version"], "left")
    return p.withColumn("filing_period", C.month_end_round("period"))


def valued(p: DataFrame, num: DataFrame) -> DataFrame:
    """Lines with their numbers: totals where a concept has any, else its breakdown by dimension; per-share units restored."""
    n = num.where("coreg IS NULL").select("adsh", "tag", "version", "ddate", "qtrs", "uom", "segments", "value")
    n = totals_else_breakdown(n, ["adsh", "tag", "version"], F.col("segments").isNull())
    j = p.join(n, ["adsh", "tag", "version"], "left")
    return j.withColumn("unit", C.per_share_unit("uom", "datatype")).withColumn("expected", C.expected_quarters("fp", "form"))


def one_currency(b: DataFrame) -> DataFrame:
    """Of several currencies in a filing the one of most concepts, then rows, then US dollars, then the alphabet; other units pass."""
    b = b.withColumn("currency", F.nullif(C.currency("unit"), F.lit("")))
    votes = b.where("currency IS NOT NULL").groupBy("adsh", "currency").agg(F.count_distinct("tag").alias("tags"), F.count("*").alias("n"))
    chosen = first_per_key(votes, ["adsh"], [F.desc("tags"), F.desc("n"), F.desc(F.col("currency") == "USD"), F.asc("currency")]).select("adsh", F.col("currency").alias("elected"))
    return b.join(chosen, "adsh", "left").where(F.col("currency").isNull() | (F.col("currency") == F.col("elected"))).drop("currency", "elected")


def keep(b: DataFrame) -> DataFrame:
    """Values whose duration the concept and the filing's period ask for. A line that loses all of them stays once, empty."""
    instant, listed = F.col("qtrs") == 0, F.coalesce(F.array_contains("expected", F.col("qtrs")), F.lit(True))
    by_type = F.when(F.col("iord") == "I", instant).when(F.col("iord") == "D", (F.col("qtrs") > 0) & listed).when(F.col("stmt") == "BS", instant).otherwise(instant | listed)
    kept = one_currency(b.where(F.col("ddate").isNull() | by_type))
    line = ["adsh", "stmt", "report", "line"]
    blank = b.drop("ddate", "qtrs", "uom", "unit", "segments", "value").dropDuplicates(line).join(kept.select(*line).distinct(), line, "left_anti")
    return kept.unionByName(blank, allowMissingColumns=True)


def paired(k: DataFrame) -> DataFrame:
    """line_order, the filing's own duration, and which value is the primary one: opening balances look back to where the period began."""
    group = ["adsh", "stmt", "inpth"]
    k = k.withColumn("period_end_rounded", C.month_end_round("ddate")).withColumn("line_order", F.dense_rank().over(Window.partitionBy(*group).orderBy("report", "line", F.asc_nulls_first("segments"))))
    own = F.when((F.col("qtrs") > 0) & (F.col("period_end_rounded") == F.col("filing_period")), F.col("qtrs"))
    k = k.withColumn("primary_qtrs", F.min(own).over(Window.partitionBy("adsh", "stmt")))
    instant = F.col("qtrs") == 0
    concept = Window.partitionBy(*group, "tag", "version", "segments")
    repeats = F.size(F.collect_set(F.when(instant, F.col("line_order"))).over(concept))
    nth = F.dense_rank().over(Window.partitionBy(*group, "tag", "version", "segments", instant).orderBy("line_order"))
    opening = (repeats > 1) & (nth == 1)
    k = k.withColumn("opening", F.coalesce(instant & opening, F.lit(False)))
    at = F.when(F.col("opening"), C.opening_period("filing_period", "primary_qtrs")).otherwise(F.col("filing_period"))
    primary = F.when(F.col("ddate").isNull(), True).when(instant, F.col("period_end_rounded") == at).otherwise((F.col("period_end_rounded") == F.col("filing_period")) & (F.col("qtrs") == F.col("primary_qtrs")))
    return k.withColumn("is_primary_period", F.coalesce(primary, F.lit(False)))


def with_parents(k: DataFrame) -> DataFrame:
    """parent_concept: the next subtotal strictly below a line. A positional hint, never an operand of a check."""
    k = k.withColumn("is_abstract", F.coalesce(F.col("abstract") == "1", F.lit(False)) if dict(k.dtypes)["abstract"] == "string" else F.coalesce(F.col("abstract").cast("boolean"), F.lit(False)))
    k = k.withColumn("is_subtotal", is_subtotal("tag", "plabel"))
    line = k.select("adsh", "stmt", "inpth", "line_order", "tag", "is_subtotal").groupBy("adsh", "stmt", "inpth", "line_order").agg(F.first("tag").alias("tag"), F.max("is_subtotal").alias("is_subtotal"))
    parent = next_flagged(line, ["adsh", "stmt", "inpth"], ["line_order"], F.col("is_subtotal"), "tag", "parent_concept").select("adsh", "stmt", "inpth", "line_order", "parent_concept")
    return k.join(parent, ["adsh", "stmt", "inpth", "line_order"], "left")


def exact_periods(facts: DataFrame) -> DataFrame:
    """One (start, end) per filing, concept, rounded end and duration, to put exact dates on rounded ones."""
    f = facts.select("cik", "accession", "concept", "period_start", "period_end", C.month_end_round("period_end").alias("period_end_rounded"), C.quarters_estimate("period_start", "period_end").alias("qtrs"))
    return first_per_key(f, ["cik", "accession", "concept", "period_end_rounded", "qtrs"], [F.desc("period_end"), F.asc_nulls_last("period_start")])


def build_statements(sub: DataFrame, num: DataFrame, pre: DataFrame, tag: DataFrame, facts: DataFrame | None = None, quarter: str | None = None) -> DataFrame:
    """Statement rows of a quarterly data set, one per line, period and dimension."""
    k = with_parents(paired(keep(valued(lines(pre, sub, tag), num))))
    out = k.select(
        F.col("adsh").alias("accession"), "cik", F.col("stmt").alias("statement"), "report", "line", "line_order", F.coalesce(F.col("inpth").cast("boolean"), F.lit(False)).alias("is_parenthetical"),
        F.col("tag").alias("concept"), F.split("version", "/")[0].alias("taxonomy"), "segments", F.col("plabel").alias("label"), F.col("tlabel").alias("standard_label"),
        F.coalesce(F.col("negating").cast("boolean"), F.lit(False)).alias("negating"), "is_abstract", F.coalesce(F.col("custom").cast("boolean"), F.lit(False)).alias("is_custom"), "iord", "crdr", "datatype",
        "period_end_rounded", F.col("qtrs").cast("int").alias("qtrs"), "unit", "value", "is_primary_period", "is_subtotal", "parent_concept", F.lit("fsds").alias("source"), F.lit(quarter).alias("fsds_quarter"), "form", "filed_date",
    )
    out = out.withColumn("value_presented", C.presented("value", "negating"))
    inferred = F.when(F.col("qtrs") > 0, C.inferred_start("period_end_rounded", "qtrs"))
    if facts is None:
        return out.withColumn("period_start", inferred).withColumn("period_end", F.col("period_end_rounded"))
    key = ["cik", "accession", "concept", "period_end_rounded", "qtrs"]
    j = out.join(exact_periods(facts), key, "left")
    return j.withColumn("period_start", F.coalesce("period_start", inferred)).withColumn("period_end", F.coalesce("period_end", "period_end_rounded"))


# Beginnings of concepts that say which statement they belong to, fixed values.
COMPREHENSIVE = ("OtherComprehensiveIncome", "ComprehensiveIncome")
EQUITY = ("StockIssuedDuringPeriod", "StockRepurchasedDuringPeriod", "StockRepurchasedAndRetired", "TreasuryStockValueAcquired", "Dividends", "AdjustmentsToAdditionalPaidInCapital", "StockholdersEquityOther", "CumulativeEffectOfNewAccountingPrinciple")
CASH_FLOW = (
    "NetCashProvidedByUsedIn", "PaymentsTo", "PaymentsFor", "PaymentsOf", "ProceedsFrom", "RepaymentsOf", "IncreaseDecreaseIn", "CashAndCashEquivalentsPeriodIncreaseDecrease", "CashCashEquivalentsRestrictedCash", "EffectOfExchangeRate",
    "ShareBasedCompensation", "DepreciationDepletionAndAmortization", "DepreciationAndAmortization", "DeferredIncomeTaxExpenseBenefit", "OtherNoncash", "IncomeTaxesPaid", "InterestPaid", "GainLossOnSaleOf", "GainLossOnDisposition",
)


def statement_of(concept: str, instant: Column) -> Column:
    """The statement that a concept without a presented line is put on: by how its name begins, else the balance sheet for instants and the income statement for the rest."""
    begins = lambda names: F.col(concept).rlike("^(" + "|".join(names) + ")")
    return (
        F.when((F.col(concept) == "DepreciationDepletionAndAmortization") & ~instant, "IS").when(begins(COMPREHENSIVE), "CI").when(begins(EQUITY), "EQ")
        .when(begins(CASH_FLOW), "CF").when(instant, "BS").otherwise("IS")
    )


def provisional(template: DataFrame, filing: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of a filing that the data sets don't have yet: the lines of its company's last filing of the family, with this filing's own facts.

    template: statement rows of earlier filings; filing: (cik, accession, form, filed_date, report_date). Where a statement shows a concept on several
    lines, as opening and closing balances, its instants go to them in order of time, the newest to the last line. Facts of the filing's period whose concept no line
    asks for follow at the end of the statement that statement_of() names; nothing that was filed is left out.
    """
    f = filing.withColumn("family", C.form_family("form"))
    line = ["family", "statement", "report", "line", "line_order", "is_parenthetical", "concept", "taxonomy", "segments", "label", "negating", "is_abstract", "is_subtotal", "parent_concept", "iord", "datatype"]
    earlier = template.withColumn("family", C.form_family("form")).where("is_primary_period").select("cik", F.col("accession").alias("from"), F.col("filed_date").alias("from_date"), *line)
    pairs = f.join(earlier.select("cik", "family", "from", "from_date").distinct(), ["cik", "family"]).where("from_date < filed_date")
    last = first_per_key(pairs, ["cik", "accession"], [F.desc("from_date"), F.desc("from")])
    shape = last.join(earlier.drop("from_date"), ["cik", "family", "from"])
    key = ["cik", "accession", "concept"]
    own = facts.select(*key, "unit", "period_start", "period_end", "value", C.quarters_estimate("period_start", "period_end").alias("qtrs"))
    instants = own.where("qtrs = 0").withColumn("nth", F.dense_rank().over(Window.partitionBy(*key).orderBy("period_end")))
    instants = instants.withColumn("instants", F.max("nth").over(Window.partitionBy(*key)))
    group = ["cik", "accession", "statement", "is_parenthetical", "concept"]
    shape = shape.withColumn("lines", F.count("*").over(Window.partitionBy(*group))).withColumn("seen", F.row_number().over(Window.partitionBy(*group).orderBy("line_order")))
    shape = shape.join(instants.select(*key, "instants").distinct(), key, "left")
    several = (F.col("lines") > 1) & ~F.col("is_abstract") & (F.coalesce("instants", F.lit(0)) >= F.col("lines"))
    quarters = F.when(F.col("family") == "annual", 4).otherwise(1)
    at = (C.month_end_round("period_end") == C.month_end_round("report_date")) & ((F.col("qtrs") == 0) | (F.col("qtrs") == quarters))
    paired_lines = shape.where(several).drop("instants").join(instants, key).where(F.col("nth") == F.col("instants") - F.col("lines") + F.col("seen")).drop("nth", "instants")
    plain = shape.where(~several).drop("instants").join(own, key, "left").where(F.col("value").isNull() | at)
    extras = own.join(last.join(f.select("cik", "accession"), ["cik", "accession"]), ["cik", "accession"]).where(at).join(shape.select(*key).distinct(), key, "left_anti")
    extras = extras.withColumn("statement", statement_of("concept", F.col("qtrs") == 0))
    after = shape.where("NOT is_parenthetical").groupBy("cik", "accession", "statement").agg(F.max("line_order").alias("__end"))
    extras = extras.join(after, ["cik", "accession", "statement"], "left").withColumn("line_order", F.coalesce("__end", F.lit(0)) + F.dense_rank().over(Window.partitionBy("cik", "accession", "statement").orderBy("concept")))
    extras = extras.select("*", F.lit(False).alias("is_parenthetical"), F.col("concept").alias("label"), F.lit(False).alias("negating"), F.lit(False).alias("is_abstract")).drop("__end", "from_date")
    j = paired_lines.unionByName(plain).drop("lines", "seen", "from_date").unionByName(extras, allowMissingColumns=True)
    return j.withColumn("value_presented", C.presented("value", "negating")).withColumn("is_primary_period", F.lit(True)).withColumn("source", F.lit("provisional")).drop("from", "family", "report_date")
