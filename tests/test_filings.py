"""Checks, period spine, statement builder, derivation and holdings on named small cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from finlattice.operators import checks, grid, holdings, periods, statements
from finlattice.sources.schemas import TABLES, empty

D = dt.date


def maps(spark, bs=None, is_=None, cf=None):
    kind = "map<string,double>"
    f = lambda m: {k: float(v) for k, v in (m or {}).items()}
    return spark.createDataFrame([(1, "a", f(bs), f(is_), f(cf))], f"cik long, accession string, BS {kind}, IS {kind}, CF {kind}")


def run(spark, **m):
    return {r.check_name: r for r in checks.run_checks(maps(spark, **m)).collect()}


PRETAX = "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest"


def test_balance_sheet(spark):
    got = run(spark, bs={"Assets": 100, "LiabilitiesAndStockholdersEquity": 100, "Liabilities": 1, "StockholdersEquity": 1})
    assert set(got) == {"assets_eq_liabilities_and_equity"} and got["assets_eq_liabilities_and_equity"].passed
    got = run(spark, bs={"Assets": 1000, "Liabilities": 600, "StockholdersEquity": 300, "MinorityInterest": 100})
    assert got["assets_eq_liabilities_plus_equity"].passed and got["assets_eq_liabilities_plus_equity"].detail == "Assets = Liabilities + StockholdersEquity + MinorityInterest"
    got = run(spark, bs={"Assets": 1000, "Liabilities": 600, "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest": 400, "MinorityInterest": 100})
    assert got["assets_eq_liabilities_plus_equity"].passed
    assert run(spark, bs={"Liabilities": 5}) == {}


def test_income_statement(spark):
    got = run(spark, is_={"Revenues": 1000, "CostOfRevenue": 400, "GrossProfit": 600, "OperatingExpenses": 100, "OperatingIncomeLoss": 300})
    assert got["gross_profit"].passed and not got["operating_income"].passed and got["operating_income"].difference == 200


@pytest.mark.parametrize("values, passed, detail", [
    ({PRETAX: 100, "IncomeTaxExpenseBenefit": 20, "ProfitLoss": 80}, True, f"{PRETAX} - IncomeTaxExpenseBenefit = ProfitLoss"),
    ({PRETAX: 100, "IncomeTaxExpenseBenefit": 20, "ProfitLoss": 90, "IncomeLossFromDiscontinuedOperationsNetOfTax": 10}, True, f"{PRETAX} - IncomeTaxExpenseBenefit = ProfitLoss - IncomeLossFromDiscontinuedOperationsNetOfTax"),
    ({PRETAX: 100, "IncomeTaxExpenseBenefit": 20, "IncomeLossFromContinuingOperations": 70, "NetIncomeLossAttributableToNoncontrollingInterest": 10}, True, f"{PRETAX} - IncomeTaxExpenseBenefit = IncomeLossFromContinuingOperations + NetIncomeLossAttributableToNoncontrollingInterest"),
    ({"IncomeLossFromContinuingOperationsBeforeIncomeTaxesDomestic": 60, "IncomeLossFromContinuingOperationsBeforeIncomeTaxesForeign": 40, "IncomeTaxExpenseBenefit": 20, "NetIncomeLoss": 80}, True, "IncomeLossFromContinuingOperationsBeforeIncomeTaxesDomestic + IncomeLossFromContinuingOperationsBeforeIncomeTaxesForeign - IncomeTaxExpenseBenefit = NetIncomeLoss"),
    ({PRETAX: 100, "IncomeTaxExpenseBenefit": 20, "ProfitLoss": 50, "NetIncomeLoss": 40}, False, f"{PRETAX} - IncomeTaxExpenseBenefit = ProfitLoss"),
])
def test_income_after_tax(spark, values, passed, detail):
    r = run(spark, is_=values)["income_after_tax"]
    assert (r.passed, r.detail) == (passed, detail)


def test_earnings_per_share(spark):
    shares = {"EarningsPerShareBasic": 1.0, "WeightedAverageNumberOfSharesOutstandingBasic": 100}
    assert run(spark, is_=shares | {"NetIncomeLossAvailableToCommonStockholdersBasic": 100.5})["eps_basic"].passed
    assert run(spark, is_=shares | {"NetIncomeLoss": 104})["eps_basic_approx"].passed
    assert run(spark, is_=shares | {"ProfitLoss": 120, "NetIncomeLossAttributableToNoncontrollingInterest": 20})["eps_basic_approx"].passed
    assert run(spark, is_=shares | {"NetIncomeLoss": 100, "DividendsPreferred": 1}) == {}
    assert run(spark, is_=shares | {"NetIncomeLoss": 100, "WeightedAverageNumberOfSharesOutstandingBasic": 0}) == {}
    both = {"EarningsPerShareDiluted": 1.1, "WeightedAverageNumberOfDilutedSharesOutstanding": 100, "NetIncomeLossAvailableToCommonStockholdersBasic": 100, "NetIncomeLossAvailableToCommonStockholdersDiluted": 110}
    assert run(spark, is_=both)["eps_diluted"].passed


def test_cash_flow_reads_the_effect_both_ways(spark):
    flows = {"NetCashProvidedByUsedInOperatingActivities": 1000, "NetCashProvidedByUsedInInvestingActivities": -300, "NetCashProvidedByUsedInFinancingActivities": -200, "EffectOfExchangeRateOnCashAndCashEquivalents": 50}
    r = run(spark, cf=flows | {"CashAndCashEquivalentsPeriodIncreaseDecrease": 550})["net_change_in_cash"]
    assert r.passed and r.detail.startswith("ops + investing + financing + fx")
    assert run(spark, cf=flows | {"CashAndCashEquivalentsPeriodIncreaseDecrease": 500})["net_change_in_cash"].passed
    r = run(spark, cf=flows | {"CashAndCashEquivalentsPeriodIncreaseDecreaseExcludingExchangeRateEffect": 900})["net_change_in_cash"]
    assert not r.passed and r.lhs == 500


def test_across_statements_compare_like_with_like(spark):
    got = run(spark, is_={"NetIncomeLoss": 10}, cf={"ProfitLoss": 12, "NetIncomeLoss": 10, "CashAndCashEquivalentsAtCarryingValue": 5}, bs={"CashAndCashEquivalentsAtCarryingValue": 500})
    assert got["net_income_is_equals_cf"].passed and not got["ending_cash_cf_equals_bs"].passed and got["ending_cash_cf_equals_bs"].statement == "XS"


FILINGS = [
    ("a24", "10-K", D(2024, 11, 1), D(2024, 9, 28), []), ("q1", "10-Q", D(2024, 2, 2), D(2023, 12, 30), []), ("q2", "10-Q", D(2024, 5, 3), D(2024, 3, 30), []), ("q2a", "10-Q/A", D(2024, 6, 3), D(2024, 3, 30), []),
    ("e2", "8-K", D(2024, 5, 2), None, ["2.02", "9.01"]), ("e2b", "8-K", D(2024, 5, 20), None, ["2.02"]), ("e0", "8-K", D(2024, 3, 30), None, ["2.02"]), ("q25", "10-Q", D(2025, 2, 1), D(2024, 12, 28), []),
]


def spine(spark, fye="0930"):
    f = spark.createDataFrame([(1, *x) for x in FILINGS], "cik long, accession string, form string, filed_date date, report_date date, items array<string>")
    return {r.period_label: r for r in periods.period_spine(f, spark.createDataFrame([(1, fye)], "cik long, fiscal_year_end string")).collect()}


def test_period_spine(spark):
    got = spine(spark)
    assert set(got) == {"FY2024", "Q1 2024", "Q2 2024", "Q1 2025"}
    assert got["Q1 2024"].label_method == "anchor" and got["Q1 2025"].label_method == "nominal_fye" and got["FY2024"].label_method == "period_end"
    q2 = got["Q2 2024"]
    assert q2.results_accession == "q2" and q2.amendment_accessions == ["q2a"] and q2.earnings_release_accession == "e2" and got["FY2024"].period_type == "annual"


def test_facts_keep_companies_apart(spark):
    rows = [(1, "us-gaap", "A", "USD", None, D(2024, 3, 31), 1.0, "x", D(2024, 5, 1)), (1, "us-gaap", "A", "USD", None, D(2024, 3, 31), 2.0, "y", D(2024, 8, 1)), (2, "us-gaap", "A", "USD", None, D(2024, 3, 31), 3.0, "z", None)]
    f = spark.createDataFrame(rows, "cik long, taxonomy string, concept string, unit string, period_start date, period_end date, value double, accession string, filed date")
    assert sorted(r.accession for r in periods.finalize_facts(f).where("is_current").collect()) == ["y", "z"]


def quarter_tables(spark):
    sub = spark.createDataFrame([("f", 1, "10-K", D(2024, 9, 28), "FY", D(2024, 11, 1))], "adsh string, cik long, form string, period date, fp string, filed date")
    num = [("Assets", D(2024, 9, 30), 0, "USD", None, 100.0), ("Assets", D(2023, 9, 30), 0, "USD", None, 90.0), ("Revenues", D(2024, 9, 30), 4, "USD", None, 50.0), ("Revenues", D(2024, 9, 30), 1, "USD", None, 12.0), ("Revenues", D(2024, 9, 30), 4, "USD", "Seg=A;", 20.0),
           ("Cash", D(2024, 9, 30), 0, "USD", None, 7.0), ("Cash", D(2023, 9, 30), 0, "USD", None, 6.0), ("Cost", D(2024, 9, 30), 4, "USD", "Seg=A;", 9.0), ("Eps", D(2024, 9, 30), 4, "USD", None, 1.5), ("Revenues", D(2024, 9, 30), 4, "EUR", None, 45.0), ("Gone", D(2024, 9, 30), 1, "USD", None, 1.0)]
    n = spark.createDataFrame([("f", t, "us-gaap/2024", d, q, u, s, None, v) for t, d, q, u, s, v in num], "adsh string, tag string, version string, ddate date, qtrs int, uom string, segments string, coreg string, value double")
    pre = [(2, 1, "BS", "Assets", 0), (4, 1, "IS", "Revenues", 0), (4, 2, "IS", "Cost", 1), (4, 3, "IS", "Eps", 0), (4, 4, "IS", "GrossProfit", 0), (6, 1, "CF", "Cash", 0), (6, 9, "CF", "Cash", 0), (4, 5, "IS", "Gone", 0), (4, 6, None, "Bad", 0)]
    p = spark.createDataFrame([("f", r, line, s, 0, t, "us-gaap/2024", t, neg) for r, line, s, t, neg in pre], "adsh string, report int, line int, stmt string, inpth int, tag string, version string, plabel string, negating int")
    tag = [("Assets", "I", "monetary"), ("Revenues", "D", "monetary"), ("Cost", "D", "monetary"), ("Eps", "D", "perShare"), ("Cash", "I", "monetary"), ("GrossProfit", "D", "monetary"), ("Gone", "D", "monetary")]
    t = spark.createDataFrame([(x, "us-gaap/2024", 0, 0, d, i, None, x) for x, i, d in tag] + [("Assets", "us-gaap/2024", 0, None, "monetary", "I", None, "a")], "tag string, version string, custom int, abstract int, datatype string, iord string, crdr string, tlabel string")
    return sub, n, p, t


def test_statement_builder(spark):
    got = statements.build_statements(*quarter_tables(spark), quarter="2024q4").collect()
    by = lambda c: [r for r in got if r.concept == c]
    revenue = by("Revenues")
    assert [(r.value, r.unit, r.qtrs, r.is_primary_period) for r in revenue] == [(50.0, "USD", 4, True)]
    assert {(r.value, r.is_primary_period) for r in by("Assets")} == {(100.0, True), (90.0, False)}
    assert by("Cost")[0].segments == "Seg=A;" and by("Cost")[0].value_presented == -9.0 and by("Eps")[0].unit == "USD/shares"
    cash = sorted((r.line, r.value) for r in by("Cash") if r.is_primary_period)
    assert cash == [(1, 6.0), (9, 7.0)]
    empty_lines = [r.concept for r in got if r.value is None]
    assert sorted(empty_lines) == ["Gone", "GrossProfit"] and all(r.is_primary_period for r in got if r.value is None)
    assert by("Cost")[0].parent_concept == "GrossProfit" and by("Gone")[0].parent_concept is None and by("Revenues")[0].parent_concept == "GrossProfit"
    per_line = {}
    for r in got:
        if r.is_primary_period:
            per_line[r.statement, r.report, r.line, r.segments] = per_line.get((r.statement, r.report, r.line, r.segments), 0) + 1
    assert set(per_line.values()) == {1}


def test_checks_over_built_rows_and_metrics(spark):
    rows = statements.build_statements(*quarter_tables(spark))
    assert checks.filing_checks(rows).count() == 0
    assert {r.checks_passed for r in checks.with_verdicts(rows, checks.filing_checks(rows)).collect()} == {None}
    m = checks.metrics(rows).first()
    assert m.revenue == 50.0 and m.total_assets == 100.0 and m.net_income is None


def test_provisional_follows_the_last_filing(spark):
    rows = statements.build_statements(*quarter_tables(spark))
    filing = spark.createDataFrame([(1, "new", "10-K", D(2025, 11, 1), D(2025, 9, 27))], "cik long, accession string, form string, filed_date date, report_date date")
    facts = spark.createDataFrame([(1, "new", "Revenues", "USD", D(2024, 9, 29), D(2025, 9, 27), 70.0), (1, "new", "Revenues", "USD", D(2025, 6, 29), D(2025, 9, 27), 20.0), (1, "new", "Other", "USD", None, D(2025, 9, 27), 1.0)], "cik long, accession string, concept string, unit string, period_start date, period_end date, value double")
    got = {r.concept: r.value for r in statements.provisional(rows, filing, facts).collect()}
    assert got["Revenues"] == 70.0 and got["GrossProfit"] is None and got["Other"] == 1.0


def test_provisional_places_extras_and_pairs_balances(spark):
    rows = statements.build_statements(*quarter_tables(spark))
    filing = spark.createDataFrame([(1, "new", "10-K", D(2025, 11, 1), D(2025, 9, 27))], "cik long, accession string, form string, filed_date date, report_date date")
    fact = [("Cash", None, D(2023, 9, 30), 5.0), ("Cash", None, D(2024, 9, 28), 6.0), ("Cash", None, D(2025, 9, 27), 7.0), ("ProceedsFromLoans", D(2024, 9, 29), D(2025, 9, 27), 3.0), ("OddAsset", None, D(2025, 9, 27), 4.0), ("OddAsset", None, D(2024, 9, 28), 2.0), ("OtherComprehensiveIncomeX", D(2024, 9, 29), D(2025, 9, 27), 8.0)]
    facts = spark.createDataFrame([(1, "new", c, "USD", a, b, v) for c, a, b, v in fact], "cik long, accession string, concept string, unit string, period_start date, period_end date, value double")
    got = statements.provisional(rows, filing, facts).collect()
    cash = sorted((r.line_order, r.value) for r in got if r.concept == "Cash")
    assert [v for _, v in cash] == [6.0, 7.0]  # the opening line takes the older of the last two balances
    extra = {r.concept: r for r in got if r.concept in ("ProceedsFromLoans", "OddAsset", "OtherComprehensiveIncomeX")}
    assert {c: (r.statement, r.value) for c, r in extra.items()} == {"ProceedsFromLoans": ("CF", 3.0), "OddAsset": ("BS", 4.0), "OtherComprehensiveIncomeX": ("CI", 8.0)}
    assert all(r.line_order > max((x.line_order for x in got if x.statement == r.statement and x.concept not in extra), default=0) for r in extra.values())


def cells(spark, *rows):
    full = [(1, r.get("statement", "CF"), r.get("concept", "X"), r.get("concept", "X"), r["fy"], r["n"], r["d"], float(r["v"]), r.get("unit", "USD"), "us-gaap", r.get("start", D(r["fy"], 1, 1)), r.get("end", D(r["fy"], 3 * r["n"], 28)), f"a{r['fy']}{r['n']}", r.get("neg", False)) for r in rows]
    return spark.createDataFrame(full, "cik long, statement string, line_key string, concept string, fiscal_year int, n int, duration int, value double, unit string, taxonomy string, start date, end date, accession string, negating boolean")


def test_quarters(spark):
    c = cells(spark, {"fy": 2024, "n": 1, "d": 1, "v": 10}, {"fy": 2024, "n": 2, "d": 2, "v": 25}, {"fy": 2024, "n": 3, "d": 3, "v": 45}, {"fy": 2024, "n": 3, "d": 1, "v": 19}, {"fy": 2024, "n": 4, "d": 4, "v": 70})
    got = {r.n: r for r in grid.quarters(c).collect()}
    assert [(got[n].value, got[n].status) for n in (1, 2, 3, 4)] == [(10, "reported"), (15, "derived"), (19, "reported"), (25, "derived")]
    assert [(s.accession, s.coefficient) for s in got[4].sources] == [("a20244", 1.0), ("a20243", -1.0)]


@pytest.mark.parametrize("first, second, reason", [
    ({}, {"unit": "EUR"}, "units differ"), ({"start": D(2024, 1, 2)}, {}, "the periods start apart"), ({"start": None}, {"start": None}, "a period's start is unknown"), ({"neg": True}, {}, "sign conventions differ"),
    ({"end": D(2024, 7, 1)}, {}, "the periods don't follow one another"), ({"unit": "USD/shares"}, {"unit": "USD/shares"}, "per-share values don't add up"), ({"statement": "BS"}, {"statement": "BS"}, "statement is not a flow"),
    ({"concept": "AverageRate"}, {"concept": "AverageRate"}, "averages and ratios don't add up"),
])
def test_quarter_refusals(spark, first, second, reason):
    got = {r.n: r for r in grid.quarters(cells(spark, {"fy": 2024, "n": 1, "d": 1, "v": 10} | first, {"fy": 2024, "n": 2, "d": 2, "v": 25} | second)).collect()}
    assert got[2].value is None and got[2].reason == reason and got[2].sources == []


def test_missing_filing_and_trailing_year(spark):
    got = {r.n: r for r in grid.quarters(cells(spark, {"fy": 2024, "n": 2, "d": 2, "v": 25})).collect()}
    assert got[2].reason == "no value before it"
    c = cells(spark, {"fy": 2023, "n": 2, "d": 2, "v": 30}, {"fy": 2023, "n": 4, "d": 4, "v": 100, "end": D(2023, 12, 31)}, {"fy": 2024, "n": 2, "d": 2, "v": 45})
    got = {(r.fiscal_year, r.n): r for r in grid.trailing_year(c).collect()}
    assert got[2024, 2].value == 115 and got[2023, 4].status == "reported" and got[2023, 2].reason == "no fiscal year before it"
    apart = cells(spark, {"fy": 2023, "n": 2, "d": 2, "v": 30}, {"fy": 2023, "n": 4, "d": 4, "v": 100, "end": D(2023, 12, 30)}, {"fy": 2024, "n": 2, "d": 2, "v": 45})
    assert {(r.fiscal_year, r.n): r.reason for r in grid.trailing_year(apart).collect()}[2024, 2] == "the years don't meet"


def test_line_order_keeps_the_newest_and_inserts_after_predecessors(spark):
    rows = [("new", "a", 1), ("new", "c", 2), ("new", "d", 3), ("old", "a", 1), ("old", "b", 2), ("old", "d", 3), ("old", "z", 4)]
    filed = {"new": D(2024, 1, 1), "old": D(2023, 1, 1)}
    df = spark.createDataFrame([(1, "IS", k, o, filed[f]) for f, k, o in rows], "cik long, statement string, line_key string, line_order int, filed date")
    assert [r.line_key for r in grid.merge_order(df).orderBy("position").collect()] == ["a", "b", "c", "d", "z"]


def test_latest_presentation_and_snapshot(spark):
    rows = [(1, "IS", "x", D(2023, 12, 31), 4, D(2024, 2, 1), "a", 10.0, "USD"), (1, "IS", "x", D(2023, 12, 31), 4, D(2025, 2, 1), "b", 11.0, "USD"), (1, "IS", "y", D(2023, 12, 31), 4, D(2024, 2, 1), "a", 5.0, "USD"), (1, "IS", "y", D(2023, 12, 31), 4, D(2025, 2, 1), "b", 5.0, "EUR")]
    df = spark.createDataFrame(rows, "cik long, statement string, line_key string, period_end date, qtrs int, filed date, accession string, value double, unit string")
    got = {(r.line_key, r.accession): r for r in grid.latest_presentation(df).collect()}
    assert got["x", "a"].latest == 11.0 and got["x", "a"].status == "restated" and got["y", "a"].latest == 5.0 and "another unit" in got["y", "a"].reason and got["x", "b"].status == "as_filed"
    assert grid.snapshot(df).first().hash == grid.snapshot(df.orderBy(F.rand(1))).first().hash != grid.snapshot(df.where("accession = 'a'")).first().hash


def test_as_of_comes_first(spark):
    rows = spark.createDataFrame([("a", 1, "IS", 1, False, "R", "R", D(2024, 3, 31), 1, 5.0, True, D(2024, 5, 1))], "accession string, cik long, statement string, line_order int, is_parenthetical boolean, concept string, label string, period_end date, qtrs int, value double, is_primary_period boolean, filed_date date")
    p = spark.createDataFrame([(1, 2024, 1, "a", D(2024, 5, 1))], "cik long, fiscal_year int, fiscal_quarter int, results_accession string, results_filed_date date")
    at = lambda d: grid.reported_cells(rows, p, F.lit(d).cast("date")).count()
    assert at("2024-05-01") == 1 and at("2024-04-30") == 0 and grid.reported_cells(rows, p.withColumn("results_filed_date", F.lit(None).cast("date")), F.lit("2025-01-01").cast("date")).count() == 0


def test_institution_cards(spark):
    q1, q2 = D(2024, 3, 31), D(2024, 6, 30)
    f = [("m", q1, False), ("m", q2, False), ("u", q1, False), ("u", q2, True), ("n", q2, False)]
    h = [("m", q1, "a", 5), ("m", q2, "a", 7), ("m", q1, "b", 5), ("m", q2, "c", 1), ("m", q1, "d", 4), ("m", q2, "d", 4), ("u", q2, "a", 1), ("n", q2, "a", 1)]
    got = {(r.manager, r.cusip): r.summary for r in holdings.institution_cards(spark.createDataFrame(h, "manager string, period date, cusip string, shares int"), spark.createDataFrame(f, "manager string, period date, uncertain boolean")).collect()}
    assert got == {("m", "a"): "Increased", ("m", "b"): "No longer reported", ("m", "c"): "Newly reported", ("m", "d"): "Unchanged", ("u", "a"): "Amendment or confidential omission", ("n", "a"): "First observed"}
    m = spark.createDataFrame([("abc", 1), ("ABC ", 1), ("xyz", 1), ("xyz", 2)], "cusip string, cik long")
    assert [tuple(r) for r in holdings.mapped_issuers(m).collect()] == [("ABC", 1)]


def test_every_schema_parses(spark):
    assert all(empty(spark, t).count() == 0 for t in TABLES)
