"""Identity checks of filings: concept maps per filing, each identity a Column that yields a result or null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finlattice.functions import concepts as K
from finlattice.functions.core import eps_tolerance, tolerance

STATEMENTS = ("BS", "IS", "CF")
RESULT = "struct<statement:string,check_name:string,lhs:double,rhs:double,passed:boolean,detail:string>"


def concept_maps(statements: DataFrame) -> DataFrame:
    """(cik, accession, BS, IS, CF): per filing a map of concept to value as filed, from primary rows without dimensions; of several values the one of the latest period end."""
    rows = statements.where(F.col("is_primary_period") & ~F.col("is_parenthetical") & F.col("segments").isNull() & F.col("statement").isin(*STATEMENTS) & F.col("value").isNotNull())
    one = rows.groupBy("cik", "accession", "statement", "concept").agg(F.max_by("value", "period_end_rounded").alias("value"))
    entry = lambda s: F.map_from_entries(F.filter(F.collect_list(F.when(F.col("statement") == s, F.struct("concept", "value"))), lambda e: e.isNotNull())).alias(s)
    return one.groupBy("cik", "accession").agg(*(entry(s) for s in STATEMENTS))


class Picks(dict):
    """Columns that the identities ask for, by name: each is looked up in its map once and then only referred to."""

    def value(self, m: str, concept: str) -> Column:
        name = f"{m}_{concept}"
        self[name] = F.try_element_at(F.col(m), F.lit(concept))
        return F.col(name)

    def first(self, m: str, names: Sequence[str]) -> Column:
        """struct<name, v> of the first concept that has a value, or null."""
        key = "_".join([m, "first", *names])
        at = lambda c: F.try_element_at(F.col(m), F.lit(c))
        self[key] = F.coalesce(*(F.when(at(c).isNotNull(), F.struct(F.lit(c).alias("name"), at(c).alias("v"))) for c in names))
        return F.col(key)


PICKS = Picks()
value, first = PICKS.value, PICKS.first


def result(statement: str, name: Column | str, lhs: Column, rhs: Column, detail: Column, limit: Column | None = None) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    passed = F.abs(lhs - rhs) <= (tolerance(lhs, rhs) if limit is None else limit)
    r = F.struct(F.lit(statement).alias("statement"), name.alias("check_name"), lhs.alias("lhs"), rhs.alias("rhs"), passed.alias("passed"), detail.alias("detail"))
    return F.when(lhs.isNotNull() & rhs.isNotNull(), r)


def balance_sheet() -> list[Column]:
    assets, whole, equity, temporary = value("BS", "Assets"), first("BS", K.LIABILITIES_AND_EQUITY), first("BS", K.EQUITY_TOTAL), first("BS", K.TEMPORARY_EQUITY)
    minority = F.when(equity["name"] == "StockholdersEquity", value("BS", "MinorityInterest"))
    parts = value("BS", "Liabilities") + equity["v"] + F.coalesce(minority, F.lit(0.0)) + F.coalesce(temporary["v"], F.lit(0.0))
    names = F.concat_ws(" + ", F.lit("Liabilities"), equity["name"], F.when(minority.isNotNull(), "MinorityInterest"), temporary["name"])
    return [
        result("BS", "assets_eq_liabilities_and_equity", assets, whole["v"], F.concat(F.lit("Assets = "), whole["name"])),
        F.when(whole.isNull(), result("BS", "assets_eq_liabilities_plus_equity", assets, parts, F.concat(F.lit("Assets = "), names))),
    ]


#: Pairs of candidate sides by check; each step refers to the column of the step before, so that nothing is worked out twice.
PAIRS: dict[str, Column] = {}


def candidate_pairs(lhs: Column, rhs: Column) -> Column:
    """Of arrays of struct<name, v>, every right side with every left side, in that order."""
    return F.flatten(F.transform(rhs, lambda r: F.transform(lhs, lambda l: F.struct(l.alias("l"), r.alias("r")))))  # noqa: E741


def closing(pairs: str) -> Column:
    """The first pair that closes, else the first."""
    closes = F.filter(pairs, lambda p: F.abs(p["l"]["v"] - p["r"]["v"]) <= tolerance(p["l"]["v"], p["r"]["v"]))
    return F.coalesce(F.get(closes, F.lit(0)), F.get(pairs, F.lit(0)))


def options(*candidates: Column) -> Column:
    return F.filter(F.array(*candidates), lambda c: c["v"].isNotNull())


def option(v: Column, *name: Column | str) -> Column:
    return F.struct(F.concat(*(F.lit(n) if isinstance(n, str) else n for n in name)).alias("name"), v.alias("v"))


def paired(statement: str, name: str, lhs: Column, rhs: Column) -> Column:
    PAIRS[name] = candidate_pairs(lhs, rhs)
    p = F.col(f"{name}_pair")
    return result(statement, name, p["l"]["v"], p["r"]["v"], F.concat(p["l"]["name"], F.lit(" = "), p["r"]["name"]))


def income_after_tax() -> Column:
    pretax, tax, foreign = first("IS", K.PRETAX), first("IS", K.TAX), first("IS", K.FOREIGN_PRETAX)
    foreign = F.when(pretax["name"].endswith("Domestic"), foreign)
    equity = F.when(pretax["name"].contains("IncomeLossFromEquityMethodInvestments"), first("IS", K.EQUITY_METHOD))
    both, both_name = pretax["v"] + foreign["v"], F.concat(pretax["name"], F.lit(" + "), foreign["name"])
    left = options(*(
        option(amount - tax["v"] + extra, label, " - ", tax["name"], more)
        for amount, label in ((both, both_name), (pretax["v"], pretax["name"]))
        for extra, more in ((F.lit(0.0), F.lit("")), (equity["v"], F.concat(F.lit(" + "), equity["name"])))
    ))
    parent, nci, gone = value("IS", "IncomeLossFromContinuingOperations"), first("IS", K.NONCONTROLLING_INCOME), first("IS", K.DISCONTINUED)
    right = [option(value("IS", c), c) for c in K.CONTINUING_ONLY] + [option(parent + nci["v"], "IncomeLossFromContinuingOperations + ", nci["name"])]
    for c in K.TOTAL_INCOME:
        right += [option(value("IS", c) - gone["v"], c, " - ", gone["name"]), option(value("IS", c), c)]
    return paired("IS", "income_after_tax", left, options(*right))


def per_share(kind: str) -> Column:
    stated, shares = (value("IS", c) for c in K.EPS[kind])
    own = first("IS", K.EPS_NUMERATOR if kind == "basic" else tuple(reversed(K.EPS_NUMERATOR)))
    nci, fallback = first("IS", K.NONCONTROLLING_INCOME), first("IS", K.EPS_FALLBACK_NUMERATOR)
    bridged = F.when((fallback["name"] == "ProfitLoss") & nci.isNotNull(), option(fallback["v"] - nci["v"], "ProfitLoss - ", nci["name"])).otherwise(fallback)
    inferred = own.isNull()
    n = F.coalesce(own, F.when(first("IS", K.PREFERRED_DIVIDENDS).isNull(), bridged))
    name = F.concat(F.lit(f"eps_{kind}"), F.when(inferred, "_approx").otherwise(""))
    limit = F.when(inferred, eps_tolerance(stated, 0.05)).otherwise(eps_tolerance(stated))
    detail = F.concat(n["name"], F.lit(f" / {K.EPS[kind][1]} = {K.EPS[kind][0]}"), F.when(inferred, " (numerator inferred)").otherwise(""))
    return result("IS", name, F.try_divide(n["v"], F.nullif(shares, F.lit(0.0))), stated, detail, limit)


def income_statement() -> list[Column]:
    revenue, cost, gross = first("IS", K.REVENUE), first("IS", K.COST_OF_REVENUE), value("IS", "GrossProfit")
    return [
        result("IS", "gross_profit", revenue["v"] - cost["v"], gross, F.concat(revenue["name"], F.lit(" - "), cost["name"], F.lit(" = GrossProfit"))),
        result("IS", "operating_income", gross - value("IS", "OperatingExpenses"), value("IS", "OperatingIncomeLoss"), F.lit("GrossProfit - OperatingExpenses = OperatingIncomeLoss")),
        income_after_tax(), per_share("basic"), per_share("diluted"),
    ]


def cash_flow() -> list[Column]:
    sums = [first("CF", c)["v"] for c in (K.OPERATING_CF, K.INVESTING_CF, K.FINANCING_CF)]
    total, fx = sums[0] + sums[1] + sums[2], first("CF", K.FX_EFFECT)
    with_fx = first("CF", K.NET_CHANGE_WITH_FX)
    target = F.coalesce(with_fx, first("CF", K.NET_CHANGE_WITHOUT_FX))
    a, b = option(total, "ops + investing + financing"), option(total + fx["v"], "ops + investing + financing + fx")
    left = F.when(with_fx.isNotNull(), options(b, a)).otherwise(options(a, b))
    return [paired("CF", "net_change_in_cash", left, options(F.struct(target["name"].alias("name"), target["v"].alias("v"))))]


def across() -> list[Column]:
    """One number filed twice: the same concept on two statements, the first that stands on both."""
    def same(name: str, a: str, b: str, names: Sequence[str]) -> Column:
        return F.coalesce(*(result("XS", name, value(a, c), value(b, c), F.lit(f"{a} = {b} ({c})")) for c in names))

    return [same("net_income_is_equals_cf", "IS", "CF", K.TOTAL_INCOME), same("ending_cash_cf_equals_bs", "CF", "BS", K.CROSS_CASH)]


def run_checks(maps: DataFrame) -> DataFrame:
    """(cik, accession, statement, check_name, passed, lhs, rhs, difference, detail); only checks whose operands all stand."""
    results = [*balance_sheet(), *income_statement(), *cash_flow(), *across()]
    found = F.filter(F.array(*results), lambda r: r.isNotNull())
    picked = maps.withColumns(dict(PICKS)).withColumns({f"{n}_pairs": p for n, p in PAIRS.items()}).withColumns({f"{n}_pair": closing(f"{n}_pairs") for n in PAIRS})
    rows = picked.select("cik", "accession", F.explode(found).alias("r")).select("cik", "accession", "r.*")
    return rows.withColumn("difference", F.col("lhs") - F.col("rhs"))


def filing_checks(statements: DataFrame) -> DataFrame:
    return run_checks(concept_maps(statements))


def with_verdicts(statements: DataFrame, checks: DataFrame) -> DataFrame:
    """statements with checks_passed per filing and statement: null where no check applied."""
    v = checks.groupBy("cik", "accession", "statement").agg(F.bool_and("passed").alias("checks_passed"))
    return statements.drop("checks_passed").join(v, ["cik", "accession", "statement"], "left")


def is_subtotal(concept: str = "concept", label: str = "label", abstract: str = "is_abstract") -> Column:
    return ~F.coalesce(F.col(abstract), F.lit(False)) & F.coalesce(F.col(concept).isin(*K.SUBTOTAL_CONCEPTS) | F.col(label).rlike(K.SUBTOTAL_LABEL), F.lit(False))


def metrics(statements: DataFrame) -> DataFrame:
    """(cik, accession, one column per metric): of each metric's concepts the first that the filing's primary rows have."""
    spark = statements.sparkSession
    table = spark.createDataFrame([(m, s, c, i) for m, (s, names) in K.METRICS.items() for i, c in enumerate(names)], "metric string, statement string, concept string, priority int")
    rows = statements.where(F.col("is_primary_period") & F.col("segments").isNull() & ~F.col("is_parenthetical") & F.col("value").isNotNull()).join(F.broadcast(table), ["statement", "concept"])  # a fixed list
    w = Window.partitionBy("cik", "accession", "metric").orderBy("priority", "line_order")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").groupBy("cik", "accession").pivot("metric", list(K.METRICS)).agg(F.first("value_presented"))
