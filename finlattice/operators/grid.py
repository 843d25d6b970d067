"""Statement grids in long form: line keys, quarterly and trailing-year derivation with reasons, latest presentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finlattice.functions import core as C
from finlattice.operators.windows import occurrence_suffix

CELL = "struct<value:double,status:string,reason:string,sources:array<struct<accession:string,coefficient:double,value:double>>>"


def line_keys(rows: DataFrame) -> DataFrame:
    """line_key: concept and label, with #n for repeats of the pair within a filing's statement."""
    keyed = rows.withColumn("pair", F.concat_ws("|", "concept", "label"))
    return occurrence_suffix(keyed, ["cik", "accession", "statement", "period_end", "qtrs"], "pair", [F.asc("line_order")]).drop("pair")


def reported_cells(rows: DataFrame, periods: DataFrame, as_of: Column | None = None) -> DataFrame:
    """(cik, statement, line_key, fiscal_year, fiscal_quarter, qtrs, value, unit, ...): each period's own filing. The cut-off comes first; a filing without a date fails it."""
    p = periods.where(F.col("results_filed_date").isNotNull() & (F.col("results_filed_date") <= as_of)) if as_of is not None else periods
    own = p.select("cik", "fiscal_year", F.col("fiscal_quarter").cast("int").alias("fiscal_quarter"), F.col("results_accession").alias("accession"), F.col("results_filed_date").alias("filed"))
    return line_keys(rows.where("is_primary_period AND NOT is_parenthetical")).drop("filed_date").join(own, ["cik", "accession"])


def latest_presentation(cells: DataFrame) -> DataFrame:
    """Each cell's value as the newest later filing that shows the same period states it; a unit that differs keeps the original, with the reason."""
    w = Window.partitionBy("cik", "statement", "line_key", "period_end", "qtrs")
    best = F.max(F.struct("filed", "accession", "value", "unit")).over(w)
    later = best["filed"] > F.col("filed")
    same_unit = best["unit"].eqNullSafe(F.col("unit"))
    return cells.withColumn("latest", F.when(later & same_unit, best["value"]).otherwise(F.col("value"))).withColumn("status", F.when(later & same_unit & ~best["value"].eqNullSafe(F.col("value")), "restated").otherwise("as_filed")).withColumn(
        "reason", F.when(later & ~same_unit, "a later filing states it in another unit"))


def aligned_keys(rows: DataFrame) -> DataFrame:
    """line_key as the newest filing labels the concept, for concepts that drift in label alone.

    A concept is aligned if no filing states it twice for a period, all its rows share one taxonomy and one unit (neither missing), and its
    line keys differ; the newest filing's key, by date and accession, then stands for all. Others keep their own.
    """
    concept = Window.partitionBy("cik", "statement", "concept")
    once = Window.partitionBy("cik", "statement", "concept", "accession", "period_end", "qtrs")
    r = rows.withColumn("__n", F.count("*").over(once)).withColumn("__sign", F.struct(F.split("taxonomy", "/")[0].alias("t"), F.col("unit").alias("u")))
    sound = (F.max("__n").over(concept) == 1) & (F.min("__sign").over(concept) == F.max("__sign").over(concept)) & (F.count_if(F.col("taxonomy").isNull() | F.col("unit").isNull()).over(concept) == 0)
    newest = F.max(F.struct("filed", "accession", "line_key")).over(concept)["line_key"]
    return r.withColumn("aligned_key", F.when(sound, newest).otherwise(F.col("line_key"))).drop("__n", "__sign")


def opening_balances(instants: DataFrame, mode: str = "quarterly") -> DataFrame:
    """Opening balances that fit a derived period: the closing balance of the period before it.

    instants: closing balances (cik, statement, line_key, fiscal_year, n, value). A quarter opens with the quarter before it, a trailing year
    (mode ltm) with the same quarter of the year before, or with the last year's end if it ends one itself. Without that period the balance is refused.
    """
    keys = ["cik", "statement", "line_key", "fiscal_year", "n"]
    if mode == "quarterly":
        year, n = F.when(F.col("n") == 4, F.col("fiscal_year") + 1).otherwise(F.col("fiscal_year")), F.when(F.col("n") == 4, 1).otherwise(F.col("n") + 1)
    else:
        year, n = F.col("fiscal_year") + 1, F.col("n")
    before = instants.select("cik", "statement", "line_key", year.alias("fiscal_year"), n.alias("n"), F.col("value").alias("opening"))
    j = instants.select(*keys).join(before, keys, "left")
    return j.select(*keys, "opening", F.when(F.col("opening").isNull(), "the opening balance for this period is unavailable").alias("reason"))


def same_basis(originals: DataFrame, comparatives: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, usable, reason): whether last year's figure, as this year's filing restates it for comparison, still is what the original said.

    A trailing year mixes last year's annual total with its year to date; if the later filing changed the latter, no common basis is known.
    """
    c = comparatives.select(*keys, F.col(value).alias("__later"))
    j = originals.select(*keys, F.col(value).alias("__first")).join(c, keys, "full_outer")
    changed = F.col("__first").isNotNull() & F.col("__later").isNotNull() & (F.col("__first") != F.col("__later"))
    return j.select(*keys, F.coalesce("__later", "__first").alias(value), F.when(changed, "the later comparative changed").alias("reason"))


def formula(sources: Column) -> Column:
    """A derived cell's sources as a formula: + and - of each filing's value."""
    sign = lambda s: F.when(s["coefficient"] < 0, " - ").otherwise(" + ")
    whole = F.array_join(F.transform(sources, lambda s: F.concat(sign(s), s["accession"], F.lit(":"), s["value"].cast("decimal(30,2)").cast("string"))), "")
    return F.regexp_replace(whole, r"^ \+ ", "")


def _source(prefix: str, sign: float) -> Column:
    return F.struct(F.col(f"{prefix}_accession").alias("accession"), F.lit(sign).alias("coefficient"), F.col(f"{prefix}_value").alias("value"))


def _renamed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, *(F.col(c).alias(f"{prefix}_{c}") for c in ("value", "unit", "taxonomy", "start", "end", "accession", "negating")))


def refusal(a: str, b: str, statement: str = "statement") -> Column:
    """Why a minus b isn't a value, the first reason that holds: a missing operand, its dates, unit, taxonomy, kind of concept, sign convention."""
    x, y = (lambda c: F.col(f"{a}_{c}")), (lambda c: F.col(f"{b}_{c}"))
    return (
        F.when(x("value").isNull(), "no value to date").when(y("value").isNull(), "no value before it")
        .when(x("start").isNull() | y("start").isNull(), "a period's start is unknown").when(x("start") != y("start"), "the periods start apart").when(x("end") <= y("end"), "the periods don't follow one another")
        .when(~x("unit").eqNullSafe(y("unit")), "units differ").when(x("taxonomy") != y("taxonomy"), "taxonomies differ")
        .when(C.additive_reason(statement, F.col(f"{a}_unit"), "concept", F.lit(1)).isNotNull(), C.additive_reason(statement, F.col(f"{a}_unit"), "concept", F.lit(1)))
        .when(~x("negating").eqNullSafe(y("negating")), "sign conventions differ")
    )


def quarters(cells: DataFrame) -> DataFrame:
    """Quarter values: the one-quarter value as filed, else year to date less the year to date before, else a reason.

    cells: (cik, statement, line_key, concept, fiscal_year, n, duration, value, unit, taxonomy, start, end, accession, negating), one row a year-to-date or quarter value (duration in quarters).
    """
    keys = ["cik", "statement", "line_key", "concept", "fiscal_year", "n"]
    direct = _renamed(cells.where("duration = 1"), "q", keys)
    to_date = cells.where("duration = n")
    now, before = _renamed(to_date, "y", keys), _renamed(to_date.withColumn("n", F.col("n") + 1), "b", keys)
    j = cells.select(*keys).distinct().join(direct, keys, "left").join(now, keys, "left").join(before, keys, "left")
    why = F.when(F.col("n") == 1, "no value to date").otherwise(refusal("y", "b"))
    reported = F.col("q_value").isNotNull()
    derived = ~reported & why.isNull()
    return j.select(
        *keys, F.when(reported, F.col("q_value")).when(derived, F.col("y_value") - F.col("b_value")).alias("value"),
        F.when(reported, "reported").when(derived, "derived").otherwise("unavailable").alias("status"), F.when(~reported & ~derived, why).alias("reason"),
        F.when(reported, F.array(_source("q", 1.0))).when(derived, F.array(_source("y", 1.0), _source("b", -1.0))).otherwise(F.array()).alias("sources"),
    )


def trailing_year(cells: DataFrame, comparatives: DataFrame | None = None) -> DataFrame:
    """Trailing twelve months: year to date plus the last fiscal year less its own year to date, which must meet to the day.

    comparatives: last year's year-to-date values as this year's filings show them (the keys of the year they are shown in, value); one that differs from
    the original refuses the cell, as the two years then have no basis in common.
    """
    keys = ["cik", "statement", "line_key", "concept", "fiscal_year", "n"]
    to_date = cells.where("duration = n")
    year = to_date.where("n = 4").withColumn("fiscal_year", F.col("fiscal_year") + 1).drop("n")
    now, full = _renamed(to_date, "y", keys), _renamed(year, "f", keys[:-1])
    prior = _renamed(to_date.withColumn("fiscal_year", F.col("fiscal_year") + 1), "p", keys)
    j = now.join(full, keys[:-1], "left").join(prior, keys, "left")
    changed = F.lit(False)
    if comparatives is not None:
        originals = to_date.withColumn("fiscal_year", F.col("fiscal_year") + 1).select(*keys, "value")
        j = j.join(same_basis(originals, comparatives, keys).select(*keys, F.col("reason").alias("__basis")), keys, "left")
        changed = F.col("__basis").isNotNull()
    own = F.col("n") == 4
    why = (
        F.when(changed, "the later comparative changed").when(F.col("f_value").isNull(), "no fiscal year before it").when(F.col("p_value").isNull(), "no year to date before it")
        .when(F.datediff("y_start", "f_end") != 1, "the years don't meet").when(~F.col("y_unit").eqNullSafe(F.col("f_unit")) | ~F.col("y_unit").eqNullSafe(F.col("p_unit")), "units differ")
        .otherwise(F.coalesce(refusal("f", "p"), C.additive_reason("statement", "y_unit", "concept", F.lit(1))))
    )
    derived = ~own & why.isNull()
    return j.select(
        *keys, F.when(own, F.col("y_value")).when(derived, F.col("y_value") + F.col("f_value") - F.col("p_value")).alias("value"),
        F.when(own, "reported").when(derived, "derived").otherwise("unavailable").alias("status"), F.when(~own & ~derived, why).alias("reason"),
        F.when(own, F.array(_source("y", 1.0))).when(derived, F.array(_source("y", 1.0), _source("f", 1.0), _source("p", -1.0))).otherwise(F.array()).alias("sources"),
    )


def snapshot(grid: DataFrame) -> DataFrame:
    """(cik, hash): a fingerprint of a company's cells that doesn't depend on their order."""
    cell = F.to_json(F.struct(*sorted(grid.columns)))
    return grid.groupBy("cik").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2(cell, 256))), ","), 256).alias("hash"))


def merge_order(rows: DataFrame) -> DataFrame:
    """(cik, statement, line_key, position): lines of all filings in one order, the newest filing's first; an older filing's own lines stand after what they followed there.

    Where a line goes depends on those placed before it, so each statement of a company is merged in one call; it has as many rows as lines.
    """
    import pandas as pd

    from finlattice.session import ship_package

    ship_package(rows.sparkSession)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        following: dict[str | None, str | None] = {None: None}  # a linked list that starts after None
        for _, filing in sorted(pdf.groupby("filed"), key=lambda g: g[0], reverse=True):
            before = None
            for key in filing.sort_values(["line_order", "line_key"])["line_key"].drop_duplicates():
                if key not in following:
                    following[before], following[key] = key, following[before]
                before = key
        order, key = [], None
        while (key := following[key]) is not None:
            order.append(key)
        first = pdf.iloc[0]
        return pd.DataFrame({"cik": first["cik"], "statement": first["statement"], "line_key": order, "position": range(len(order))})

    slim = rows.select("cik", "statement", "line_key", "line_order", F.col("filed").cast("string").alias("filed")).distinct()
    return slim.groupBy("cik", "statement").applyInPandas(merge, "cik bigint, statement string, line_key string, position int")
