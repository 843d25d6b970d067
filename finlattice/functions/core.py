"""Column functions of the filings domain; none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Cell = Column | str


def col(c: Cell) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_end_round(d: Cell) -> Column:
    """Month end nearest a 52/53-week year's close: up to the 15th the month before, else this month."""
    d = col(d)
    return F.when(F.dayofmonth(d) <= 15, F.date_sub(d, F.dayofmonth(d))).otherwise(F.last_day(d))


def expected_quarters(period: Cell, form: Cell) -> Column:
    """Durations in quarters that a filing of this fiscal period states as its own; null where any may stand."""
    p, annual = col(period), col(form).rlike("^(10-K|20-F|40-F)")
    listed = lambda *q: F.array(*map(F.lit, q))
    return F.when((p == "FY") | annual, listed(4)).when(p == "Q1", listed(1)).when(p == "Q2", listed(1, 2)).when(p == "Q3", listed(1, 3))


def quarters_estimate(start: Cell, end: Cell) -> Column:
    """0 for an instant, else the days in 91-day quarters, at least 1."""
    return F.when(col(start).isNull(), 0).otherwise(F.greatest(F.lit(1), F.round(F.datediff(col(end), col(start)) / 91).cast("int")))


def duration_kind(start: Cell, end: Cell) -> Column:
    days = F.datediff(col(end), col(start)) + 1
    return (
        F.when(col(start).isNull(), "instant").when(days.between(80, 100), "quarter").when(days.between(170, 190), "half")
        .when(days.between(260, 280), "nine_months").when(days.between(350, 380), "year").otherwise("other")
    )


def opening_period(period: Cell, quarters: Cell) -> Column:
    return F.last_day(F.add_months(col(period), -3 * F.coalesce(col(quarters), F.lit(4))))


def inferred_start(end: Cell, quarters: Cell) -> Column:
    return F.add_months(F.trunc(col(end), "MM"), -(3 * col(quarters) - 1))


def presented(value: Cell, negating: Cell) -> Column:
    return F.when(col(negating), -col(value)).otherwise(col(value))


def per_share_unit(unit: Cell, datatype: Cell) -> Column:
    """USD becomes USD/shares where the concept's datatype is per share."""
    u = col(unit)
    return F.when(u.rlike("^[A-Z]{3}$") & F.lower(col(datatype)).contains("pershare"), F.concat(u, F.lit("/shares"))).otherwise(u)


def currency(unit: Cell) -> Column:
    return F.regexp_extract(col(unit), "^([A-Z]{3})(/shares)?$", 1)


def base_form(form: Cell) -> Column:
    return F.split(col(form), "/")[0]


def is_amendment(form: Cell) -> Column:
    return F.coalesce(col(form).endswith("/A"), F.lit(False))


def form_family(form: Cell) -> Column:
    f = base_form(form)
    return F.when(f.rlike("^(10-K|10-KT|20-F|40-F)"), "annual").when(f.rlike("^10-Q"), "quarterly").when(f == "8-K", "current").otherwise("other")


def is_results_filing(form: Cell, items: Cell) -> Column:
    return F.coalesce(form_family(form).isin("annual", "quarterly") | (base_form(form).isin("8-K") & F.exists(col(items), lambda i: i.like("2.02%"))), F.lit(False))


def months_apart(later: Cell, earlier: Cell) -> Column:
    """Whole months of 30.4375 days, rounded; not the calendar's months."""
    return F.round(F.datediff(col(later), col(earlier)) / 30.4375).cast("int")


def quarter_of_months(months: Cell) -> Column:
    m = col(months)
    return F.when(m == 0, 4).when(m == 3, 3).when(m == 6, 2).when(m == 9, 1)


def safe_date(year: Cell, month: Cell, day: Cell) -> Column:
    """The date, with the day clamped to the month's last; null for a month that isn't one."""
    first = F.make_date(col(year), F.when(col(month).between(1, 12), col(month)), F.lit(1))
    return F.date_add(first, F.least(col(day), F.dayofmonth(F.last_day(first))) - 1)


def year_end_after(d: Cell, month: Cell, day: Cell) -> Column:
    """The first nominal fiscal year end on or after d, with 14 days' drift."""
    y = F.year(col(d))
    ends = [safe_date(y + k, month, day) for k in (0, 1, 2)]
    late = F.date_sub(col(d), 14)
    return F.when(ends[0] >= late, ends[0]).when(ends[1] >= late, ends[1]).otherwise(ends[2])


def fiscal_year_of(d: Cell, month: Cell, day: Cell) -> Column:
    """The year whose nominal end lies within 14 days of d, tried as the year before, its own, the next; else d's own year."""
    y = F.year(col(d))
    out = F.lit(None).cast("int")
    for k in (1, 0, -1):
        out = F.when(F.abs(F.datediff(col(d), safe_date(y + k, month, day))) <= 14, y + k).otherwise(out)
    return F.coalesce(out, y)


def period_label(year: Cell, quarter: Cell, transition: Cell | None = None) -> Column:
    label = F.when(col(quarter) == 4, F.concat(F.lit("FY"), col(year))).otherwise(F.concat(F.lit("Q"), col(quarter), F.lit(" "), col(year)))
    return label if transition is None else F.concat(label, F.when(col(transition), "T").otherwise(""))


def tolerance(lhs: Cell, rhs: Cell, relative: float = 0.005, absolute: float = 1.0) -> Column:
    return F.greatest(F.lit(absolute), relative * F.greatest(F.abs(col(lhs)), F.abs(col(rhs))))


def eps_tolerance(stated: Cell, relative: float = 0.01, absolute: float = 0.01) -> Column:
    return F.greatest(F.lit(absolute), relative * F.abs(col(stated)))


def finite(c: Cell) -> Column:
    """Null for what a database column can't hold."""
    return F.when(~(F.isnan(col(c)) | (F.abs(col(c)) == float("inf"))), col(c))


def percent_change(change: Cell, after: Cell) -> Column:
    """Percent of the balance before the change, 4 places; null where that can't be known or isn't positive."""
    before = col(after) - col(change)
    return F.when((before > 0) & (col(after) >= 0), F.round(col(change) * 100 / before, 4))


def previous_quarter(period: Cell) -> Column:
    p = col(period)
    return F.when((p == F.last_day(p)) & F.month(p).isin(3, 6, 9, 12), F.last_day(F.add_months(p, -3)))


def holdings_value(value: Cell, filed: Cell) -> Column:
    """Values were reported in thousands before 2023-01-03."""
    return F.when(col(filed) < F.lit("2023-01-03").cast("date"), col(value) * 1000).otherwise(col(value))


def valid_cusip(c: Cell) -> Column:
    return F.coalesce(F.upper(F.trim(col(c))).rlike("^[0-9A-Z*@#]{9}$"), F.lit(False))


def valid_accession(c: Cell) -> Column:
    return F.coalesce(col(c).rlike(r"^\d{10}-\d{2}-\d{6}$"), F.lit(False))


def padded_cik(c: Cell) -> Column:
    return F.lpad(col(c).cast("string"), 10, "0")


def schedule_form(form: Cell) -> Column:
    return F.regexp_replace(F.upper(F.trim(col(form))), r"^SC 13([DG])", "SCHEDULE 13$1")


def dimension_text(pairs: Cell) -> Column:
    """Axis=Member; for each of an array of (axis, member), in order of axis."""
    return F.array_join(F.transform(F.array_sort(col(pairs)), lambda p: F.concat(p["axis"], F.lit("="), p["member"], F.lit(";"))), "")


def preferred_label(labels: Cell, role: Cell) -> Column:
    """The label of the preferred role, else the standard one, else the terse one."""
    pick = lambda k: F.try_element_at(col(labels), k)
    return F.coalesce(pick(col(role)), pick(F.lit("label")), pick(F.lit("terseLabel")))


def tokens(text: Cell) -> Column:
    """Lower-case runs of letters, marks and digits."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"[\p{L}\p{N}\p{M}]+"), 0)


def snippet(text: Cell, term: Cell, before: int = 120, after: int = 260) -> Column:
    """What stands around the first occurrence of term, case aside; the beginning where it has none."""
    t = col(text)
    at = F.instr(F.lower(t), F.lower(col(term)))
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substring(t, start, at - start + after)).otherwise(F.substring(t, 1, before + after))


def headline_preset(sic: Cell) -> Column:
    s = col(sic).cast("string")
    return F.when(s.rlike("^60|^61"), "bank").when(s.rlike("^63|^64"), "insurer").when(s.startswith("6798"), "reit").otherwise("general")


def additive_reason(statement: Cell, unit: Cell, concept: Cell, quarters: Cell) -> Column:
    """Why a line can't be derived by adding or subtracting periods; null where it can. The first reason that holds counts."""
    c = col(concept)
    return (
        F.when(~col(statement).isin("IS", "CF", "CI"), "statement is not a flow")
        .when(col(unit).contains("/"), "per-share values don't add up")
        .when(~col(unit).rlike("^[A-Z]{3}$"), "unit is not money")
        .when(c.rlike("(?i)average|ratio|percent|rate"), "averages and ratios don't add up")
        .when(col(quarters) == 0, "an instant has no duration")
    )


def display_scale(unit: Cell, magnitude: Cell) -> Column:
    """Only money is shown in thousands or millions."""
    m = F.abs(col(magnitude))
    return F.when(~col(unit).rlike("^[A-Z]{3}$"), 1).when(m >= 1e9, 1_000_000).when(m >= 1e6, 1_000).otherwise(1)


def adds_up(parts: Cell, total: Cell) -> Column:
    return F.abs(col(parts) - col(total)) <= 1 + 1e-6 * F.abs(col(total))
