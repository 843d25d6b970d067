"""Fiscal periods, quarterly and trailing-year derivation, grids and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finlattice.functions import core as C
from finlattice.operators import windows as W
from finlattice.plans.registry import Tables, query

DAY = "CAST(o_orderdate AS DATE)"


@query("month_end_round", f"""SELECT o_orderkey, CASE WHEN day(d) <= 15 THEN CAST(date_trunc('month', d) AS DATE) - 1 ELSE last_day(d) END AS rounded,
  CASE WHEN days BETWEEN 80 AND 100 THEN 'quarter' WHEN days BETWEEN 170 AND 190 THEN 'half' WHEN days BETWEEN 260 AND 280 THEN 'nine_months' WHEN days BETWEEN 350 AND 380 THEN 'year' ELSE 'other' END AS kind,
  CAST(greatest(1, round((days - 1) / 91.0)) AS INTEGER) AS quarters, last_day(CAST(last_day(d) - INTERVAL 6 MONTH AS DATE)) AS opening, CAST(date_trunc('month', d) - INTERVAL 5 MONTH AS DATE) AS inferred_start
FROM (SELECT o_orderkey, {DAY} AS d, date_diff('day', DATE '1994-12-31', {DAY}) % 400 + 1 AS days FROM orders)""")
def month_end_round(t):
    d = t.orders.withColumn("d", F.col("o_orderdate").cast("date"))
    start = F.date_sub("d", F.datediff("d", F.lit("1994-12-31").cast("date")) % 400)
    d = d.withColumn("s", start)
    return d.select("o_orderkey", C.month_end_round("d").alias("rounded"), C.duration_kind("s", "d").alias("kind"), C.quarters_estimate("s", "d").alias("quarters"), C.opening_period(F.last_day("d"), F.lit(2)).alias("opening"), C.inferred_start("d", F.lit(2)).alias("inferred_start"))


def year_end_month():
    return (F.col("c_nationkey") % 12 + 1).cast("int")


NOMINAL = "last_day(make_date(CAST(year(d) + {k} AS BIGINT), CAST(m AS BIGINT), 1))"
HIT = "abs(date_diff('day', {n}, d)) <= 14"


@query("fiscal_periods", f"""WITH o AS (SELECT o_orderkey, {DAY} AS d, c_nationkey % 12 + 1 AS m FROM orders JOIN customer ON o_custkey = c_custkey),
e AS (SELECT *, CASE WHEN {NOMINAL.format(k=0)} >= d - 14 THEN {NOMINAL.format(k=0)} ELSE {NOMINAL.format(k=1)} END AS fye FROM o),
q AS (SELECT *, round(date_diff('day', d, fye) / 30.4375) AS months FROM e), f AS (SELECT *, CASE months WHEN 0 THEN 4 WHEN 3 THEN 3 WHEN 6 THEN 2 WHEN 9 THEN 1 END AS fq FROM q)
SELECT o_orderkey, CAST(fy AS INTEGER) AS fiscal_year, CAST(n AS INTEGER) AS fiscal_quarter, CASE WHEN n = 4 THEN 'FY' || fy ELSE 'Q' || n || ' ' || fy END AS period_label, method FROM
  (SELECT o_orderkey, CASE WHEN fq IS NULL THEN year(d) ELSE year(fye) END AS fy, coalesce(fq, CASE WHEN quarter(d) = 4 THEN 3 ELSE quarter(d) END) AS n, CASE WHEN fq IS NULL THEN 'fallback' ELSE 'nominal_fye' END AS method FROM f)""")
def fiscal_periods(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("d", F.col("o_orderdate").cast("date")).withColumn("m", year_end_month())
    fye = C.year_end_after("d", "m", F.lit(31))
    o = o.withColumn("fye", fye).withColumn("fq", C.quarter_of_months(C.months_apart("fye", "d")))
    fallback = F.col("fq").isNull()
    calendar = F.when(F.quarter("d") == 4, 3).otherwise(F.quarter("d"))
    o = o.withColumn("fiscal_year", F.when(fallback, F.year("d")).otherwise(F.year("fye"))).withColumn("fiscal_quarter", F.coalesce("fq", calendar))
    return o.select("o_orderkey", "fiscal_year", "fiscal_quarter", C.period_label("fiscal_year", "fiscal_quarter").alias("period_label"), F.when(fallback, "fallback").otherwise("nominal_fye").alias("method"))


@query("next_expected", f"""WITH o AS (SELECT o_custkey, max({DAY}) AS last FROM orders GROUP BY 1), p AS (SELECT o.o_custkey, last, max(x.d) AS prior FROM o LEFT JOIN (SELECT o_custkey, {DAY} AS d FROM orders) x
  ON x.o_custkey = o.o_custkey AND x.d BETWEEN last - 380 AND last - 350 GROUP BY 1, 2)
SELECT o_custkey, CASE WHEN prior IS NOT NULL THEN prior + 728 ELSE last + 91 + 40 END AS expected, CASE WHEN prior IS NOT NULL THEN 'prior year' ELSE 'quarter' END AS basis FROM p""")
def next_expected(t):
    o = t.orders.select("o_custkey", F.col("o_orderdate").cast("date").alias("d"))
    last = F.max("d").over(Window.partitionBy("o_custkey"))
    p = o.withColumn("last", last).withColumn("gap", F.datediff("last", "d"))
    p = p.groupBy("o_custkey", "last").agg(F.max(F.when(F.col("gap").between(350, 380), F.col("d"))).alias("prior"))
    known = F.col("prior").isNotNull()
    return p.select("o_custkey", F.when(known, F.date_add("prior", 728)).otherwise(F.date_add("last", 131)).alias("expected"), F.when(known, "prior year").otherwise("quarter").alias("basis"))


# Year-to-date totals by nation, as filings report them: the quarter's running sum within a fiscal year.
YTD_SQL = """SELECT *, sum(v) OVER (PARTITION BY nation, fy ORDER BY n) AS ytd FROM (SELECT c_nationkey AS nation, CAST(year(o_orderdate) AS INTEGER) AS fy, CAST(quarter(o_orderdate) AS INTEGER) AS n, round(sum(o_totalprice), 2) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' AND NOT (quarter(o_orderdate) = 2 AND c_nationkey % 7 = year(o_orderdate) % 7) GROUP BY 1, 2, 3)"""


def ytd(t: Tables) -> DataFrame:
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).where("o_orderstatus <> 'P' AND NOT (quarter(o_orderdate) = 2 AND c_nationkey % 7 = year(o_orderdate) % 7)")
    per = o.groupBy(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("fy"), F.quarter("o_orderdate").alias("n")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return per.withColumn("ytd", F.sum("v").over(Window.partitionBy("nation", "fy").orderBy("n")))


def quarter_values(y: DataFrame) -> DataFrame:
    """Quarter n of each year as year-to-date n less year-to-date n-1; refused, with a reason, where the filing before is absent."""
    before = y.select("nation", "fy", (F.col("n") + 1).alias("n"), F.col("ytd").alias("before"))
    j = y.join(before, ["nation", "fy", "n"], "left")
    value = F.when(F.col("n") == 1, F.col("ytd")).otherwise(F.col("ytd") - F.col("before"))
    status = F.when(F.col("n") == 1, "reported").when(F.col("before").isNull(), "unavailable").otherwise("derived")
    reason = F.when((F.col("n") > 1) & F.col("before").isNull(), F.concat(F.lit("no filing for Q"), F.col("n") - 1))
    return j.select("nation", "fy", "n", F.round(value, 2).alias("value"), status.alias("status"), reason.alias("reason"))


@query("ytd_to_quarter", f"""WITH y AS ({YTD_SQL}) SELECT a.nation, a.fy, a.n, round(CASE WHEN a.n = 1 THEN a.ytd ELSE a.ytd - b.ytd END, 2) AS value,
  CASE WHEN a.n = 1 THEN 'reported' WHEN b.ytd IS NULL THEN 'unavailable' ELSE 'derived' END AS status, CASE WHEN a.n > 1 AND b.ytd IS NULL THEN 'no filing for Q' || (a.n - 1) END AS reason
FROM y a LEFT JOIN y b ON a.nation = b.nation AND a.fy = b.fy AND b.n = a.n - 1""")
def ytd_to_quarter(t):
    return quarter_values(ytd(t))


@query("ltm", f"""WITH y AS ({YTD_SQL}) SELECT c.nation, c.fy, c.n, round(CASE WHEN c.n = 4 THEN c.ytd ELSE c.ytd + f.ytd - p.ytd END, 2) AS value,
  CASE WHEN c.n = 4 THEN 'reported' WHEN f.ytd IS NULL THEN 'no prior year' WHEN p.ytd IS NULL THEN 'no prior year-to-date' ELSE 'derived' END AS status
FROM y c LEFT JOIN y f ON f.nation = c.nation AND f.fy = c.fy - 1 AND f.n = 4 LEFT JOIN y p ON p.nation = c.nation AND p.fy = c.fy - 1 AND p.n = c.n""")
def ltm(t):
    y = ytd(t)
    full = y.where("n = 4").select("nation", (F.col("fy") + 1).alias("fy"), F.col("ytd").alias("full"))
    prior = y.select("nation", (F.col("fy") + 1).alias("fy"), "n", F.col("ytd").alias("prior"))
    j = y.join(full, ["nation", "fy"], "left").join(prior, ["nation", "fy", "n"], "left")
    own = F.col("n") == 4
    value = F.when(own, F.col("ytd")).otherwise(F.col("ytd") + F.col("full") - F.col("prior"))
    status = F.when(own, "reported").when(F.col("full").isNull(), "no prior year").when(F.col("prior").isNull(), "no prior year-to-date").otherwise("derived")
    return j.select("nation", "fy", "n", F.round(value, 2).alias("value"), status.alias("status"))


@query("asof_cutoff", f"""SELECT o_custkey, count(*) AS n, max({DAY}) AS last, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS latest FROM orders WHERE o_orderdate IS NOT NULL AND {DAY} <= DATE '1998-06-30' GROUP BY 1""")
def asof_cutoff(t):
    d = F.col("o_orderdate").cast("date")
    o = t.orders.where(F.col("o_orderdate").isNotNull() & (d <= F.lit("1998-06-30").cast("date")))
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max(d).alias("last"), F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("company_metrics_pivot", """WITH y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y, o_orderstatus, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2, 3), l AS (SELECT o_custkey, max(y) AS y FROM y GROUP BY 1)
SELECT o_custkey, y, max(CASE WHEN o_orderstatus = 'F' THEN v END) AS final, max(CASE WHEN o_orderstatus = 'O' THEN v END) AS open, max(CASE WHEN o_orderstatus = 'P' THEN v END) AS pending FROM y JOIN l USING (o_custkey, y) GROUP BY 1, 2""")
def company_metrics_pivot(t):
    y = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("y"), "o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    latest = y.withColumn("last", F.max("y").over(Window.partitionBy("o_custkey"))).where("y = last")
    p = latest.groupBy("o_custkey", "y").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.max("v"))
    return p.select("o_custkey", "y", F.col("F").alias("final"), F.col("O").alias("open"), F.col("P").alias("pending"))


@query("grid_long", """SELECT l_returnflag || '/' || l_linestatus AS line_key, CAST(year(l_shipdate) AS INTEGER) AS fy, round(sum(l_extendedprice), 2) AS value, count(*) AS n, CAST(dense_rank() OVER (ORDER BY l_returnflag, l_linestatus) AS BIGINT) AS line_order
FROM lineitem GROUP BY l_returnflag, l_linestatus, year(l_shipdate)""")
def grid_long(t):
    cells = t.lineitem.groupBy("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("fy")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"), F.count("*").alias("n"))
    keyed = cells.withColumn("line_order", F.dense_rank().over(Window.orderBy("l_returnflag", "l_linestatus")).cast("long"))  # a few dozen cells
    return keyed.select(F.concat_ws("/", "l_returnflag", "l_linestatus").alias("line_key"), "fy", "value", "n", "line_order")


@query("grid_pivot", """SELECT l_returnflag, l_linestatus, """ + ", ".join(f"round(sum(CASE WHEN year(l_shipdate) = {y} THEN l_extendedprice END), 2) AS fy{y}" for y in range(1995, 2002)) + " FROM lineitem GROUP BY 1, 2")
def grid_pivot(t):
    p = t.lineitem.withColumn("y", F.year("l_shipdate")).groupBy("l_returnflag", "l_linestatus").pivot("y", list(range(1995, 2002)))
    out = p.agg(F.round(F.sum("l_extendedprice"), 2))
    return out.select("l_returnflag", "l_linestatus", *(F.col(str(y)).alias(f"fy{y}") for y in range(1995, 2002)))


@query("compare_concept", """WITH v AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_totalprice) AS k, max(o_totalprice) AS v FROM orders WHERE year(o_orderdate) = 1997 AND o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT c_custkey, CASE WHEN n IS NULL THEN 'unavailable' WHEN k > 1 THEN 'ambiguous' ELSE 'available' END AS status, CASE WHEN k = 1 THEN v END AS value FROM customer LEFT JOIN v ON o_custkey = c_custkey""")
def compare_concept(t):
    v = t.orders.where("year(o_orderdate) = 1997 AND o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count_distinct("o_totalprice").alias("k"), F.max("o_totalprice").alias("v"))
    j = t.customer.join(v, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", F.when(F.col("k").isNull(), "unavailable").when(F.col("k") > 1, "ambiguous").otherwise("available").alias("status"), F.when(F.col("k") == 1, F.col("v")).alias("value"))


@query("latest_period_selection", f"""SELECT o_custkey, o_orderkey, CAST(rn AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 3""")
def latest_period_selection(t):
    return W.ranked(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], "position").where("position <= 3").select("o_custkey", "o_orderkey", "position")


@query("amendment_lists", """SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS fy, min_by(o_orderkey, (o_orderstatus = 'P', -epoch(o_orderdate), -o_orderkey)) AS results_order,
  string_agg(CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderkey AS VARCHAR) END, ',' ORDER BY o_orderkey) AS amendments FROM orders GROUP BY 1, 2""")
def amendment_lists(t):
    amend = F.col("o_orderstatus") == "P"
    g = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("fy")).agg(
        F.min_by("o_orderkey", F.struct(amend, -F.unix_timestamp(F.col("o_orderdate").cast("timestamp")), -F.col("o_orderkey"))).alias("results_order"),
        F.array_sort(F.collect_list(F.when(amend, F.col("o_orderkey")))).alias("a"))
    return g.select("o_custkey", "fy", "results_order", F.when(F.size("a") > 0, F.array_join(F.col("a").cast("array<string>"), ",")).alias("amendments"))


@query("instants_pairing", """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, count(*) OVER (PARTITION BY l_orderkey) AS lines FROM lineitem),
i AS (SELECT o_orderkey, e.v, row_number() OVER (PARTITION BY o_orderkey ORDER BY e.v) AS k, 2 AS inst FROM orders, LATERAL (VALUES (0.0), (o_totalprice)) e(v))
SELECT l.l_orderkey, l.k, i.v FROM l JOIN i ON i.o_orderkey = l.l_orderkey AND i.k = i.inst - l.lines + l.k""")
def instants_pairing(t):
    w = Window.partitionBy("l_orderkey")
    l = t.lineitem.withColumn("k", F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long")).withColumn("lines", F.count("*").over(w))  # noqa: E741
    i = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.posexplode(F.array_sort(F.array(F.lit(0.0), F.col("o_totalprice")))).alias("p", "v"))
    i = i.withColumn("j", F.col("p") + 1)
    return l.join(i, ["l_orderkey"]).where("j = 2 - lines + k").select("l_orderkey", "k", "v")
