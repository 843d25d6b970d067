"""Identity checks of order totals, and the reports over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finlattice.operators import identity as I
from finlattice.operators import joins as J
from finlattice.operators import windows as W
from finlattice.plans.lines import VERSIONS_SQL, versions
from finlattice.plans.registry import Tables, query

NET_TAX = "l_extendedprice * (1 - l_discount) * (1 + l_tax)"


def checked(t: Tables) -> DataFrame:
    """Orders with the sum of their latest line versions against the stated total."""
    sums = versions(t).where("is_current").groupBy("l_orderkey").agg(F.round(F.sum(F.expr(NET_TAX)), 6).alias("net_tax"))
    joined = t.orders.join(sums, F.col("o_orderkey") == F.col("l_orderkey"))
    return I.identity_check(joined, F.col("net_tax"), F.col("o_totalprice"))


CHECKED_SQL = f"""SELECT *, abs(difference) <= tolerance AS passed FROM (SELECT *, lhs - rhs AS difference, greatest(1.0, 0.005 * greatest(abs(lhs), abs(rhs))) AS tolerance FROM (
  SELECT o.*, s.v AS lhs, o_totalprice AS rhs FROM orders o JOIN (SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 6) AS v FROM ({VERSIONS_SQL}) WHERE is_current GROUP BY 1) s ON o_orderkey = l_orderkey))"""


@query("identity_check_order_total", f"SELECT o_orderkey, lhs, rhs, round(difference, 6) AS difference, passed FROM ({CHECKED_SQL})")
def identity_check_order_total(t):
    return checked(t).select("o_orderkey", "lhs", "rhs", F.round("difference", 6).alias("difference"), "passed")


CANDIDATES = {"net_tax": "l_extendedprice * (1 - l_discount) * (1 + l_tax)", "net": "l_extendedprice * (1 - l_discount)", "gross": "l_extendedprice", "net_less_tax": "l_extendedprice * (1 - l_discount) * (1 - l_tax)"}


@query("candidate_identity", f"""WITH s AS (SELECT l_orderkey, {", ".join(f"round(sum({v}), 6) AS {k}" for k, v in CANDIDATES.items())} FROM ({VERSIONS_SQL}) WHERE is_current GROUP BY 1),
c AS (SELECT o_orderkey, o_totalprice AS rhs, u.i, u.name AS candidate, u.v AS lhs, abs(u.v - o_totalprice) <= greatest(1.0, 0.005 * greatest(abs(u.v), abs(o_totalprice))) AS passed
  FROM orders JOIN s ON o_orderkey = l_orderkey CROSS JOIN LATERAL (VALUES {", ".join(f"({i}, '{k}', s.{k})" for i, k in enumerate(CANDIDATES))}) u(i, name, v))
SELECT o_orderkey, candidate, lhs, passed FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY passed DESC, i) AS rn FROM c) WHERE rn = 1""")
def candidate_identity(t):
    s = versions(t).where("is_current").groupBy("l_orderkey").agg(*(F.round(F.sum(F.expr(v)), 6).alias(k) for k, v in CANDIDATES.items()))
    joined = t.orders.join(s, F.col("o_orderkey") == F.col("l_orderkey"))
    return I.first_closing(joined, [(k, F.col(k)) for k in CANDIDATES], F.col("o_totalprice")).select("o_orderkey", "candidate", "lhs", "passed")


BAND_SQL = "CASE WHEN difference = 0 THEN 'exact' WHEN q <= 0.5 THEN 'within half' WHEN q <= 1 THEN 'near miss' WHEN q <= 2 THEN 'just over' WHEN q <= 10 THEN 'over' ELSE 'far over' END"


@query("tolerance_bands", f"SELECT {BAND_SQL} AS band, tolerance = 1.0 AS floor_regime, count(*) AS n, count(*) FILTER (WHERE passed) AS n_passed FROM (SELECT *, abs(difference) / tolerance AS q FROM ({CHECKED_SQL})) GROUP BY 1, 2")
def tolerance_bands(t):
    return checked(t).groupBy(I.tolerance_band().alias("band"), (F.col("tolerance") == 1.0).alias("floor_regime")).agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"))


REASON_SQL = """CASE WHEN abs(lhs - rhs) <= tolerance THEN 'passed' WHEN lhs = 0 OR rhs = 0 THEN 'one side is zero' WHEN abs(lhs + rhs) <= tolerance THEN 'opposite sign'
  WHEN abs(r - 1000) <= 5 OR abs(r - 0.001) <= 0.000005 OR abs(r - 1000000) <= 5000 THEN 'scale' WHEN abs(lhs - rhs) <= 2 * tolerance THEN 'just over'
  WHEN abs(r - 4) <= 0.02 OR abs(r - 2) <= 0.01 OR abs(r - 0.5) <= 0.0025 OR abs(r - 0.25) <= 0.00125 THEN 'another period' ELSE 'unexplained' END"""
REASONED_SQL = f"SELECT *, {REASON_SQL} AS reason FROM (SELECT *, abs(lhs) / nullif(abs(rhs), 0) AS r FROM ({CHECKED_SQL}))"


@query("failure_reasons", f"SELECT reason, count(*) AS n, round(sum(abs(difference)), 2) AS gap FROM ({REASONED_SQL}) GROUP BY 1")
def failure_reasons(t):
    return checked(t).groupBy(I.failure_reason().alias("reason")).agg(F.count("*").alias("n"), F.round(F.sum(F.abs("difference")), 2).alias("gap"))


@query("failure_report", f"""SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE NOT passed) AS failed, count(DISTINCT CASE WHEN NOT passed THEN o_custkey END) AS customers_with_failures,
  count(*) FILTER (WHERE NOT passed AND abs(difference) > 10 * tolerance) AS severe FROM ({CHECKED_SQL}) GROUP BY 1""")
def failure_report(t):
    bad = ~F.col("passed")
    return checked(t).groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.count_if(bad).alias("failed"), F.count_distinct(F.when(bad, F.col("o_custkey"))).alias("customers_with_failures"),
        F.count_if(bad & (F.abs("difference") > 10 * F.col("tolerance"))).alias("severe"),
    )


@query("worst_failures", f"SELECT o_orderkey, round(abs(difference) / tolerance, 4) AS q, reason FROM ({REASONED_SQL}) WHERE NOT passed ORDER BY abs(difference) / tolerance DESC, o_orderkey LIMIT 20")
def worst_failures(t):
    q = F.abs("difference") / F.col("tolerance")
    return checked(t).where("NOT passed").orderBy(q.desc(), "o_orderkey").limit(20).select("o_orderkey", F.round(q, 4).alias("q"), I.failure_reason().alias("reason"))


@query("gap_concepts", f"""SELECT c.o_orderkey, count(*) FILTER (WHERE abs(abs(l_extendedprice) - abs(difference)) <= 0.01 * abs(difference)) AS equal_price,
  count(*) FILTER (WHERE abs(abs(l_extendedprice * l_tax) - abs(difference)) <= 0.01 * abs(difference)) AS equal_tax FROM ({CHECKED_SQL}) c JOIN lineitem l ON l_orderkey = o_orderkey WHERE NOT passed GROUP BY 1""")
def gap_concepts(t):
    near = lambda v: F.count_if(F.abs(F.abs(v) - F.abs("difference")) <= 0.01 * F.abs("difference"))
    failed = checked(t).where("NOT passed").select("o_orderkey", "difference")
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice", "l_tax")
    return failed.join(lines, "o_orderkey").groupBy("o_orderkey").agg(near(F.col("l_extendedprice")).alias("equal_price"), near(F.col("l_extendedprice") * F.col("l_tax")).alias("equal_tax"))


@query("verdict_tristate", f"""SELECT c_custkey, bool_and(v) AS checks_passed, coalesce(bool_or(o_orderstatus = 'F'), false) AS any_final, count(v) AS n FROM customer LEFT JOIN
  (SELECT o_custkey, o_orderstatus, CASE WHEN o_orderstatus <> 'P' AND o_orderpriority < '4' THEN passed END AS v FROM ({CHECKED_SQL})) ON o_custkey = c_custkey GROUP BY 1""")
def verdict_tristate(t):
    v = F.when((F.col("o_orderstatus") != "P") & (F.col("o_orderpriority") < "4"), F.col("passed"))
    per = checked(t).groupBy("o_custkey").agg(F.bool_and(v).alias("checks_passed"), F.bool_or(F.col("o_orderstatus") == "F").alias("any_final"), F.count(v).alias("n"))
    joined = t.customer.join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "checks_passed", F.coalesce("any_final", F.lit(False)).alias("any_final"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("coverage_audit", """WITH o AS (SELECT o_custkey, count(*) AS orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS final, max(CAST(o_orderdate AS DATE)) AS last FROM orders GROUP BY 1),
l AS (SELECT o_custkey, count(*) AS lines FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
j AS (SELECT c_mktsegment, CASE WHEN c_acctbal >= 5000 THEN 'large' WHEN c_acctbal >= 0 THEN 'middle' ELSE 'negative' END AS tier, coalesce(orders, 0) AS orders, coalesce(final, 0) AS final, coalesce(lines, 0) AS lines, last
  FROM customer LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN l ON l.o_custkey = c_custkey)
SELECT tier, CASE WHEN orders = 0 THEN 'no orders' WHEN lines = 0 THEN 'orders without lines' WHEN final < 4 THEN 'too few final orders' WHEN last < DATE '2001-01-01' THEN 'stale' ELSE 'covered' END AS reason,
  count(*) AS customers, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building, CAST(sum(lines) AS BIGINT) AS lines FROM j GROUP BY 1, 2""")
def coverage_audit(t):
    o = t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("final"), F.max(F.col("o_orderdate").cast("date")).alias("last"))
    l = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.count("*").alias("lines"))  # noqa: E741
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    j = t.customer.withColumnRenamed("c_custkey", "o_custkey").join(o, "o_custkey", "left").join(l, "o_custkey", "left")
    tier = F.when(F.col("c_acctbal") >= 5000, "large").when(F.col("c_acctbal") >= 0, "middle").otherwise("negative")
    reason = (
        F.when(zero("orders") == 0, "no orders").when(zero("lines") == 0, "orders without lines").when(zero("final") < 4, "too few final orders")
        .when(F.col("last") < F.lit("2001-01-01").cast("date"), "stale").otherwise("covered")
    )
    return j.groupBy(tier.alias("tier"), reason.alias("reason")).agg(F.count("*").alias("customers"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"), F.sum(zero("lines")).cast("long").alias("lines"))


@query("coverage_by_year", """SELECT year(o_orderdate) AS y, count(*) AS n, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_orderstatus = 'F') AS final,
  (SELECT count(*) FROM orders) AS total, count(*) FILTER (WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY) AS in_last_year FROM orders GROUP BY 1""".replace("SELECT year(o_orderdate) AS y", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y"))
def coverage_by_year(t):
    totals = t.orders.agg(F.count("*").alias("total"), F.max("o_orderdate").alias("last"))
    per = t.orders.crossJoin(F.broadcast(totals)).groupBy(F.year("o_orderdate").alias("y"))  # totals is one row
    recent = F.col("o_orderdate") > F.col("last") - F.expr("INTERVAL 365 DAYS")
    return per.agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), F.count_if(F.col("o_orderstatus") == "F").alias("final"), F.first("total").alias("total"), F.count_if(recent).alias("in_last_year"))


@query("quality_by_year_form", f"""WITH u AS (SELECT count(*) / 2 AS half FROM customer)
SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_orderstatus, count(*) AS n, round(100.0 * count(*) FILTER (WHERE passed) / count(*), 4) AS pass_rate,
  CASE WHEN count(DISTINCT o_custkey) < (SELECT half FROM u) THEN 'NOT EVALUATED' WHEN 100.0 * count(*) FILTER (WHERE passed) / count(*) >= 0.5 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ({CHECKED_SQL}) GROUP BY 1, 2""")
def quality_by_year_form(t):
    half = t.customer.agg((F.count("*") / 2).alias("half"))
    rate = 100.0 * F.count_if("passed") / F.count("*")
    per = checked(t).groupBy(F.year("o_orderdate").alias("y"), "o_orderstatus").agg(F.count("*").alias("n"), rate.alias("rate"), F.count_distinct("o_custkey").alias("customers"))
    verdict = F.when(F.col("customers") < F.col("half"), "NOT EVALUATED").when(F.col("rate") >= 0.5, "PASS").otherwise("FAIL")
    return per.crossJoin(F.broadcast(half)).select("y", "o_orderstatus", "n", F.round("rate", 4).alias("pass_rate"), verdict.alias("verdict"))  # half is one row


@query("implied_rate", """WITH d AS (SELECT l_orderkey, l_partkey, max(l_extendedprice) AS hi, min(l_extendedprice) AS lo, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem
  GROUP BY 1, 2 HAVING count(DISTINCT l_extendedprice) > 1)
SELECT p_brand, count(*) AS n, round(median(hi / lo), 4) AS rate, min(flags) AS first_flags FROM d JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def implied_rate(t):
    d = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(
        F.max("l_extendedprice").alias("hi"), F.min("l_extendedprice").alias("lo"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"), F.count_distinct("l_extendedprice").alias("k"))
    joined = d.where("k > 1").join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return joined.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.median(F.col("hi") / F.col("lo")), 4).alias("rate"), F.min("flags").alias("first_flags"))


@query("weekday_streak", """WITH d AS (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS d FROM events WHERE event_type IN ('signup', 'error') AND isodow(ts) <= 5),
n AS (SELECT *, date_diff('day', DATE '1970-01-05', d) // 7 * 5 + date_diff('day', DATE '1970-01-05', d) % 7 AS wd FROM d), i AS (SELECT *, wd - row_number() OVER (PARTITION BY user_id, event_type ORDER BY wd) AS island FROM n)
SELECT user_id, event_type, min(d) AS first_day, max(d) AS last_day, count(*) AS days FROM i GROUP BY user_id, event_type, island""")
def weekday_streak(t):
    day = F.col("ts").cast("date")
    d = t.events.where("event_type IN ('signup', 'error')").where(F.weekday("ts") <= 4).select("user_id", "event_type", day.alias("d")).distinct()
    since = F.datediff("d", F.lit("1970-01-05").cast("date"))
    i = W.islands(d, ["user_id", "event_type"], (F.floor(since / 7) * 5 + since % 7))
    return i.groupBy("user_id", "event_type", "island").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count("*").alias("days")).drop("island")


@query("reconciliation", """WITH s AS (SELECT l_orderkey, count(*) AS lines, max(l_shipdate) AS last FROM lineitem WHERE l_quantity > 10 GROUP BY 1), o AS (SELECT * FROM orders WHERE o_orderstatus <> 'P')
SELECT CASE WHEN o_orderkey IS NULL THEN 'source_only' WHEN l_orderkey IS NULL THEN 'lake_only' ELSE 'both' END AS side,
  CASE WHEN o_orderkey IS NULL OR l_orderkey IS NULL THEN 'absent' WHEN last < o_orderdate THEN 'before' WHEN date_diff('day', o_orderdate, last) <= 60 THEN 'within 60 days' ELSE 'later' END AS bucket, count(*) AS n
FROM o FULL JOIN s ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def reconciliation(t):
    s = t.lineitem.where("l_quantity > 10").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    j = t.orders.where("o_orderstatus <> 'P'").join(s, F.col("o_orderkey") == F.col("l_orderkey"), "full_outer")
    no_o, no_s = F.col("o_orderkey").isNull(), F.col("l_orderkey").isNull()
    bucket = F.when(no_o | no_s, "absent").when(F.col("last") < F.col("o_orderdate"), "before").when(F.datediff("last", "o_orderdate") <= 60, "within 60 days").otherwise("later")
    return j.groupBy(F.when(no_o, "source_only").when(no_s, "lake_only").otherwise("both").alias("side"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("duplicate_keys", "SELECT count(*) AS n, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem")
def duplicate_keys(t):
    return t.lineitem.agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("l_orderkey", "l_linenumber")).alias("duplicates"))


@query("split_detail", """SELECT split_part(detail, ' = ', 1) AS side, count(*) AS ran, count(*) FILTER (WHERE NOT passed) AS failed FROM (SELECT passed, o_orderstatus || ' = ' || o_orderpriority AS detail FROM (""" + CHECKED_SQL + """)) GROUP BY 1""")
def split_detail(t):
    d = checked(t).withColumn("detail", F.concat_ws(" = ", "o_orderstatus", "o_orderpriority"))
    return d.groupBy(F.split_part("detail", F.lit(" = "), F.lit(1)).alias("side")).agg(F.count("*").alias("ran"), F.count_if(~F.col("passed")).alias("failed"))


@query("dedupe_checks", f"""SELECT o_custkey, o_orderpriority, o_orderkey, passed FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderstatus, o_orderkey) AS rn FROM ({CHECKED_SQL})) WHERE rn = 1""")
def dedupe_checks(t):
    return W.first_per_key(checked(t), ["o_custkey", "o_orderpriority"], [F.asc("o_orderstatus"), F.asc("o_orderkey")]).select("o_custkey", "o_orderpriority", "o_orderkey", "passed")


@query("acceptance_criteria", f"""WITH c AS ({CHECKED_SQL}), r AS (SELECT 100.0 * count(*) FILTER (WHERE passed) / count(*) AS rate FROM c), l AS (SELECT count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)),
s AS (SELECT max(o_orderdate) AS last FROM orders)
SELECT 'pass rate' AS criterion, CASE WHEN rate >= 98 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM r UNION ALL SELECT 'no dangling parts', CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END FROM l
UNION ALL SELECT 'fresh', CASE WHEN last IS NULL THEN 'NOT EVALUATED' WHEN last >= TIMESTAMP '2001-01-01' THEN 'PASS' ELSE 'FAIL' END FROM s""")
def acceptance_criteria(t):
    verdict = lambda name, ok: F.struct(F.lit(name).alias("criterion"), F.when(ok.isNull(), "NOT EVALUATED").when(ok, "PASS").otherwise("FAIL").alias("verdict"))
    rate = checked(t).agg(verdict("pass rate", 100.0 * F.count_if("passed") / F.count("*") >= 98).alias("r"))
    lost = J.dangling(t.lineitem, t.part, "l_partkey", "p_partkey").agg(verdict("no dangling parts", F.count("*") == 0).alias("r"))
    last = t.orders.agg(verdict("fresh", F.max("o_orderdate") >= F.lit("2001-01-01").cast("timestamp")).alias("r"))
    return rate.unionByName(lost).unionByName(last).select("r.*")


@query("summed_tree", """SELECT c_nationkey, round(sum(c_acctbal), 2) AS parts, round(max(total), 2) AS total, abs(sum(c_acctbal) - max(total)) <= 1 + 1e-6 * abs(max(total)) AS adds_up FROM
  (SELECT *, sum(c_acctbal) OVER (PARTITION BY c_nationkey) AS total FROM customer) GROUP BY 1""")
def summed_tree(t):
    from finlattice.functions.core import adds_up

    total = t.customer.withColumn("total", F.sum("c_acctbal").over(Window.partitionBy("c_nationkey")))
    s = total.groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("parts"), F.max("total").alias("total"))
    return s.select("c_nationkey", F.round("parts", 2).alias("parts"), F.round("total", 2).alias("total"), adds_up("parts", "total").alias("adds_up"))
