"""Upserts, owners, preferences, telemetry, ownership series, entitlements, trees and daily batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from finlattice.operators import windows as W
from finlattice.operators.state import entitled, resolve_scope, upsert
from finlattice.plans.registry import query


@query("upsert_priority", """WITH n AS (SELECT event_id % 500 AS k, user_id, value, event_type, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END AS p, ts, event_id FROM events)
SELECT k, user_id, value, event_type FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, ts DESC, event_id DESC) AS rn FROM n) WHERE rn = 1""")
def upsert_priority(t):
    p = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    e = t.events.withColumn("k", F.col("event_id") % 500).withColumn("p", p)
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    return upsert(old, new, ["k"], [F.asc("p"), F.desc("ts"), F.desc("event_id")]).select("k", "user_id", "value", "event_type")


@query("current_owner", """WITH s AS (SELECT l_partkey, l_suppkey, max(l_shipdate) AS last, count(*) AS n, bool_or(l_linestatus = 'O') AS active FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY active DESC, last DESC, n DESC, l_suppkey) AS rn FROM s) WHERE rn = 1""")
def current_owner(t):
    s = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.max("l_shipdate").alias("last"), F.count("*").alias("n"), F.bool_or(F.col("l_linestatus") == "O").alias("active"))
    return W.first_per_key(s, ["l_partkey"], [F.desc("active"), F.desc("last"), F.desc("n"), F.asc("l_suppkey")]).select("l_partkey", "l_suppkey")


@query("resolve_scope", """SELECT c_custkey, coalesce(CASE WHEN c_custkey % 11 = 0 THEN 'customer' END, CASE WHEN n_nationkey % 5 = 0 THEN n_name END, CASE WHEN r_regionkey % 2 = 0 THEN r_name END, 'default') AS preference,
  CASE WHEN c_custkey % 11 = 0 THEN 'customer' WHEN n_nationkey % 5 = 0 THEN 'nation' WHEN r_regionkey % 2 = 0 THEN 'region' ELSE 'default' END AS scope
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def resolve(t):
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    scopes = [("customer", F.when(F.col("c_custkey") % 11 == 0, "customer")), ("nation", F.when(F.col("n_nationkey") % 5 == 0, F.col("n_name"))), ("region", F.when(F.col("r_regionkey") % 2 == 0, F.col("r_name")))]
    return resolve_scope(c, scopes, F.lit("default")).select("c_custkey", "preference", "scope")


@query("three_strikes", """WITH v AS (SELECT event_type, CAST(floor(value) AS BIGINT) AS v, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2)
SELECT event_type, v, users FROM v WHERE users >= 3 AND (event_type, v) NOT IN (SELECT event_type, v FROM v WHERE v % 10 = 0)""")
def three_strikes(t):
    v = t.events.groupBy("event_type", F.floor("value").alias("v")).agg(F.count_distinct("user_id").alias("users"))
    dismissed = v.where("v % 10 = 0").select("event_type", "v")
    return v.where("users >= 3").join(dismissed, ["event_type", "v"], "left_anti")


@query("touch_report", """WITH k AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, k) AS rn FROM k)
SELECT e.event_type, e.n, e.users, top FROM (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1) e JOIN
  (SELECT event_type, string_agg(k || ':' || n, ',' ORDER BY rn) AS top FROM r WHERE rn <= 5 GROUP BY 1) x ON x.event_type = e.event_type""")
def touch_report(t):
    k = F.get_json_object("props", "$.k").cast("long")
    per = t.events.groupBy("event_type", k.alias("k")).agg(F.count("*").alias("c"))
    top = W.ranked(per, ["event_type"], [F.desc("c"), F.asc("k")]).where("rn <= 5")
    top = top.groupBy("event_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "k", "c"))), lambda x: F.concat_ws(":", x["k"].cast("string"), x["c"].cast("string"))), ",").alias("top"))
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")).join(top, "event_type")


@query("purchase_cluster", """SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(DISTINCT CASE WHEN value > 30 THEN 'joint:' || (event_id % 7) ELSE CAST(user_id AS VARCHAR) END) AS identities,
  count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(DISTINCT user_id) >= 2""")
def purchase_cluster(t):
    e = t.events.where("event_type = 'purchase'")
    who = F.when(F.col("value") > 30, F.concat(F.lit("joint:"), F.col("event_id") % 7)).otherwise(F.col("user_id").cast("string"))
    g = e.groupBy(F.date_trunc("week", "ts").cast("date").alias("week")).agg(F.count_distinct(who).alias("identities"), F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return g.where("users >= 2").drop("users")


@query("position_series", """WITH d AS (SELECT l_suppkey, l_linenumber, CAST(l_shipdate AS DATE) AS d, count(DISTINCT l_quantity) AS k, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)
SELECT l_suppkey, l_linenumber, d, v FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY d DESC) AS rn FROM d WHERE k = 1) WHERE rn <= 50""")
def position_series(t):
    from finlattice.operators.holdings import insider_series

    rows = t.lineitem.select(F.col("l_suppkey").alias("issuer"), F.col("l_linenumber").alias("owner"), F.lit("common").alias("security"), F.lit("D").alias("ownership"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_quantity").alias("balance"))
    return insider_series(rows).select(F.col("issuer").alias("l_suppkey"), F.col("owner").alias("l_linenumber"), F.col("day").alias("d"), F.col("balance").alias("v"))


@query("entitlement", """SELECT o_custkey, coalesce(bool_and(EXISTS (SELECT 1 FROM nation WHERE n_nationkey = l_suppkey % 25 AND n_regionkey <> o_custkey % 5)), false) AS permitted
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def entitlement(t):
    docs = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("artifact"), (F.col("l_suppkey") % 25).alias("doc"))
    granted = t.nation.crossJoin(F.broadcast(t.spark.range(5).select(F.col("id").alias("who")))).where("n_regionkey <> who").select(F.col("n_nationkey").alias("doc"), "who")  # 5 rows of callers
    return entitled(docs.withColumn("who", F.col("artifact") % 5), granted, "artifact", ["doc", "who"]).select(F.col("artifact").alias("o_custkey"), "permitted")


@query("json_flatten", """SELECT event_id, 'k' AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS value FROM events""")
def json_flatten(t):
    m = F.from_json("props", "map<string,bigint>")
    return t.events.select("event_id", F.explode(m).alias("key", "value"))


@query("tree_walk", """WITH RECURSIVE e(child, parent) AS (SELECT 'r' || r_regionkey, 'root' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
w(node, path, depth) AS (SELECT 'root', 'root', 0 UNION ALL SELECT child, path || '/' || child, depth + 1 FROM w JOIN e ON parent = node) SELECT node, path, depth FROM w""")
def tree_walk(t):
    e = t.region.selectExpr("concat('r', r_regionkey) AS child", "'root' AS parent").union(t.nation.selectExpr("concat('n', n_nationkey)", "concat('r', n_regionkey)")).union(t.customer.selectExpr("concat('c', c_custkey)", "concat('n', c_nationkey)"))
    from finlattice.operators.trees import walk

    return walk(e, "parent", "child", "root")


@query("tree_weighted_sum", """SELECT n_regionkey, round(sum(CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE -1 END * v), 2) AS total FROM nation JOIN (SELECT c_nationkey, sum(c_acctbal) AS v FROM customer GROUP BY 1) ON c_nationkey = n_nationkey GROUP BY 1""")
def tree_weighted_sum(t):
    v = t.customer.groupBy(F.col("c_nationkey").alias("child")).agg(F.sum("c_acctbal").alias("value"))
    arcs = t.nation.select(F.col("n_regionkey").alias("parent"), F.col("n_nationkey").alias("child"), F.when(F.col("n_nationkey") % 2 == 0, 1.0).otherwise(-1.0).alias("weight"))
    from finlattice.operators.trees import weighted_totals

    return weighted_totals(arcs, v).select(F.col("parent").alias("n_regionkey"), F.round("total", 2).alias("total"))


@query("sliding_rate", "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW) AS n FROM events")
def sliding_rate(t):
    return W.trailing_count(t.events, ["user_id"], "ts", 3600).select("event_id", "user_id", "n")


@query("stream_daily_batches", "SELECT event_id, user_id, event_type, value FROM events WHERE event_type <> 'error'")
def stream_daily_batches(t):
    from finlattice.streaming.daily import keyed_stream

    return keyed_stream(t.spark, f"{t.folder}/events.parquet", ["event_id"], "ts", F.col("event_type") != "error").select("event_id", "user_id", "event_type", "value")


@query("conversation_versions", """SELECT conv_id, max(turn) AS current_turn, count(*) AS versions, max_by(role, turn) AS current_role, length(max_by(text, turn)) AS current_length FROM conversations GROUP BY 1""")
def conversation_versions(t):
    return t.conversations.groupBy("conv_id").agg(F.max("turn").alias("current_turn"), F.count("*").alias("versions"), F.max_by("role", "turn").alias("current_role"), F.length(F.max_by("text", "turn")).cast("long").alias("current_length"))


@query("event_windows", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1, 2""")
def event_windows(t):
    g = t.events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("v"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "v")


@query("ownership_cards", """WITH h AS (SELECT l_suppkey, l_partkey, last_day(CAST(l_shipdate AS DATE)) AS m, sum(l_quantity) AS shares FROM lineitem WHERE month(l_shipdate) IN (3, 6, 9, 12) GROUP BY 1, 2, 3)
SELECT c.l_suppkey, c.l_partkey, c.m AS period, CASE WHEN p.shares > 0 THEN round((c.shares - p.shares) * 100 / p.shares, 4) END AS percent_change FROM h c LEFT JOIN h p
  ON p.l_suppkey = c.l_suppkey AND p.l_partkey = c.l_partkey AND p.m = last_day(CAST(c.m - INTERVAL 3 MONTH AS DATE))""")
def ownership_cards(t):
    from finlattice.functions.core import percent_change, previous_quarter

    h = t.lineitem.where("month(l_shipdate) IN (3, 6, 9, 12)").groupBy("l_suppkey", "l_partkey", F.last_day(F.col("l_shipdate").cast("date")).alias("period")).agg(F.sum("l_quantity").alias("shares"))
    prior = h.select("l_suppkey", "l_partkey", F.col("period").alias("before"), F.col("shares").alias("prior"))
    j = h.withColumn("before", previous_quarter("period")).join(prior, ["l_suppkey", "l_partkey", "before"], "left")
    return j.select("l_suppkey", "l_partkey", "period", percent_change(F.col("shares") - F.col("prior"), "shares").alias("percent_change"))


@query("pending_receipts", "SELECT event_id, user_id FROM events e WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'view' AND r.user_id = e.user_id AND CAST(r.ts AS DATE) = CAST(e.ts AS DATE))")
def pending_receipts(t):
    e = t.events.withColumn("d", F.col("ts").cast("date"))
    return e.where("event_type = 'purchase'").join(e.where("event_type = 'view'").select("user_id", "d"), ["user_id", "d"], "left_anti").select("event_id", "user_id")


@query("recent_of_followed", "SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_custkey IN (1, 5, 9, 14, 22, 31) AND o_orderdate >= TIMESTAMP '1999-01-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def recent_of_followed(t):
    o = t.orders.where(F.col("o_custkey").isin(1, 5, 9, 14, 22, 31) & (F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp")))
    return o.join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "left").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_custkey", "c_name")


@query("first_listed_primary", "SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) = 1 AS is_primary FROM supplier")
def first_listed_primary(t):
    w = Window.partitionBy("s_nationkey")
    return t.supplier.select("s_nationkey", "s_suppkey", (F.min("s_suppkey").over(w) == F.col("s_suppkey")).alias("is_primary"))
