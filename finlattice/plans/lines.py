"""Line versions, ordering, assembly and interval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finlattice.operators import joins as J
from finlattice.operators import windows as W
from finlattice.plans.registry import Tables, query

VERSION_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def versions(t: Tables) -> DataFrame:
    order = [F.desc_nulls_last(c) for c in VERSION_ORDER]
    return W.latest_per_key(t.lineitem, ["l_orderkey", "l_linenumber"], order)


VERSIONS_SQL = """SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC NULLS LAST, l_partkey DESC NULLS LAST,
  l_suppkey DESC NULLS LAST, l_extendedprice DESC NULLS LAST, l_quantity DESC NULLS LAST) = 1 AS is_current FROM lineitem"""


@query("latest_version_per_line", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(l_shipdate AS DATE) AS l_shipdate, is_current FROM ({VERSIONS_SQL})")
def latest_version_per_line(t):
    return versions(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_shipdate").cast("date").alias("l_shipdate"), "is_current")


@query("first_tag_row", """SELECT p_brand, p_type, p_partkey, p_name, p_size FROM (SELECT *, row_number() OVER
  (PARTITION BY p_brand, p_type ORDER BY p_size DESC NULLS LAST, p_name, p_partkey) AS rn FROM part) WHERE rn = 1""")
def first_tag_row(t):
    return W.first_per_key(t.part, ["p_brand", "p_type"], [F.desc_nulls_last("p_size"), F.asc_nulls_last("p_name"), F.asc("p_partkey")]).select("p_brand", "p_type", "p_partkey", "p_name", "p_size")


PRIORITIES = [("returned", "R", "F", 1), ("returned", "R", "O", 2), ("accepted", "A", "F", 1), ("accepted", "A", "O", 2), ("open", "N", "O", 1), ("open", "N", "F", 2)]


@query("priority_pick", f"""WITH m(metric, rf, ls, priority) AS (VALUES {", ".join(map(str, PRIORITIES))})
SELECT l_orderkey, metric, l_linenumber, l_extendedprice AS value FROM (SELECT l.*, m.metric, row_number() OVER (PARTITION BY l_orderkey, metric
  ORDER BY priority, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem l JOIN m ON l_returnflag = rf AND l_linestatus = ls) WHERE rn = 1""")
def priority_pick(t):
    m = t.spark.createDataFrame(PRIORITIES, "metric string, l_returnflag string, l_linestatus string, priority int")
    order = [F.asc(c) for c in ("priority", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    joined = t.lineitem.join(F.broadcast(m), ["l_returnflag", "l_linestatus"])  # the map has six rows
    return W.first_per_key(joined, ["l_orderkey", "metric"], order).select("l_orderkey", "metric", "l_linenumber", F.col("l_extendedprice").alias("value"))


@query("next_subtotal_parent", """SELECT o_orderkey, o_custkey, (SELECT min_by(p.o_orderkey, struct_pack(a := p.o_orderdate, b := p.o_orderkey)) FROM orders p
  WHERE p.o_custkey = o.o_custkey AND p.o_orderstatus = 'F' AND (p.o_orderdate, p.o_orderkey) > (o.o_orderdate, o.o_orderkey)) AS parent_orderkey FROM orders o""")
def next_subtotal_parent(t):
    return W.next_flagged(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "F", "o_orderkey", "parent_orderkey").select("o_orderkey", "o_custkey", "parent_orderkey")


@query("dense_line_order", """SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS ship_date, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate) AS BIGINT) AS line_order,
  min(CASE WHEN l_discount > 0 THEN l_quantity END) OVER (PARTITION BY l_orderkey) AS primary_quantity FROM lineitem""")
def dense_line_order(t):
    from pyspark.sql import Window

    d = W.dense_order(t.lineitem, ["l_orderkey"], [F.asc("l_linenumber"), F.asc("l_shipdate")])
    least = F.min(F.when(F.col("l_discount") > 0, F.col("l_quantity"))).over(Window.partitionBy("l_orderkey"))
    return d.select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("ship_date"), F.col("line_order").cast("long").alias("line_order"), least.alias("primary_quantity"))


@query("distinct_in_window", """SELECT o_orderkey, o_custkey, m.months FROM orders JOIN (SELECT o_custkey AS c, count(DISTINCT date_trunc('month', o_orderdate)) AS months FROM orders GROUP BY 1) m ON m.c = o_custkey""")
def distinct_in_window(t):
    return W.distinct_in_window(t.orders, ["o_custkey"], F.trunc("o_orderdate", "month"), "months").select("o_orderkey", "o_custkey", "months")


@query("occurrence_suffix", """SELECT event_id, user_id, CASE WHEN n = 1 THEN event_type ELSE event_type || '#' || n END AS line_key FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events)""")
def occurrence_suffix(t):
    return W.occurrence_suffix(t.events, ["user_id"], "event_type", [F.asc("ts"), F.asc("event_id")]).select("event_id", "user_id", "line_key")


@query("totals_else_breakdown", """WITH h AS (SELECT l_orderkey, bool_or(l_discount = 0) AS has FROM lineitem GROUP BY 1)
SELECT l.l_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem l JOIN h USING (l_orderkey) WHERE NOT has OR l_discount = 0 GROUP BY 1""")
def totals_else_breakdown(t):
    return W.totals_else_breakdown(t.lineitem, ["l_orderkey"], F.col("l_discount") == 0).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("elect_currency", """WITH v AS (SELECT r_name, n_name, count(DISTINCT o_custkey) AS voters, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
SELECT r_name, n_name, voters, n FROM (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY voters DESC, n DESC, n_name) AS rn FROM v) WHERE rn = 1""")
def elect_currency(t):
    geo = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    who = t.customer.join(geo, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")
    return W.elect(t.orders.join(who, F.col("o_custkey") == F.col("c_custkey")), "r_name", "n_name", "o_custkey").select("r_name", "n_name", "voters", "n")


@query("keep_missing_rows", """WITH k AS (SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 50)
SELECT * FROM k UNION ALL SELECT p_partkey, NULL, NULL, NULL FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM k)""")
def keep_missing_rows(t):
    kept = t.lineitem.where("l_quantity >= 50").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return J.keep_missing(t.part.select(F.col("p_partkey").alias("l_partkey")), kept, ["l_partkey"])


@query("first_match_within", """SELECT s.event_id, s.user_id, m.ts AS matched_at, m.event_id AS matched_id FROM (SELECT * FROM events WHERE event_type = 'signup') s LEFT JOIN LATERAL
  (SELECT ts, event_id FROM events p WHERE p.user_id = s.user_id AND event_type = 'purchase' AND p.ts > s.ts AND p.ts <= s.ts + INTERVAL 1 DAY ORDER BY ts, event_id LIMIT 1) m ON true""")
def first_match_within(t):
    e = t.events
    return J.first_match_within(e.where("event_type = 'signup'"), e.where("event_type = 'purchase'"), "user_id", "ts", "ts", "event_id", 86_400, ["event_id", "user_id", "ts"]).drop("ts")


@query("forward_asof_anchor", """SELECT o_orderkey, anchor, CASE WHEN anchor - CAST(o_orderdate AS DATE) <= 330 THEN 'anchor' ELSE 'fallback' END AS method FROM (
  SELECT o_orderkey, o_orderdate, (SELECT min(CAST(a.o_orderdate AS DATE)) FROM orders a WHERE a.o_custkey = o.o_custkey AND a.o_orderstatus = 'F' AND CAST(a.o_orderdate AS DATE) >= CAST(o.o_orderdate AS DATE) - 14) AS anchor
  FROM orders o WHERE o_orderstatus = 'O')""")
def forward_asof_anchor(t):
    o = t.orders.withColumn("d", F.col("o_orderdate").cast("date"))
    found = J.next_anchor(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"), "o_custkey", F.date_sub("d", 14), F.col("d"), ["o_orderkey", "d"])
    return found.select("o_orderkey", "anchor", F.when(F.datediff("anchor", "d") <= 330, "anchor").otherwise("fallback").alias("method"))


@query("newest_later_value", """SELECT o_orderkey, CASE WHEN (n.o_orderdate, n.o_orderkey) > (o.o_orderdate, o.o_orderkey) THEN n.o_totalprice END AS latest_value FROM orders o JOIN
  (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1) n
  ON n.o_custkey = o.o_custkey AND date_trunc('month', n.o_orderdate) = date_trunc('month', o.o_orderdate)""".replace("SELECT o_orderkey,", "SELECT o.o_orderkey,"))
def newest_later_value(t):
    o = t.orders.withColumn("month", F.trunc("o_orderdate", "month"))
    return J.newest_later(o, ["o_custkey", "month"], ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_orderkey", "latest_value")


HOLDINGS_SQL = "SELECT l_suppkey, l_partkey, year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS q, sum(l_quantity) AS shares, count(*) AS n FROM lineitem GROUP BY 1, 2, 3"


@query("adjacent_quarter", f"""WITH h AS ({HOLDINGS_SQL}), x AS (SELECT coalesce(c.l_suppkey, p.l_suppkey) AS l_suppkey, coalesce(c.l_partkey, p.l_partkey) AS l_partkey, coalesce(c.q, p.q + 1) AS q,
  c.shares AS shares, p.shares AS prior_shares, c.n AS n, p.n AS pn FROM h c FULL JOIN h p ON c.l_suppkey = p.l_suppkey AND c.l_partkey = p.l_partkey AND c.q = p.q + 1)
SELECT l_suppkey, l_partkey, CAST(q AS BIGINT) AS q, shares, prior_shares, CASE WHEN n > 1 OR pn > 1 THEN 'not combined' WHEN shares IS NULL THEN 'No longer reported' WHEN prior_shares IS NULL THEN 'Newly reported'
  WHEN shares > prior_shares THEN 'Increased' WHEN shares < prior_shares THEN 'Reduced' ELSE 'Unchanged' END AS summary FROM x""")
def adjacent_quarter(t):
    q = (F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1).cast("long")
    h = t.lineitem.groupBy("l_suppkey", "l_partkey", q.alias("q")).agg(F.sum("l_quantity").alias("shares"), F.count("*").alias("n"))
    prior = h.select("l_suppkey", "l_partkey", (F.col("q") + 1).alias("q"), F.col("shares").alias("prior_shares"), F.col("n").alias("pn"))
    summary = (
        F.when((F.col("n") > 1) | (F.col("pn") > 1), "not combined").when(F.col("shares").isNull(), "No longer reported").when(F.col("prior_shares").isNull(), "Newly reported")
        .when(F.col("shares") > F.col("prior_shares"), "Increased").when(F.col("shares") < F.col("prior_shares"), "Reduced").otherwise("Unchanged")
    )
    return h.join(prior, ["l_suppkey", "l_partkey", "q"], "full_outer").select("l_suppkey", "l_partkey", "q", "shares", "prior_shares", summary.alias("summary"))


SNAPSHOT_SQL = "SELECT o_custkey, o_orderpriority, round(sum(o_totalprice), 2) AS v FROM orders WHERE year(o_orderdate) = {} GROUP BY 1, 2"


@query("full_outer_diff", f"""WITH a AS ({SNAPSHOT_SQL.format(1996)}), b AS ({SNAPSHOT_SQL.format(1997)})
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority, a.v AS old_value, b.v AS new_value,
  CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN a.v = b.v THEN 'same' ELSE 'value_changed' END AS change
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority""")
def full_outer_diff(t):
    snap = lambda y: t.orders.where(F.year("o_orderdate") == y).groupBy("o_custkey", "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return J.changes(snap(1996), snap(1997), ["o_custkey", "o_orderpriority"], "v")


@query("dangling_refs", """WITH k AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 50)
SELECT (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM k)) AS parts_without_lines, (SELECT count(*) FROM part WHERE p_partkey IN (SELECT l_partkey FROM k)) AS parts_with_lines,
  (SELECT count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)) AS lines_without_order""")
def dangling_refs(t):
    k = t.lineitem.where("l_quantity >= 50")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    without = one(J.dangling(t.part, k, "p_partkey", "l_partkey"), "parts_without_lines")
    having = one(t.part.join(k, F.col("p_partkey") == F.col("l_partkey"), "left_semi"), "parts_with_lines")
    lost = one(J.dangling(t.lineitem, t.orders, "l_orderkey", "o_orderkey"), "lines_without_order")
    return without.crossJoin(having).crossJoin(lost)  # three tables of one row


@query("phrase_positions", """WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS term, generate_subscripts(string_split(text, ' '), 1) AS pos FROM conversations)
SELECT a.conv_id, a.turn, CAST(a.pos AS BIGINT) AS pos FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'""")
def phrase_positions(t):
    w = t.conversations.select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "term"))
    a = w.where("term = 'of'").select("conv_id", "turn", (F.col("pos") + 1).cast("long").alias("pos"))
    b = w.where("term = 'the'").select("conv_id", "turn", F.col("pos").cast("long").alias("pos"))
    return a.join(b, ["conv_id", "turn", "pos"])
