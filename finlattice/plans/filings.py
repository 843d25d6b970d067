"""Filing operators over statement rows made from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finlattice.operators import checks as K
from finlattice.operators import documents as D
from finlattice.operators import grid as G
from finlattice.plans.derivation import YTD_SQL, ytd
from finlattice.plans.registry import Tables, query

# Each order stands for a filing: its total and the sums of its lines for the concepts that identities relate.
SUMS = {"gross": "l_extendedprice", "cost": "l_extendedprice * l_discount", "net": "l_extendedprice * (1 - l_discount)", "tax": "l_extendedprice * (1 - l_discount) * l_tax"}
LINES = [
    ("BS", "Assets", "o_totalprice"), ("BS", "Liabilities", "round(gross / 2, 2)"), ("BS", "StockholdersEquity", "round(o_totalprice - gross / 2, 2)"), ("BS", "MinorityInterest", "CASE WHEN o_orderstatus = 'P' THEN 500.0 END"),
    ("IS", "Revenues", "gross"), ("IS", "CostOfRevenue", "cost"), ("IS", "GrossProfit", "CASE WHEN o_orderkey % 3 = 0 THEN round(net * 1.02, 2) ELSE net END"),
]


def statement_rows(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy("l_orderkey").agg(*(F.round(F.sum(F.expr(v)), 6).alias(k) for k, v in SUMS.items()))
    o = t.orders.join(s, F.col("o_orderkey") == F.col("l_orderkey"))
    line = lambda st, c, v: F.struct(F.lit(st).alias("statement"), F.lit(c).alias("concept"), F.expr(v).cast("double").alias("value"))
    rows = o.select(F.col("o_custkey").alias("cik"), F.col("o_orderkey").cast("string").alias("accession"), F.explode(F.array(*(line(*x) for x in LINES))).alias("r")).select("cik", "accession", "r.*")
    return rows.select("*", F.lit(True).alias("is_primary_period"), F.lit(False).alias("is_parenthetical"), F.lit(None).cast("string").alias("segments"), F.lit("2024-12-31").cast("date").alias("period_end_rounded"))


@query("filing_checks", f"""WITH s AS (SELECT l_orderkey, {", ".join(f"round(sum({v}), 6) AS {k}" for k, v in SUMS.items())} FROM lineitem GROUP BY 1), o AS (SELECT * FROM orders JOIN s ON o_orderkey = l_orderkey),
r AS (SELECT o_custkey AS cik, CAST(o_orderkey AS VARCHAR) AS accession, 'assets_eq_liabilities_plus_equity' AS check_name, o_totalprice AS lhs,
  round(gross / 2, 2) + round(o_totalprice - gross / 2, 2) + CASE WHEN o_orderstatus = 'P' THEN 500.0 ELSE 0.0 END AS rhs FROM o
UNION ALL SELECT o_custkey, CAST(o_orderkey AS VARCHAR), 'gross_profit', gross - cost, CASE WHEN o_orderkey % 3 = 0 THEN round(net * 1.02, 2) ELSE net END FROM o)
SELECT cik, accession, check_name, abs(lhs - rhs) <= greatest(1.0, 0.005 * greatest(abs(lhs), abs(rhs))) AS passed FROM r""")
def filing_checks(t):
    return K.filing_checks(statement_rows(t)).select("cik", "accession", "check_name", "passed")


@query("grid_quarters", f"""WITH y AS ({YTD_SQL}) SELECT a.nation, a.fy, a.n, CASE WHEN a.n = 1 THEN round(a.ytd, 2) ELSE round(a.ytd - b.ytd, 2) END AS value,
  CASE WHEN a.n = 1 THEN 'reported' WHEN b.ytd IS NULL THEN 'unavailable' WHEN a.nation % 9 = 0 THEN 'unavailable' ELSE 'derived' END AS status,
  CASE WHEN a.n = 1 THEN NULL WHEN b.ytd IS NULL THEN 'no value before it' WHEN a.nation % 9 = 0 THEN 'per-share values don''t add up' END AS reason
FROM y a LEFT JOIN y b ON a.nation = b.nation AND a.fy = b.fy AND b.n = a.n - 1""".replace("CASE WHEN a.n = 1 THEN round(a.ytd, 2) ELSE", "CASE WHEN a.n = 1 THEN round(a.ytd, 2) WHEN a.nation % 9 = 0 THEN NULL ELSE"))
def grid_quarters(t):
    unit = F.when(F.col("nation") % 9 == 0, "USD/shares").otherwise("USD")
    c = ytd(t).select(
        F.col("nation").cast("long").alias("cik"), F.lit("CF").alias("statement"), F.lit("x").alias("line_key"), F.lit("X").alias("concept"), F.col("fy").alias("fiscal_year"), "n", F.col("n").alias("duration"),
        F.col("ytd").alias("value"), unit.alias("unit"), F.lit("us-gaap").alias("taxonomy"), F.make_date("fy", F.lit(1), F.lit(1)).alias("start"), F.make_date("fy", 3 * F.col("n"), F.lit(28)).alias("end"), F.lit("a").alias("accession"), F.lit(False).alias("negating"),
    )
    q = G.quarters(c)
    return q.select(F.col("cik").cast("int").alias("nation"), F.col("fiscal_year").alias("fy"), "n", F.round("value", 2).alias("value"), "status", "reason")


@query("line_order_merge")
def line_order_merge(t):
    rows = t.lineitem.groupBy(F.col("l_suppkey").cast("long").alias("cik"), F.year("l_shipdate").alias("filed"), "l_returnflag", "l_linestatus").agg(F.min("l_linenumber").alias("line_order"))
    return G.merge_order(rows.select("cik", F.lit("IS").alias("statement"), F.concat_ws("/", "l_returnflag", "l_linestatus").alias("line_key"), "line_order", "filed"))


@query("page_contents")
def page_contents(t):
    return D.tables_of_contents(t.pages, "page_id", "html")


@query("page_phrase_hits")
def page_phrase_hits(t):
    return D.phrase_hits(t.pages, "page_id", "html", "de la")


@query("labelled_documents", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Annual report' WHEN doc_id % 3 = 1 THEN 'Exhibit 10.1: Material contract' ELSE 'Quarterly report (amended)' END AS label,
  CASE WHEN doc_id % 3 = 1 THEN 'exhibit' ELSE 'form' END AS kind, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY CASE WHEN doc_id % 3 = 1 THEN 110 ELSE 0 END, doc_id) = 1 AS is_primary FROM documents""")
def labelled_documents(t):
    kind = F.when(F.col("doc_id") % 3 == 0, "10-K").when(F.col("doc_id") % 3 == 1, "EX-10.1").otherwise("10-Q/A")
    d = t.documents.select("doc_id", F.floor(F.col("doc_id") / 10).alias("cik"), F.lit("a").alias("accession"), F.col("doc_id").alias("seq"), kind.alias("doc_type"), F.lit("").alias("description"))
    return D.labelled_documents(d).select("doc_id", "label", "kind", "is_primary")


@query("snapshot_hash")
def snapshot_hash(t):
    cells = t.lineitem.groupBy(F.col("l_suppkey").alias("cik"), "l_returnflag", F.year("l_shipdate").alias("fy")).agg(F.round(F.sum("l_quantity"), 2).alias("value"))
    return G.snapshot(cells)
