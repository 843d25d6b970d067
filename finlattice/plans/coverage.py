"""Coverage, invariants, serving reads and ownership events over rows made from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finlattice.operators import coverage as V
from finlattice.operators import grid as G
from finlattice.operators import holdings as H
from finlattice.plans.derivation import YTD_SQL, ytd
from finlattice.plans.library import DAY, FORMS, day
from finlattice.plans.registry import Tables, query

QEND = "last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1))"
LABELS = "CASE quarter(o_orderdate) WHEN 4 THEN 'FY' || year(o_orderdate) ELSE 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) END"


def filings(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("cik"), F.col("o_orderkey").cast("string").alias("accession"), F.expr(FORMS).alias("form"), day().alias("filed_date"), (F.col("o_orderkey") % 4 != 0).alias("is_xbrl"))


def periods(t: Tables) -> DataFrame:
    """One period per customer and quarter with orders: filed by the quarter's last order, released by its first urgent one."""
    end = F.last_day(F.make_date(F.year("o_orderdate"), F.quarter("o_orderdate") * 3, F.lit(1)))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    quarter, year = F.quarter("o_orderdate"), F.year("o_orderdate")
    label = F.when(quarter == 4, F.concat(F.lit("FY"), year)).otherwise(F.concat(F.lit("Q"), quarter, F.lit(" "), year))
    g = t.orders.groupBy(F.col("o_custkey").alias("cik"), label.alias("period_label"), quarter.alias("fiscal_quarter"), end.alias("period_end")).agg(
        F.max(F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey"))).cast("string").alias("results_accession"), F.min(F.when(urgent, F.col("o_orderkey"))).cast("string").alias("earnings_release_accession"),
        F.min(F.when(urgent, F.date_add(day(), 95))).alias("earnings_release_filed_date"), F.max(F.date_add(end, (F.col("o_orderkey") % 40).cast("int"))).alias("results_filed_date"), F.bool_and(F.col("o_totalprice") > 1500).alias("checks_passed"),
    )
    return g


PERIODS = f"""SELECT o_custkey AS cik, {LABELS} AS period_label, quarter(o_orderdate) AS fiscal_quarter, {QEND} AS period_end, max(CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END) AS accession, min(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END) AS release,
  min(CASE WHEN o_orderpriority = '1-URGENT' THEN {DAY} + 95 END) AS released, max({QEND} + CAST(o_orderkey % 40 AS INTEGER)) AS filed, bool_and(o_totalprice > 1500) AS checks_passed FROM orders GROUP BY 1, 2, 3, 4"""


@query("filings_list", f"SELECT o_custkey AS cik, CAST(o_orderkey AS VARCHAR) AS accession, {DAY} AS filed_date FROM orders WHERE {FORMS} = '10-Q' AND {DAY} BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' ORDER BY {DAY} DESC, CAST(o_orderkey AS VARCHAR) DESC LIMIT 40")
def filings_list(t):
    return V.filings_list(filings(t), "10-Q", "1997-01-01", "1998-12-31", 40).select("cik", "accession", "filed_date")


@query("touched_companies", f"SELECT DISTINCT o_custkey AS cik FROM orders WHERE {FORMS} LIKE '10-%' AND year(o_orderdate) = 2001")
def touched_companies(t):
    return V.touched_companies(filings(t).where("year(filed_date) = 2001"), ["10-K", "10-Q"])


@query("replace_touched", """SELECT o_orderkey, o_custkey, CASE WHEN o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0) THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS value FROM orders
WHERE NOT (o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0) AND o_orderstatus = 'P')""")
def replace_touched(t):
    rows = t.orders.select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("value"))
    fresh = t.orders.where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 2, 2).alias("value"))
    return V.replace_touched(rows, fresh, ["o_custkey"], t.orders.where("o_orderkey % 50 = 0").select("o_custkey"))


@query("reader_set", f"""WITH w AS (SELECT s_suppkey AS row_id, s_name AS ticker, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END AS given, CASE WHEN s_suppkey % 2 = 0 THEN '10-K' ELSE '10-Q' END AS form, CASE WHEN s_suppkey % 4 = 0 THEN 1999 END AS year FROM supplier),
o AS (SELECT s_name AS t, min(CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey + 1 END) AS owner FROM supplier GROUP BY 1), c AS (SELECT w.*, coalesce(given, owner) AS cik FROM w LEFT JOIN o ON o.t = w.ticker AND owner IS NOT NULL),
f AS (SELECT o_custkey AS k, {FORMS} AS form, CAST(o_orderkey AS VARCHAR) AS accession, {DAY} AS d FROM orders WHERE o_orderkey % 4 <> 0),
h AS (SELECT row_id, arg_max(accession, (d, accession)) AS accession, max(d) AS d FROM c JOIN f ON f.k = c.cik AND f.form = c.form AND (c.year IS NULL OR year(f.d) = c.year) GROUP BY 1)
SELECT c.row_id, CAST(c.cik AS VARCHAR) AS cik, c_name AS name, c.form, h.accession, h.d AS filed_date, CASE WHEN c.cik IS NULL THEN 'ticker ' || c.ticker || ' not in the universe' WHEN h.accession IS NULL THEN 'no XBRL ' || c.form || ' filing' || coalesce(' filed in ' || c.year, '') END AS error
FROM c LEFT JOIN h ON h.row_id = c.row_id LEFT JOIN customer ON c_custkey = c.cik""")
def reader_set(t):
    k = F.col("s_suppkey")
    wanted = t.supplier.select(k.alias("row_id"), F.col("s_name").alias("ticker"), F.when(k % 3 == 0, k).alias("cik"), F.when(k % 2 == 0, "10-K").otherwise("10-Q").alias("form"), F.when(k % 4 == 0, 1999).alias("year"))
    tickers = t.supplier.where("s_suppkey % 5 <> 0").select((k + 1).alias("cik"), F.lower("s_name").alias("ticker"), F.lit(True).alias("is_primary"), F.lit(True).alias("is_current"))
    # A former owner of each ticker, which must not be taken.
    tickers = tickers.unionByName(tickers.select((F.col("cik") - 1).alias("cik"), "ticker", "is_primary", F.lit(False).alias("is_current")))
    return V.reader_set(wanted, tickers, t.customer.select(F.col("c_custkey").alias("cik"), F.col("c_name").alias("name")), filings(t)).withColumn("cik", F.col("cik").cast("string"))


@query("release_coverage", f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY period_end DESC, period_label DESC) AS n, date_diff('day', period_end, released) AS lag FROM ({PERIODS}))
SELECT cik, count(*) AS periods, count(release) AS released, count(*) FILTER (WHERE NOT lag BETWEEN 1 AND 90) AS odd_lags, CAST(coalesce(max(lag), -1) AS INTEGER) AS longest_lag FROM p WHERE n <= 8 GROUP BY 1""")
def release_coverage(t):
    return V.release_coverage(periods(t)).fillna(-1, ["longest_lag"])


@query("duration_distribution", """SELECT CASE l_linenumber % 5 WHEN 0 THEN 'instant' WHEN 1 THEN 'quarter' WHEN 2 THEN 'half' WHEN 3 THEN 'nine_months' ELSE 'year' END AS duration_kind, count(*) AS facts, count(DISTINCT l_suppkey) AS companies, count(DISTINCT l_returnflag) AS concepts FROM lineitem GROUP BY 1""")
def duration_distribution(t):
    k = F.col("l_linenumber") % 5
    f = t.lineitem.select(F.col("l_suppkey").alias("cik"), F.col("l_returnflag").alias("concept"), F.when(k > 0, F.date_sub(day("l_shipdate"), k * 91)).alias("period_start"), day("l_shipdate").alias("period_end"))
    return V.duration_distribution(f)


@query("company_pages", f"""WITH k AS (SELECT s_suppkey % 100 AS cik, string_agg(s_name, ',' ORDER BY s_suppkey) AS tickers FROM supplier GROUP BY 1), f AS (SELECT o_custkey AS cik, count(*) AS n, arg_max(CAST(o_orderkey AS VARCHAR), ({DAY}, CAST(o_orderkey AS VARCHAR))) AS a, arg_max({FORMS}, ({DAY}, CAST(o_orderkey AS VARCHAR))) AS form FROM orders GROUP BY 1),
p AS (SELECT cik, max(period_end) AS e, median(date_diff('day', period_end, filed)) AS lag FROM ({PERIODS}) GROUP BY 1)
SELECT c_custkey AS cik, c_name AS name, coalesce(tickers, '') AS tickers, a AS latest_accession, form AS latest_form, coalesce(n, 0) AS filings, e AS last_period_end, CAST(last_day(CAST(e + INTERVAL 3 MONTH AS DATE)) + CAST(ceil(lag) AS INTEGER) AS DATE) AS next_expected
FROM customer LEFT JOIN k ON k.cik = c_custkey LEFT JOIN f ON f.cik = c_custkey LEFT JOIN p ON p.cik = c_custkey""")
def company_pages(t):
    tickers = t.supplier.select((F.col("s_suppkey") % 100).alias("cik"), F.col("s_name").alias("ticker"), F.col("s_suppkey").alias("ordinal"))
    out = V.company_pages(t.customer.select(F.col("c_custkey").alias("cik"), F.col("c_name").alias("name")), tickers, filings(t), periods(t))
    return out.withColumn("tickers", F.array_join("tickers", ","))


@query("golden_companies", f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY period_end DESC, period_label DESC) AS k FROM ({PERIODS})),
g AS (SELECT cik, count(*) AS n, count(*) FILTER (WHERE fiscal_quarter = 4) AS annual, count(*) FILTER (WHERE accession IS NULL) AS unfiled, min(accession) FILTER (WHERE k = 1) AS accession, count(*) FILTER (WHERE NOT checks_passed) AS failed FROM p WHERE k <= 20 GROUP BY 1),
l AS (SELECT l_orderkey, bool_or(l_linestatus = 'O') AS o, bool_or(l_linestatus = 'F') AS f FROM lineitem GROUP BY 1),
r AS (SELECT c_custkey AS cik, CASE WHEN n IS NULL THEN 'no periods' WHEN annual = 0 THEN 'no annual period' WHEN unfiled > 0 THEN 'periods with no results filing' WHEN NOT coalesce(o, false) THEN 'no income statement' WHEN NOT coalesce(f, false) THEN 'no balance sheet' WHEN failed > 0 THEN 'arithmetic checks failed' END AS reason
FROM customer LEFT JOIN g ON g.cik = c_custkey LEFT JOIN l ON l_orderkey = accession) SELECT cik, reason IS NULL AS passed, reason FROM r""")
def golden_companies(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").cast("string").alias("accession"), F.when(F.col("l_linestatus") == "O", "IS").otherwise("BS").alias("statement")).agg(F.count("*").alias("n"))
    return V.golden_companies(t.customer.select(F.col("c_custkey").alias("cik")), periods(t), lines)


@query("seeded_sample")
def seeded_sample(t):
    return V.seeded_sample(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"], 25, seed=7)


@query("run_row", f"SELECT 'r1' AS run_id, 'daily' AS kind, 'partial' AS status, (SELECT count(*) FROM orders WHERE {DAY} BETWEEN DATE '1999-03-01' AND DATE '1999-03-07') AS new_filings, (SELECT string_agg(DISTINCT CAST({DAY} AS VARCHAR), ',' ORDER BY CAST({DAY} AS VARCHAR)) FROM orders WHERE {DAY} BETWEEN DATE '1999-03-01' AND DATE '1999-03-07') AS index_dates, 'nation 3,nation 7' AS failures")
def run_row(t):
    failures = t.nation.where("n_nationkey IN (3, 7)").select(F.concat(F.lit("nation "), F.col("n_nationkey")).alias("failure"))
    r = V.run_row("daily", "r1", F.lit(None).cast("timestamp_ntz"), failures, filings(t).where("filed_date BETWEEN DATE '1999-03-01' AND DATE '1999-03-07'"))
    return r.select("run_id", "kind", "status", "new_filings", F.array_join("index_dates", ",").alias("index_dates"), F.array_join("failures", ",").alias("failures"))


@query("pending_quarters", """WITH q AS (SELECT DISTINCT year(o_orderdate) || 'q' || quarter(o_orderdate) AS quarter FROM orders), l AS (SELECT year(o_orderdate) || 'q' || quarter(o_orderdate) AS quarter, o_orderstatus AS s, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 1200) AS loaded, count(*) FILTER (WHERE o_totalprice <= 1100) AS rejected FROM orders WHERE year(o_orderdate) < 2001 GROUP BY 1, 2)
SELECT quarter FROM q WHERE (SELECT count(*) FROM l WHERE l.quarter = q.quarter AND s IN ('F', 'O') AND loaded + rejected >= n) < 2""")
def pending_quarters(t):
    quarter = F.concat(F.year("o_orderdate"), F.lit("q"), F.quarter("o_orderdate"))
    log = t.orders.where("year(o_orderdate) < 2001").groupBy(quarter.alias("quarter"), F.col("o_orderstatus").alias("table")).agg(F.count("*").alias("raw_rows"), F.count_if(F.col("o_totalprice") > 1200).alias("loaded_rows"), F.count_if(F.col("o_totalprice") <= 1100).alias("rejected_rows"))
    return V.pending_quarters(t.orders.select(quarter.alias("quarter")).distinct(), log, ["F", "O"])


@query("rerank_candidates", """WITH s AS (SELECT doc_id, doc_id // 50 AS v, n_chars AS pos, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda x: x IN ('idiot', 'die', 'que', 'licensed'))) AS shared FROM documents),
f AS (SELECT doc_id, 0 AS round, pos AS k, CAST(v AS VARCHAR) AS tie FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY pos, doc_id) AS n FROM s) WHERE n = 1 ORDER BY pos, v LIMIT 40),
r AS (SELECT doc_id, 1 AS round, -shared AS k, lpad(CAST(doc_id AS VARCHAR), 20, '0') AS tie FROM s WHERE doc_id NOT IN (SELECT doc_id FROM f) ORDER BY shared DESC, doc_id LIMIT 40)
SELECT doc_id AS span_id, round FROM (SELECT * FROM f UNION ALL SELECT * FROM r) ORDER BY round, k, tie LIMIT 40""")
def rerank_candidates(t):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0))
    s = t.documents.select(F.col("doc_id").alias("span_id"), F.floor(F.col("doc_id") / 50).alias("version_id"), F.col("n_chars").alias("start_offset"), words.alias("words"))
    return V.rerank_candidates(s, ["the", "idiot", "die", "que", "licensed", "of"], 40)


# Ownership.


@query("ingested_versions", """WITH a AS (SELECT o_custkey AS filing, o_orderpriority AS content_hash, min(o_orderdate) AS first FROM orders GROUP BY 1, 2)
SELECT filing, content_hash, first, row_number() OVER (PARTITION BY filing ORDER BY first DESC, content_hash DESC) = 1 AS is_current, count(*) OVER (PARTITION BY filing) > 1 AS revised FROM a""")
def ingested_versions(t):
    o = t.orders.select(F.col("o_custkey").alias("filing"), F.col("o_orderpriority").alias("content_hash"), F.col("o_orderdate").alias("arrived_at"), "o_orderkey")
    return H.ingested(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1 OR o_orderkey % 4 = 0"))


@query("event_cards", f"""SELECT o_orderkey AS filing, o_custkey % 30 AS issuer, CASE o_orderkey % 3 WHEN 0 THEN 'Reporting persons unavailable' WHEN 1 THEN 'A' || o_custkey ELSE 'A' || o_custkey || '; Unnamed reporting person' END AS name, CASE WHEN o_orderkey % 5 = 0 THEN {DAY} + 3 ELSE {DAY} END AS date,
  CASE WHEN o_orderstatus = 'P' THEN 'Amendment' ELSE 'Disclosed beneficial ownership' END AS badge, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'A' || o_custkey || ': shares ' || (o_orderkey % 100) ELSE 'A' || o_custkey || ': shares ' || (o_orderkey % 100) || '|Reporting person: percent 5%' END AS metrics FROM orders""")
def event_cards(t):
    person = lambda n, s, p: F.struct(n.alias("name"), s.cast("long").alias("shares"), p.cast("long").alias("percent"))
    null = F.lit(None)
    one, two = person(F.concat(F.lit("A"), F.col("o_custkey")), F.col("o_orderkey") % 100, null), person(null.cast("string"), null, F.lit(5))
    k = F.col("o_orderkey") % 3
    e = t.orders.select(F.col("o_orderkey").alias("filing"), (F.col("o_custkey") % 30).alias("issuer"), F.when(F.col("o_orderstatus") == "P", "SC 13D/A").otherwise("SC 13D").alias("form"), F.when(F.col("o_orderkey") % 5 != 0, day()).alias("event_date"), F.date_add(day(), 3).alias("filed_date"),
        F.when(k == 1, F.array(one)).when(k == 2, F.array(one, two)).alias("people"))
    return H.event_cards(e).withColumn("metrics", F.array_join("metrics", "|"))


@query("notification_events", f"""WITH f AS (SELECT o_orderkey AS filing, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS issuer, {FORMS} AS form, {DAY} AS d FROM orders WHERE {DAY} >= DATE '2000-01-01'), m AS (SELECT s_suppkey AS cusip, s_suppkey % 20 AS cik FROM supplier WHERE s_suppkey % 3 = 0)
SELECT issuer AS cik, filing, form, d AS filed_date FROM f WHERE issuer % 10 = 3 UNION SELECT m.cik, f.filing, f.form, f.d FROM f JOIN lineitem ON l_orderkey = filing JOIN m ON m.cusip = l_suppkey WHERE f.issuer IS NULL AND m.cik % 10 = 3 AND m.cik IN (SELECT c_custkey FROM customer)""")
def notification_events(t):
    f = t.orders.select(F.col("o_orderkey").alias("filing"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("issuer"), F.expr(FORMS).alias("form"), day().alias("filed_date"))
    positions = t.lineitem.select(F.col("l_orderkey").alias("filing"), F.col("l_suppkey").alias("cusip"))
    mapping = t.supplier.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("cusip"), (F.col("s_suppkey") % 20).alias("cik"))
    return H.notification_events(f, positions, mapping, t.customer.where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("cik")), F.lit("2000-01-01").cast("date"))


@query("ownership_coverage", """SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS parsed, count(*) FILTER (WHERE o_orderstatus = 'O') AS pending, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, CAST(0 AS BIGINT) AS unsupported, max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS last_successful_at,
  count(*) FILTER (WHERE o_orderkey % 6 = 0 AND o_orderstatus <> 'F') AS unassigned, (SELECT count(*) FROM lineitem WHERE l_suppkey % 3 <> 0) AS unmatched_positions FROM orders""")
def ownership_coverage(t):
    status = F.element_at(F.create_map(*(F.lit(x) for x in ("F", "parsed", "O", "pending", "P", "failed"))), F.col("o_orderstatus"))
    states = t.orders.select(status.alias("status"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("last_successful_at"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_custkey")).alias("issuer"))
    return H.ownership_coverage(states, t.lineitem.select(F.col("l_suppkey").alias("cusip")), t.lineitem.where("l_suppkey % 3 = 0").select(F.col("l_suppkey").alias("cusip")))


@query("sync_queue", f"""SELECT o_orderkey AS filing, CAST(CASE WHEN o_orderstatus = 'P' THEN o_orderkey % 5 ELSE 0 END AS INTEGER) AS tries FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0 OR o_orderstatus = 'P' AND o_orderkey % 5 < 3
ORDER BY CASE WHEN o_orderstatus = 'P' THEN o_orderkey % 5 ELSE 0 END, {DAY}, o_orderkey LIMIT 300""")
def sync_queue(t):
    registered = t.orders.select(F.col("o_orderkey").alias("filing"), day().alias("filed_date"))
    # Every second open filing has been parsed, pending ones have been tried before, and open even ones never.
    states = t.orders.where("o_orderstatus <> 'O' OR o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("filing"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("parsed").alias("status"), (F.col("o_orderkey") % 5).cast("int").alias("tries"))
    return H.sync_queue(registered, states, 300)


# Grids.


@query("aligned_keys", """WITH r AS (SELECT o_custkey % 200 AS cik, o_orderpriority AS concept, o_orderkey, o_orderdate AS filed, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS accession, o_orderpriority || '|' || o_orderstatus AS line_key, CASE WHEN o_orderkey % 97 = 0 THEN 'EUR' ELSE 'USD' END AS unit FROM orders),
s AS (SELECT *, min(unit) OVER c = max(unit) OVER c AS sound, first_value(line_key) OVER (PARTITION BY cik, concept ORDER BY filed DESC, accession DESC) AS newest FROM r WINDOW c AS (PARTITION BY cik, concept))
SELECT accession, line_key, CASE WHEN sound THEN newest ELSE line_key END AS aligned_key FROM s""")
def aligned_keys(t):
    rows = t.orders.select((F.col("o_custkey") % 200).alias("cik"), F.lit("IS").alias("statement"), F.col("o_orderpriority").alias("concept"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("accession"), F.col("o_orderdate").alias("filed"), F.lit("e").alias("period_end"), F.lit(4).alias("qtrs"),
        F.lit("us-gaap/2024").alias("taxonomy"), F.when(F.col("o_orderkey") % 97 == 0, "EUR").otherwise("USD").alias("unit"), F.concat_ws("|", "o_orderpriority", "o_orderstatus").alias("line_key"))
    return G.aligned_keys(rows).select("accession", "line_key", "aligned_key")


@query("opening_balances", f"""WITH y AS ({YTD_SQL}), m AS (SELECT 'quarterly' AS mode UNION ALL SELECT 'ltm')
SELECT mode, a.nation, a.fy, a.n, b.ytd AS opening, CASE WHEN b.ytd IS NULL THEN 'the opening balance for this period is unavailable' END AS reason FROM m, y a LEFT JOIN y b ON b.nation = a.nation
  AND CASE WHEN mode = 'ltm' THEN b.fy = a.fy - 1 AND b.n = a.n WHEN a.n = 1 THEN b.fy = a.fy - 1 AND b.n = 4 ELSE b.fy = a.fy AND b.n = a.n - 1 END""")
def opening_balances(t):
    i = ytd(t).select(F.col("nation").alias("cik"), F.lit("BS").alias("statement"), F.lit("x").alias("line_key"), F.col("fy").alias("fiscal_year"), "n", F.col("ytd").alias("value"))
    out = [G.opening_balances(i, mode).select(F.lit(mode).alias("mode"), F.col("cik").alias("nation"), F.col("fiscal_year").alias("fy"), "n", "opening", "reason") for mode in ("quarterly", "ltm")]
    return out[0].unionByName(out[1])


@query("trailing_year_basis", f"""WITH y AS ({YTD_SQL}) SELECT c.nation, c.fy, c.n, CASE WHEN c.n = 4 THEN 'reported' WHEN p.ytd IS NOT NULL AND c.nation % 4 = 0 THEN 'unavailable' WHEN f.ytd IS NULL OR p.ytd IS NULL THEN 'unavailable' ELSE 'derived' END AS status,
  CASE WHEN c.n = 4 THEN NULL WHEN p.ytd IS NOT NULL AND c.nation % 4 = 0 THEN 'the later comparative changed' WHEN f.ytd IS NULL THEN 'no fiscal year before it' WHEN p.ytd IS NULL THEN 'no year to date before it' END AS reason,
  CASE WHEN c.n = 4 THEN 'a:' || CAST(CAST(c.ytd AS DECIMAL(30,2)) AS VARCHAR) WHEN f.ytd IS NULL OR p.ytd IS NULL OR c.nation % 4 = 0 THEN '' ELSE 'a:' || CAST(CAST(c.ytd AS DECIMAL(30,2)) AS VARCHAR) || ' + a:' || CAST(CAST(f.ytd AS DECIMAL(30,2)) AS VARCHAR) || ' - a:' || CAST(CAST(p.ytd AS DECIMAL(30,2)) AS VARCHAR) END AS formula
FROM y c LEFT JOIN y f ON f.nation = c.nation AND f.fy = c.fy - 1 AND f.n = 4 LEFT JOIN y p ON p.nation = c.nation AND p.fy = c.fy - 1 AND p.n = c.n""")
def trailing_year_basis(t):
    c = ytd(t).select(
        F.col("nation").cast("long").alias("cik"), F.lit("CF").alias("statement"), F.lit("x").alias("line_key"), F.lit("X").alias("concept"), F.col("fy").alias("fiscal_year"), "n", F.col("n").alias("duration"), F.round("ytd", 2).alias("value"),
        F.lit("USD").alias("unit"), F.lit("us-gaap").alias("taxonomy"), F.make_date("fy", F.lit(1), F.lit(1)).alias("start"), F.last_day(F.make_date("fy", 3 * F.col("n"), F.lit(1))).alias("end"), F.lit("a").alias("accession"), F.lit(False).alias("negating"),
    )
    # Every fourth nation restates last year's figure in this year's filing.
    shown = c.where("n < 4").select("cik", "statement", "line_key", "concept", (F.col("fiscal_year") + 1).alias("fiscal_year"), "n", F.when(F.col("cik") % 4 == 0, F.col("value") + 1).otherwise(F.col("value")).alias("value"))
    out = G.trailing_year(c, shown)
    return out.select(F.col("cik").cast("int").alias("nation"), F.col("fiscal_year").alias("fy"), "n", "status", "reason", G.formula(F.col("sources")).alias("formula"))


# As-reported statements: each order a filing, each line number a presented line.
TAGS = {1: "Revenues", 2: "CostOfSales", 3: "GrossProfit", 4: "ByRegion", 5: "QuarterOnly", 6: "Heading", 7: "Assets"}


@query("as_reported_statements", f"""WITH g AS (SELECT l_orderkey AS k, l_linenumber AS n, sum(l_quantity) AS q, any_value(make_date(year(o_orderdate), 12, 31)) AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
r AS (SELECT k, n, CAST(NULL AS VARCHAR) AS segments, p AS e, 4 AS qtrs, q AS v, p AS own FROM g WHERE n <= 3 UNION ALL SELECT k, n, NULL, CAST(p - INTERVAL 1 YEAR AS DATE), 4, q / 2, p FROM g WHERE n <= 2
  UNION ALL SELECT k, n, 'Seg=A;', p, 4, q * 0.25, p FROM g WHERE n = 4 UNION ALL SELECT k, n, 'Seg=B;', p, 4, q * 0.75, p FROM g WHERE n = 4 UNION ALL SELECT k, n, NULL, NULL, NULL, NULL, p FROM g WHERE n IN (5, 6)
  UNION ALL SELECT k, n, NULL, p, 0, q, p FROM g WHERE n = 7 UNION ALL SELECT k, n, NULL, CAST(p - INTERVAL 1 YEAR AS DATE), 0, q / 2, p FROM g WHERE n = 7),
s AS (SELECT *, CASE n {" ".join(f"WHEN {k} THEN '{v}'" for k, v in TAGS.items())} END AS concept, CASE WHEN n = 7 THEN 'BS' ELSE 'IS' END AS statement FROM r),
d AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY k, statement ORDER BY n, segments NULLS FIRST) AS INTEGER) AS line_order FROM s)
SELECT CAST(k AS VARCHAR) AS accession, statement, line_order, concept, segments, e AS period_end_rounded, coalesce(CAST(qtrs AS VARCHAR), '') AS qtrs, v AS value, CASE WHEN n = 2 THEN -v ELSE v END AS value_presented, e IS NULL OR e = own AS is_primary_period,
  (SELECT arg_min(x.concept, x.line_order) FROM d x WHERE x.k = d.k AND x.statement = d.statement AND x.line_order > d.line_order AND x.n IN (1, 3, 7)) AS parent_concept FROM d""")
def as_reported_statements(t):
    from finlattice.operators.statements import build_statements

    version, end = F.lit("us-gaap/2024"), F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31))
    g = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"), F.min(end).alias("p"))
    name = F.element_at(F.create_map(*(F.lit(x) for kv in TAGS.items() for x in kv)), F.col("l_linenumber"))
    g = g.select(F.col("l_orderkey").cast("string").alias("adsh"), F.col("l_linenumber").alias("line"), name.alias("tag"), version.alias("version"), "q", "p")
    sub = t.orders.select(F.col("o_orderkey").cast("string").alias("adsh"), F.col("o_custkey").alias("cik"), F.lit("10-K").alias("form"), end.alias("period"), F.lit("FY").alias("fp"), day().alias("filed"))
    pre = g.select("adsh", F.lit(2).alias("report"), "line", F.when(F.col("line") == 7, "BS").otherwise("IS").alias("stmt"), F.lit(0).alias("inpth"), "tag", "version", F.col("tag").alias("plabel"), (F.col("line") == 2).cast("int").alias("negating"))
    tags = t.spark.createDataFrame([(v, "us-gaap/2024", 0, int(k == 6), "monetary", "I" if k == 7 else "D", "C", v) for k, v in TAGS.items()], "tag string, version string, custom int, abstract int, datatype string, iord string, crdr string, tlabel string")
    fact = lambda at, qtrs, value, unit="USD", segments=None: F.struct(at.alias("ddate"), F.lit(qtrs).alias("qtrs"), F.lit(unit).alias("uom"), F.lit(segments).cast("string").alias("segments"), value.cast("double").alias("value"))
    q, now, before, n = F.col("q"), F.col("p"), F.add_months("p", -12), F.col("line")
    values = (  # totals, comparatives, quarters that no annual report states as its own, another currency, breakdowns beside a total and alone
        F.when(n == 1, F.array(fact(now, 4, q), fact(before, 4, q / 2), fact(now, 1, q / 4))).when(n == 2, F.array(fact(now, 4, q), fact(before, 4, q / 2), fact(now, 4, q * 2, "EUR")))
        .when(n == 3, F.array(fact(now, 4, q), fact(now, 4, q / 4, segments="Seg=A;"))).when(n == 4, F.array(fact(now, 4, q * 0.25, segments="Seg=A;"), fact(now, 4, q * 0.75, segments="Seg=B;")))
        .when(n == 5, F.array(fact(now, 1, q))).when(n == 7, F.array(fact(now, 0, q), fact(before, 0, q / 2)))
    )
    num = g.select("adsh", "tag", "version", F.lit(None).cast("string").alias("coreg"), F.explode(values).alias("v")).select("adsh", "tag", "version", "coreg", "v.*")
    out = build_statements(sub, num, pre, tags)
    return out.select("accession", "statement", F.col("line_order").cast("int").alias("line_order"), "concept", "segments", "period_end_rounded", F.coalesce(F.col("qtrs").cast("string"), F.lit("")).alias("qtrs"), "value", "value_presented", "is_primary_period", "parent_concept")


CONCEPTS = ("DepreciationDepletionAndAmortization", "OtherComprehensiveIncomeX", "DividendsPaid", "PaymentsToSuppliers", "Inventory", "InterestPaidNet", "Revenues")


@query("concept_classes", f"""WITH c AS (SELECT CASE l_linenumber {" ".join(f"WHEN {k + 1} THEN '{c}'" for k, c in enumerate(CONCEPTS))} END AS concept, l_linestatus = 'O' AS instant FROM lineitem)
SELECT concept, instant, CASE WHEN concept LIKE 'Depreciation%' THEN CASE WHEN instant THEN 'CF' ELSE 'IS' END WHEN concept LIKE 'Other%' THEN 'CI' WHEN concept LIKE 'Dividends%' THEN 'EQ' WHEN concept LIKE 'Payments%' OR concept LIKE 'InterestPaid%' THEN 'CF' WHEN instant THEN 'BS' ELSE 'IS' END AS statement, count(*) AS n FROM c GROUP BY 1, 2, 3""")
def concept_classes(t):
    from finlattice.operators.statements import statement_of

    concept = F.element_at(F.array(*map(F.lit, CONCEPTS)), F.col("l_linenumber"))
    c = t.lineitem.select(concept.alias("concept"), (F.col("l_linestatus") == "O").alias("instant"))
    return c.withColumn("statement", statement_of("concept", F.col("instant"))).groupBy("concept", "instant", "statement").agg(F.count("*").alias("n"))
