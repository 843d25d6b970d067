"""Search, retrieval and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from finlattice.operators import nearest as N
from finlattice.operators import retrieval as R
from finlattice.operators import windows as W
from finlattice.plans.registry import query

WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def words(c: str = "text"):
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)


@query("search_union", """WITH h AS (SELECT p_partkey AS id, 'part' AS kind, p_name AS name, p_size AS weight FROM part WHERE p_name LIKE '%red%' UNION SELECT p_partkey, 'part', p_name, p_size FROM part WHERE p_partkey = 7
UNION SELECT s_suppkey, 'supplier', s_name, 0 FROM supplier WHERE s_suppkey = 7 UNION SELECT c_custkey, 'customer', c_name, 0 FROM customer WHERE c_name LIKE '%0007%')
SELECT id, kind, name FROM h ORDER BY (id = 7) DESC, weight DESC, kind, id LIMIT 25""")
def search_union(t):
    part = t.part.select(F.col("p_partkey").alias("id"), F.lit("part").alias("kind"), F.col("p_name").alias("name"), F.col("p_size").alias("weight"))
    supplier = t.supplier.select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.lit(0).alias("weight"))
    customer = t.customer.select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.lit(0).alias("weight"))
    hits = part.where("name LIKE '%red%'").union(part.where("id = 7")).union(supplier.where("id = 7")).union(customer.where("name LIKE '%0007%'")).distinct()
    return hits.orderBy((F.col("id") == 7).desc(), F.desc("weight"), "kind", "id").limit(25).select("id", "kind", "name")


@query("page_offset", """SELECT o_orderkey, total, CASE WHEN total > 60 THEN 60 END AS next_offset FROM (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40),
(SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'P')""")
def page_offset(t):
    return R.page(t.orders.where("o_orderstatus = 'P'"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 40, 20).select("o_orderkey", "total", "next_offset")


@query("page_keyset", "SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey, o_orderkey) > (700, 5000) ORDER BY o_custkey, o_orderkey LIMIT 50")
def page_keyset(t):
    return R.page_after(t.orders, {"o_custkey": 700, "o_orderkey": 5000}, 50).select("o_custkey", "o_orderkey")


@query("peers", """SELECT c_mktsegment, c_custkey, position FROM (SELECT c_mktsegment, c_custkey, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY coalesce(v, c_acctbal, 0) DESC, c_custkey) AS INTEGER) AS position
FROM customer LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS v FROM orders WHERE year(o_orderdate) = 2000 GROUP BY 1) ON o_custkey = c_custkey) WHERE position <= 10""")
def peers(t):
    v = t.orders.where("year(o_orderdate) = 2000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    j = t.customer.join(v, "c_custkey", "left")
    return W.ranked(j, ["c_mktsegment"], [F.coalesce("v", "c_acctbal", F.lit(0)).desc(), F.asc("c_custkey")], "position").where("position <= 10").select("c_mktsegment", "c_custkey", "position")


@query("tokens_postings", f"SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents) GROUP BY 1, 2")
def tokens_postings(t):
    return R.postings(t.documents, "doc_id", words()).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


@query("boolean_search", f"""WITH d AS (SELECT doc_id, lang, {WORDS} AS w FROM documents) SELECT doc_id, lang FROM d
WHERE (list_contains(w, 'thing') OR list_contains(w, 'mit')) AND NOT list_contains(w, 'the') AND list_contains(w, 'in')""")
def boolean_search(t):
    return t.documents.withColumn("w", words()).where(R.compiled("(thing OR mit) in NOT the", "w")).select("doc_id", "lang")


@query("phrase_search", f"""WITH d AS (SELECT doc_id, ' ' || array_to_string({WORDS}, ' ') || ' ' AS s FROM documents) SELECT doc_id FROM d WHERE contains(s, ' of the ') AND NOT contains(s, ' in the ')""")
def phrase_search(t):
    return t.documents.withColumn("w", words()).where(R.compiled('"of the" NOT "in the"', "w")).select("doc_id")


@query("search_page", f"""WITH h AS (SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IN ('en', 'de') AND source <> 'src0' AND list_contains({WORDS}, 'in'))
SELECT doc_id, lang, (SELECT count(*) FROM h) AS total FROM h ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 10""")
def search_page(t):
    hits = t.documents.where("lang IN ('en', 'de') AND source <> 'src0'").withColumn("w", words()).where(R.compiled("in", "w"))
    return R.page(hits, [F.desc("n_chars"), F.asc("doc_id")], 10, 10).select("doc_id", "lang", "total")


@query("lexical_overlap", f"""WITH b AS (SELECT item_id, list_distinct({WORDS}) AS w FROM benchmark), d AS (SELECT doc_id, list_distinct({WORDS}) AS w FROM documents),
bt AS (SELECT item_id, unnest(w) AS t FROM b), dt AS (SELECT doc_id, unnest(w) AS t FROM d), o AS (SELECT item_id, doc_id, count(*) AS overlap FROM bt JOIN dt USING (t) GROUP BY 1, 2)
SELECT item_id, doc_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS rn FROM o) WHERE rn <= 5""")
def lexical_overlap(t):
    term = lambda df, key: df.select(key, F.explode(F.array_distinct(words())).alias("t"))
    overlap = term(t.documents, "doc_id").join(term(t.benchmark, "item_id"), "t").groupBy("item_id", "doc_id").agg(F.count("*").alias("overlap"))
    return W.ranked(overlap, ["item_id"], [F.desc("overlap"), F.asc("doc_id")]).where("rn <= 5").select("item_id", "doc_id", "overlap")


COS = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))"


@query("cosine_topk", f"""SELECT query_id, vec_id, CAST(rn AS INTEGER) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COS}, 9) DESC, e.vec_id DESC) AS rn
FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id) WHERE rn <= 10""")
def cosine_topk(t):
    return R.cosine_top(t.embeddings, t.embeddings.where("vec_id % 100 = 0"), 10).select("query_id", "vec_id", "rank")


@query("rrf_fusion", f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round({COS}, 9) AS c, CAST(e.label = q.label AS INTEGER) * 10 + e.vec_id % 10 AS o FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id DESC) AS r FROM s UNION ALL SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY o DESC, vec_id DESC) FROM s WHERE o > 0),
f AS (SELECT query_id, vec_id, round(sum(1.0 / (60 + r)), 9) AS fused FROM r GROUP BY 1, 2)
SELECT query_id, vec_id, fused FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, vec_id) AS n FROM f) WHERE n <= 12""")
def rrf_fusion(t):
    return N.cosine_fused(t.embeddings, t.embeddings.where("vec_id % 100 = 0"), "label", F.col("vec_id") % 10, 12)


@query("diversified_topk", f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, round({COS}, 9) AS c FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY c DESC, vec_id) AS k FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k = 1 DESC, c DESC, vec_id) AS n FROM r)
SELECT query_id, vec_id, label, k = 1 AS first_of_label FROM n WHERE n <= 12""")
def diversified_topk(t):
    s = N.cosine_leaders(t.embeddings, t.embeddings.where("vec_id % 100 = 0"), "label", 12)
    return R.diversified_per(s, "query_id", "label", "step", "vec_id", 12).select("query_id", "vec_id", "label", "first_of_label")


@query("span_chunks")
def span_chunks(t):
    from finlattice.operators.text import spans

    return spans(t.documents, "doc_id", "text")


@query("html_to_text")
def html_to_text(t):
    from finlattice.operators.text import page_text

    return page_text(t.pages, "page_id", "html")


@query("snippets", """SELECT doc_id, pos, CASE WHEN pos > 0 THEN substr(text, CAST(greatest(1, pos - 120) AS BIGINT), CAST(pos - greatest(1, pos - 120) + 260 AS BIGINT)) ELSE substr(text, 1, 380) END AS snippet
FROM (SELECT doc_id, text, CAST(instr(lower(text), 'licensed') AS INTEGER) AS pos FROM documents WHERE contains(lower(text), 'licensed'))""")
def snippets(t):
    from finlattice.functions.core import snippet

    d = t.documents.where(F.contains(F.lower("text"), F.lit("licensed")))
    return d.select("doc_id", F.instr(F.lower("text"), "licensed").alias("pos"), snippet("text", F.lit("licensed")).alias("snippet"))


@query("index_coverage", """SELECT lang, count(*) FILTER (WHERE n_chars >= 1000) AS indexed, count(*) FILTER (WHERE n_chars < 1000 AND n_chars >= 100) AS pending, count(*) FILTER (WHERE n_chars < 100) AS failed, count(*) FILTER (WHERE n_chars < 1000) > 0 AS partial FROM documents GROUP BY 1""")
def index_coverage(t):
    n = F.col("n_chars")
    return t.documents.groupBy("lang").agg(F.count_if(n >= 1000).alias("indexed"), F.count_if((n < 1000) & (n >= 100)).alias("pending"), F.count_if(n < 100).alias("failed"), (F.count_if(n < 1000) > 0).alias("partial"))


@query("quote_verification", """SELECT b.item_id, count(*) AS supporting, CASE WHEN count(*) > 0 THEN 'supported' END AS status FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1""")
def quote_verification(t):
    return R.quotes(t.documents, t.benchmark, "item_id", "text").select("item_id", "supporting", "status")


@query("document_inventory", """SELECT doc_id, CASE WHEN n_chars > 5000 THEN 'Annual report' WHEN n_chars > 1000 THEN 'Exhibit ' || (doc_id % 99) ELSE 'Press release' END AS label, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1 AS is_primary FROM documents""")
def document_inventory(t):
    label = F.when(F.col("n_chars") > 5000, "Annual report").when(F.col("n_chars") > 1000, F.concat(F.lit("Exhibit "), F.col("doc_id") % 99)).otherwise("Press release")
    d = t.documents.select("doc_id", "source", "n_chars", label.alias("label"))
    first = d.groupBy("source").agg(F.min_by("doc_id", F.struct(-F.col("n_chars"), F.col("doc_id"))).alias("doc_id")).select("doc_id", F.lit(True).alias("first"))
    return d.join(first, "doc_id", "left").select("doc_id", "label", F.coalesce("first", F.lit(False)).alias("is_primary"))
