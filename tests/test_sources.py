"""Readers of raw files, on small hand-made inputs with the dirt they meet."""

import json

import pytest
from pyspark.sql import functions as F

from finlattice.sources import edgar_json, fsds, indexes, markup
from finlattice.sources.lake import Lake, write_csv


def test_tsv_counts_everything(spark, tmp_path):
    lines = ["adsh\ttag\tversion\tddate\tqtrs\tuom\tsegments\tcoreg\tvalue\tfootnote\textra", "a\tX\tus\t20240331\t1\tUSD\t\t\t12.5\tnote\tmore", "a\tY\tus\t20241301\tone\tUSD\t\t\tbad", 'a\tZ\tus\t20240331\t0\tUSD\t\t\t1\t"has\ttab"\t', "a\t1\t2\t3\t4\t5\t6\t7\t8\t9\t10\t11\t12"]
    path = tmp_path / "num.txt"
    path.write_bytes("\n".join(lines).encode() + b"\nb\tCaf\xe9 \x80\tus\t20240331\t0\tUSD\t\t\t2\t\t\n")
    rows, log = fsds.read_table(spark, str(path), "num")
    got = {r.tag: r for r in rows.collect()}
    assert got["X"].value == 12.5 and str(got["X"].ddate) == "2024-03-31" and got["X"].extra == "more" and got["X"].segments is None
    assert got["Y"].ddate is None and got["Y"].qtrs is None and got["Y"].value is None
    assert got["Z"].footnote == "has\ttab" and "Café €" in got
    r = log.first()
    assert (r.raw_rows, r.loaded_rows, r.rejected_rows, r.unparsed_values) == (5, 4, 1, 3)
    assert fsds.quarters("2023q3", "2024q2") == ["2023q3", "2023q4", "2024q1", "2024q2"]


def test_company_facts(spark):
    body = {"cik": 7, "entityName": "x", "facts": {"us-gaap": {"Assets": {"label": "Assets", "units": {"USD": [{"end": "2024-03-31", "val": 5, "accn": "a", "fy": 2024, "fp": "Q1", "form": "10-Q", "filed": "2024-05-01"}]}}, "Revenues": {"label": None, "units": {"USD": [{"start": "2024-01-01", "end": "2024-03-31", "val": 2.5, "accn": "a", "filed": "bad"}]}}}}}
    got = {r.concept: r for r in edgar_json.company_facts(spark.createDataFrame([(json.dumps(body),)], "value string")).collect()}
    assert got["Assets"].value == 5 and got["Assets"].period_start is None and str(got["Revenues"].period_start) == "2024-01-01" and got["Revenues"].filed is None


def test_submissions_headers_and_tickers(spark):
    recent = {"accessionNumber": ["0000000007-24-000001", "0000000007-24-000002"], "filingDate": ["2024-05-01", "2024-05-02"], "reportDate": ["2024-03-31", ""], "acceptanceDateTime": ["2024-05-01T16:30:00.000Z", ""], "form": ["10-Q", "8-K"], "items": ["", "2.02, 9.01"], "size": [1, 2], "isXBRL": [1, 0], "isInlineXBRL": [1, 0], "primaryDocument": ["a.htm", "b.htm"]}
    body = spark.createDataFrame([(json.dumps({"cik": "0000000007", "name": "Seven", "sic": "6021", "fiscalYearEnd": "0930", "odd": "kept", "filings": {"recent": recent}}),)], "value string")
    got = {r.form: r for r in edgar_json.filings(body).collect()}
    assert got["8-K"].items == ["2.02", "9.01"] and got["8-K"].report_date is None and got["10-Q"].is_xbrl and got["10-Q"].acceptance_datetime.hour == 16
    page = spark.createDataFrame([(7, json.dumps(recent))], "cik long, value string")
    assert edgar_json.filings(page, page_cik="cik").count() == 2
    h = edgar_json.headers(body).first()
    assert h.cik == 7 and h.fiscal_year_end == "0930" and json.loads(h.header_extra) == {"odd": "kept"}
    two = [{"fields": ["cik", "name", "ticker", "exchange"], "data": [[7, "Seven", "sv", "NYSE"], [7, "Seven", "svb", None]]}, {"0": {"cik_str": 9, "ticker": "nn", "title": "Nine"}}]
    t = edgar_json.tickers(spark.createDataFrame([(json.dumps(x),) for x in two], "value string")).collect()
    assert sorted((r.cik, r.ticker, r.exchange, r.ordinal) for r in t if r.exchange) == [(7, "SV", "NYSE", 0)] and {r.ticker for r in t} == {"SV", "SVB", "NN"}


def test_daily_indexes(spark):
    lines = ["CIK|Company Name|Form Type|Date Filed|File Name", "------", "7|Seven, Inc|10-Q|20240501|edgar/data/7/0000000007-24-000001.txt", "8|Eight|4|2024-05-01|edgar/data/8/0000000008-24-000002.txt"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert sorted((r.cik, r.form, str(r.filed_date)) for r in indexes.daily_index(df).collect()) == [(7, "10-Q", "2024-05-01"), (8, "4", "2024-05-01")]
    assert indexes.ownership_index(df).count() == 1
    with pytest.raises(Exception, match="malformed"):
        indexes.ownership_index(spark.createDataFrame([("8|Eight|4|May 1|x",)], "value string")).count()


XBRL = b"""<xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:x="http://www.w3.org/2001/XMLSchema-instance" xmlns:d="http://xbrl.org/2006/xbrldi" xmlns:g="http://fasb.org/us-gaap/2024">
<context id="i"><entity><identifier scheme="s">7</identifier></entity><period><instant>2024-03-31</instant></period></context>
<context id="d"><entity><identifier scheme="s">7</identifier><segment><d:explicitMember dimension="g:Axis">g:OneMember</d:explicitMember></segment></entity><period><startDate>2024-01-01</startDate><endDate>2024-03-31</endDate></period></context>
<unit id="u"><measure>iso4217:USD</measure></unit><unit id="p"><divide><unitNumerator><measure>iso4217:USD</measure></unitNumerator><unitDenominator><measure>shares</measure></unitDenominator></divide></unit>
<g:Assets contextRef="i" unitRef="u" decimals="-3"> 5000 </g:Assets><g:Eps contextRef="d" unitRef="p" x:nil="true"/></xbrl>"""
LINKS = b"""<l:linkbase xmlns:l="http://www.xbrl.org/2003/linkbase" xmlns:x="http://www.w3.org/1999/xlink"><l:calculationLink x:role="r"><l:loc x:label="a" x:href="s.xsd#g_Assets"/><l:loc x:label="b" x:href="s.xsd#g_Cash"/>
<l:calculationArc x:from="a" x:to="b" order="2" weight="-1"/><l:calculationArc x:from="a" x:to="b" use="prohibited"/></l:calculationLink></l:linkbase>"""
FORM4 = b"""<ownershipDocument><issuer><issuerCik>7</issuerCik></issuer><reportingOwner><reportingOwnerId><rptOwnerCik>11</rptOwnerCik></reportingOwnerId></reportingOwner><nonDerivativeTable><nonDerivativeTransaction>
<securityTitle><value>Common</value></securityTitle><transactionDate><value>2024-05-01</value></transactionDate><transactionCoding><transactionCode>P</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>10</value></transactionShares></transactionAmounts>
<postTransactionAmounts><sharesOwnedFollowingTransaction><value>110</value></sharesOwnedFollowingTransaction></postTransactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"""


def test_markup(spark):
    rows = [("ok", bytearray(XBRL)), ("bad", bytearray(b"<a><b></a>")), ("dtd", bytearray(b"<!DOCTYPE a><a/>")), ("deep", bytearray(b"<a>" * 100 + b"</a>" * 100))]
    got = markup.parsed(spark.createDataFrame(rows, "path string, content binary"), "facts").collect()
    ok = {r.concept: r for r in got if r.path == "ok"}
    assert ok["Assets"].value == "5000" and ok["Assets"].unit == "USD" and ok["Assets"].start is None and ok["Eps"].is_nil and ok["Eps"].unit == "USD/shares" and ok["Eps"].dimensions == "Axis=OneMember;"
    assert {r.path for r in got if r.error} == {"bad", "dtd", "deep"}
    assert markup.arcs(LINKS, "calculation") == [("r", "g_Assets", "g_Cash", 2.0, -1.0, None)]
    assert markup.transactions(FORM4) == [("7", "11", "Common", "2024-05-01", "P", "10", None, "110", None)]
    info = b"<t xmlns='n'><infoTable><nameOfIssuer>X</nameOfIssuer><cusip>abc123456</cusip><value>5</value><shrsOrPrnAmt><sshPrnamt>9</sshPrnamt></shrsOrPrnAmt></infoTable></t>"
    assert markup.holdings(info)[0][:5] == ("X", None, "ABC123456", "5", "9")
    page = b"<table><tr><th>Seq</th></tr><tr><td>1</td><td>Quarterly report</td><td><a href='/a/b/q.htm'>q.htm</a></td><td>10-Q</td><td>123</td></tr></table>"
    assert markup.filing_documents(page) == [(1, "Quarterly report", "q.htm", "10-Q", 123, "/a/b/q.htm")]
    assert markup.file_roles(["x_cal.xml", "x_htm.xml", "x.xsd", "R1.xml", "FilingSummary.xml"]) == {"calculation": "x_cal.xml", "schema": "x.xsd", "instance": "x_htm.xml"}


def test_lake(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    assert lake.table("facts").count() == 0
    rows = spark.createDataFrame([("a", 1, 2023), ("b", 2, 2024)], "accession string, cik long, year int")
    lake.overwrite_partitions("filings", rows, ["year"], ["cik"])
    lake.overwrite_partitions("filings", spark.createDataFrame([("c", 2, 2024)], rows.schema), ["year"])
    assert sorted(r.accession for r in lake.table("filings").collect()) == ["a", "c"] and lake.table("filings", [1]).count() == 1
    lake.register()
    assert spark.sql("SELECT count(*) AS n FROM statements").first().n == 0
    with pytest.raises(ValueError, match="facts"):
        lake.publish("out", rows, ["filings", "facts"])
    lake.publish("out", rows)
    lake.publish("out", rows.where("cik = 1"))
    assert lake.published("out").count() == 1
    cells = spark.createDataFrame([("=1+1",), ("x",)], "c string")
    write_csv(cells, str(tmp_path / "csv"))
    assert sorted(r.c for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()) == ["'=1+1", "x"]
    with pytest.raises(ValueError):
        write_csv(cells, str(tmp_path / "csv2"), 1)


def test_stream_reruns_are_no_ops(spark, tmp_path):
    from finlattice.streaming.daily import keyed_stream

    rows = lambda *r: spark.createDataFrame(list(r), "k int, ts int, v string").coalesce(1)
    rows((1, 1, "a"), (2, 1, "b")).write.parquet(str(tmp_path / "in"))
    run = lambda: sorted(map(tuple, keyed_stream(spark, str(tmp_path / "in"), ["k"], "ts", F.lit(True), str(tmp_path / "work")).collect()))
    assert run() == run() == [(1, 1, "a"), (2, 1, "b")]
    rows((1, 2, "late"), (2, 0, "older")).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == [(1, 2, "late"), (2, 1, "b")]
