"""Documents, research answers and feeds."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from finlattice.operators import documents, research


def test_labels(spark):
    rows = [(1, "a", 1, "10-K/A", ""), (1, "a", 2, "EX-99.1", "Earnings release"), (1, "a", 3, "EX-10.2", "x"), (1, "a", 4, "GRAPHIC", ""), (1, "a", 5, "EX-99.2", "slides"), (1, "a", 6, "N-PX", "")]
    got = {r.seq: r for r in documents.labelled_documents(spark.createDataFrame(rows, "cik long, accession string, seq int, doc_type string, description string")).collect()}
    assert got[1].label == "Annual report (amended)" and got[1].is_primary and got[2].label == "Earnings release" and got[2].rank == 1
    assert got[3].label == "Exhibit 10.2: Material contract" and got[4].kind == "other" and got[5].label == "Exhibit 99.2: Additional exhibit" and got[6].label == "N-PX"


def test_pages(spark):
    html = "<h1>One</h1><p>Cash  and\ncash equivalents</p><h2>Two <b>b</b></h2><p>cash and cash equivalents</p>"
    df = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert [(r.level, r.title) for r in documents.tables_of_contents(df, "page_id", "html").orderBy("position").collect()] == [(1, "One"), (2, "Two b")]
    assert documents.phrase_hits(df, "page_id", "html", "cash and cash").count() == 2
    pair = spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc\nd"), (2, "s", "s")], "id long, o string, n string")
    assert [(r.kind, r.old_text, r.new_text) for r in documents.version_changes(pair, "id", "o", "n").orderBy("hunk").collect()] == [("replace", "b", "x"), ("insert", "", "d")]


def test_calculator():
    text = "Revenue was $1,250.5 and (40) against 1,000 and 0"
    assert research.calculate("sum", ["1,250.5", "(40)"], text) == Decimal("1210.5")
    assert research.calculate("growth", ["1,250.5", "1,000"], text) == Decimal("0.2505") and research.calculate("difference", ["1,000", "(40)"], text) == 1040
    assert len(str(research.calculate("ratio", ["1,000", "1,250.5"], text))) > 40
    for bad in (("ratio", ["1,000", "0"]), ("sum", ["7", "8"]), ("power", ["1,000", "0"]), ("growth", ["1,000"])):
        with pytest.raises(ValueError):
            research.calculate(*bad, text)


def test_eligibility_quotes_and_ranking(spark):
    d, t = dt.date, dt.datetime
    v = spark.createDataFrame([(1, "x", d(2024, 1, 1), t(2024, 1, 2)), (2, "x", d(2024, 1, 1), t(2024, 6, 1)), (3, "y", d(2024, 3, 1), t(2024, 1, 2)), (4, "z", None, t(2024, 1, 1))], "version_id long, document_id string, filed_date date, captured_at timestamp_ntz")
    s = spark.createDataFrame([(10, 1, "net sales rose", ["net", "sales"], [1.0, 0.0]), (11, 1, "costs fell", ["costs"], [0.9, 0.1]), (20, 2, "later", ["net"], [0.0, 1.0]), (30, 3, "other", ["sales"], [0.5, 0.5])], "span_id long, version_id long, text string, terms array<string>, embedding array<double>")
    at = lambda x: F.lit(x).cast("date")
    assert sorted(r.span_id for r in research.eligible_spans(s, v, at("2024-02-01")).collect()) == [10, 11]
    assert sorted(r.span_id for r in research.eligible_spans(s, v, at("2024-12-01")).collect()) == [20, 30]
    assert [r.span_id for r in research.ranked_spans(s, [1.0, 0.0], ["net", "sales"], 3).collect()] == [10, 30, 20]
    c = spark.createDataFrame([(1, 10, "sales rose", "for"), (1, 11, "costs fell", "against"), (2, 10, "sales fell", "for"), (3, 99, "x", "for")], "claim_id int, span_id long, quote string, stance string")
    assert {r.claim_id: r.status for r in research.verified_quotes(c, s).collect()} == {1: "contested", 2: "unsupported", 3: "unsupported"}


def test_digests_tickers_and_model_cells(spark):
    f = spark.createDataFrame([(1, "a", "10-Q", []), (1, "b", "8-K", ["2.02"]), (1, "c", "8-K", ["5.02"]), (2, "d", "10-K", [])], "cik long, accession string, form string, items array<string>").withColumn("filed_date", F.current_date())
    got = research.digest_rows(f, spark.createDataFrame([("r", [1])], "reader string, ciks array<long>"), spark.createDataFrame([("r", "a")], "reader string, accession string"))
    assert [r.accession for r in got.collect()] == ["b"]
    t = spark.createDataFrame([(5, "AB", False, True), (7, "AB", True, False)], "cik long, ticker string, is_current boolean, is_primary boolean")
    assert research.ticker_owner(t, "ab").first().cik == 7 and research.ticker_owner(t, "5").first().cik == 5
    m = spark.createDataFrame([(1, "IS", "x", "FY2024", 1.0), (1, "IS", "y", "FY2024", 2.0), (2, "IS", "x", "FY2024", 1.0), (2, "IS", "q", "FY2024", 1.0)], "cik long, statement string, line_key string, period_label string, current double")
    g = spark.createDataFrame([(1, "IS", "x", "FY2024", 1.0), (1, "IS", "y", "FY2024", 3.0), (2, "IS", "x", "FY2024", 9.0)], "cik long, statement string, line_key string, period_label string, value double")
    got = {(r.cik, r.line_key): (r.status, r.proposed) for r in research.model_cells(m, g).collect()}
    assert got == {(1, "x"): ("unchanged", 1.0), (1, "y"): ("ready", 3.0), (2, "x"): ("ready", None), (2, "q"): ("missing", None)}
