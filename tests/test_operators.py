"""Named small cases of the core operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from finlattice.functions import core as C
from finlattice.operators import identity as I
from finlattice.operators import joins as J
from finlattice.operators import retrieval as R
from finlattice.operators import windows as W
from finlattice.operators.state import entitled, superseded, upsert_filings
from finlattice.operators.text import html_text, span_bounds
from finlattice.operators.trees import walk, weighted_totals

D = dt.date


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_month_end_round(spark):
    rows = spark.createDataFrame([(D(2024, 2, 3),), (D(2024, 9, 28),), (D(2024, 1, 15),), (D(2024, 1, 16),)], "d date")
    assert [r.x for r in rows.select(C.month_end_round("d").alias("x")).collect()] == [D(2024, 1, 31), D(2024, 9, 30), D(2023, 12, 31), D(2024, 1, 31)]


def test_durations(spark):
    rows = spark.createDataFrame([(None, D(2024, 3, 31)), (D(2024, 1, 1), D(2024, 3, 31)), (D(2023, 10, 1), D(2024, 9, 28)), (D(2024, 1, 1), D(2024, 1, 20))], "s date, e date")
    got = rows.select(C.duration_kind("s", "e").alias("k"), C.quarters_estimate("s", "e").alias("q")).collect()
    assert [(r.k, r.q) for r in got] == [("instant", 0), ("quarter", 1), ("year", 4), ("other", 1)]


def test_safe_date_and_fiscal_year(spark):
    rows = spark.createDataFrame([(2023, 2, 31), (2024, 2, 30), (2024, 13, 1)], "y int, m int, d int")
    assert [r.x for r in rows.select(C.safe_date("y", "m", "d").alias("x")).collect()] == [D(2023, 2, 28), D(2024, 2, 29), None]
    drift = spark.createDataFrame([(D(2024, 2, 3), 1, 31), (D(2025, 1, 2), 12, 31), (D(2024, 6, 30), 12, 31)], "d date, m int, k int")
    assert [r.x for r in drift.select(C.fiscal_year_of("d", "m", "k").alias("x")).collect()] == [2024, 2024, 2024]


def test_forms_and_units(spark):
    f = spark.createDataFrame([("10-K/A",), ("8-K",), ("10-Q",), (None,)], "form string")
    got = f.select(C.base_form("form").alias("b"), C.is_amendment("form").alias("a"), C.form_family("form").alias("y")).collect()
    assert [(r.b, r.a) for r in got] == [("10-K", True), ("8-K", False), ("10-Q", False), (None, False)]
    u = spark.createDataFrame([("USD", "perShareItemType"), ("USD/shares", "perShareItemType"), ("USD", "monetaryItemType"), ("shares", "sharesItemType")], "u string, t string")
    assert [r.x for r in u.select(C.per_share_unit("u", "t").alias("x")).collect()] == ["USD/shares", "USD/shares", "USD", "shares"]


def test_identity_verdict_is_three_valued(spark):
    df = spark.createDataFrame([(100.0, 100.4), (100.0, 102.0), (1e9, 1.004e9), (None, 3.0)], "a double, b double")
    assert [r.passed for r in I.identity_check(df, F.col("a"), F.col("b")).orderBy(F.col("b")).collect()] == [None, True, False, True]


def test_first_closing_prefers_order_and_reports_preferred_failure(spark):
    df = spark.createDataFrame([(1, 10.0, 20.0, 20.0), (2, 10.0, 11.0, 50.0), (3, None, 50.0, 50.0)], "k int, a double, b double, r double")
    got = I.first_closing(df, [("a", F.col("a")), ("b", F.col("b"))], F.col("r")).orderBy("k").collect()
    assert [(r.candidate, r.passed) for r in got] == [("b", True), ("a", False), ("b", True)]


@pytest.mark.parametrize("lhs, rhs, reason", [(1.0, 1.5, "passed"), (0.0, 50.0, "one side is zero"), (-900.0, 900.0, "opposite sign"), (5000.0, 5.0, "scale"), (100.0, 101.5, "just over"), (400.0, 100.0, "another period"), (330.0, 100.0, "unexplained")])
def test_failure_reasons(spark, lhs, rhs, reason):
    df = spark.createDataFrame([(lhs, rhs)], "a double, b double")
    assert I.identity_check(df, F.col("a"), F.col("b")).select(I.failure_reason().alias("x")).first().x == reason


def test_next_flagged_looks_strictly_below(spark):
    df = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True)], "k int, o int, t boolean")
    assert [r.p for r in W.next_flagged(df, ["k"], ["o"], F.col("t"), "o", "p").orderBy("o").collect()] == [3, 3, None]


def test_first_match_window_is_open_below_and_closed_above(spark):
    t0 = dt.datetime(2024, 1, 1)
    left = spark.createDataFrame([(1, "a", t0)], "id int, u string, ts timestamp_ntz")
    for offset, hit in ((0, None), (1, 9), (3600, 9), (3601, None)):
        right = spark.createDataFrame([(9, "a", t0 + dt.timedelta(seconds=offset))], "id int, u string, ts timestamp_ntz")
        assert J.first_match_within(left, right, "u", "ts", "ts", "id", 3600, ["id", "u", "ts"]).first().matched_id == hit


def test_changes_and_missing(spark):
    a, b = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "k int, v double"), spark.createDataFrame([(2, 2.0), (3, 4.0), (4, 4.0)], "k int, v double")
    assert {r.k: r.change for r in J.changes(a, b, ["k"], "v").collect()} == {1: "removed", 2: "same", 3: "value_changed", 4: "added"}
    assert sorted((r.k, r.v) for r in J.keep_missing(a, b, ["k"]).collect() if r.v is None) == [(1, None)]


def test_upsert_keeps_rich_rows_and_replaces_whole_ciks(spark):
    s = "cik long, accession string, source string, v int"
    old = spark.createDataFrame([(1, "a", "submissions", 1), (2, "b", "daily_index", 2), (3, "c", "submissions", 3)], s)
    new = spark.createDataFrame([(1, "a", "daily_index", 10), (2, "b", "submissions", 20), (3, "d", "submissions", 30)], s)
    got = {(r.cik, r.accession): r.v for r in upsert_filings(old, new, spark.createDataFrame([(3,)], "cik long")).collect()}
    assert got == {(1, "a"): 1, (2, "b"): 20, (3, "d"): 30}
    again = upsert_filings(upsert_filings(old, new), new)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, upsert_filings(old, new).collect()))


def test_official_rows_supersede(spark):
    s = "cik long, accession string, v int"
    got = superseded(spark.createDataFrame([(1, "a", 1), (1, "b", 2)], s), spark.createDataFrame([(1, "a", 9)], s))
    assert sorted(r.v for r in got.collect()) == [2, 9]


def test_entitlement_needs_every_document(spark):
    docs = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "artifact string, doc int")
    got = {r.artifact: r.permitted for r in entitled(docs, spark.createDataFrame([(1,)], "doc int"), "artifact", ["doc"]).collect()}
    assert got == {"x": False, "y": True}


def test_walk_breaks_cycles(spark):
    arcs = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a"), ("r", "c")], "p string, c string")
    assert sorted(r.path for r in walk(arcs, "p", "c", "r").collect()) == ["r", "r/a", "r/a/b", "r/c"]
    w = spark.createDataFrame([("t", "x", 1.0), ("t", "y", -1.0)], "parent string, child string, weight double")
    assert weighted_totals(w, spark.createDataFrame([("x", 5.0), ("y", 2.0)], "child string, value double")).first().total == 3.0


@pytest.mark.parametrize("query", ["", "NOT a", "a OR NOT b", "(a", "a)", '"a', "a AND", "OR a", "x" * 1001, " ".join(["a"] * 65), "(" * 14 + "a" + ")" * 14, "--"])
def test_search_refuses(query):
    with pytest.raises(R.QueryError):
        R.parse(query)


def test_search_binds_not_and_or(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, ["a", "c"]), (4, ["cat", "b"])], "id int, w array<string>")
    ids = lambda q: sorted(r.id for r in df.where(R.compiled(q, "w")).collect())
    assert ids("a b OR c") == [1, 2, 3] and ids("a NOT c") == [1] and ids('"a b"') == [1] and ids("(a OR c) NOT b") == [2, 3] and ids("ca") == []


def test_fusion_ties_go_to_the_greater_key(spark):
    r = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.5), (0, 3, 0.9)], "g int, k int, score double")
    got = {x.k: x.fused for x in R.fused([r], "g", "k").collect()}
    assert got[3] > got[2] > got[1]


def test_spans_cover_and_overlap():
    text = " ".join(f"word{i}" for i in range(2000))
    b = span_bounds(text)
    assert b[0][0] == 0 and b[-1][1] == len(text) and all(e - s <= 1600 for s, e in b) and all(n[0] == max(p[0] + 1, p[1] - 160) for p, n in zip(b, b[1:], strict=False))
    assert span_bounds("") == [] and span_bounds("x" * 4000)[0] == (0, 1600)


def test_html_text_hides_what_readers_do_not_see():
    html = "<html><head><title>t</title></head><body><p>One <b>two</b>&amp;</p><script>x</script><div style='display: none'>no<br>no</div><ix:header>h</ix:header><p hidden>z</p><p>Three"
    assert html_text(html) == "One two&\nThree"
