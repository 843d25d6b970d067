"""Schemas of the lake's tables, fixed on write; a table that isn't there yet reads as an empty one of its schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "filings": "accession string, cik bigint, form string, core_type string, filed_date date, report_date date, acceptance_datetime timestamp_ntz, act string, file_number string, film_number string, items array<string>, size bigint, is_xbrl boolean, is_inline_xbrl boolean, primary_doc string, primary_doc_description string, source string, year int",
    "companies": "cik bigint, name string, ticker string, exchange string, sic string, sic_description string, fiscal_year_end string, is_listed boolean, is_active boolean, last_filing_date date, last_financial_report_date date, last_financial_report_form string, filing_count bigint, header_extra string",
    "tickers": "cik bigint, ticker string, exchange string, is_primary boolean, is_current boolean, source string",
    "periods": "cik bigint, period_label string, fiscal_year int, fiscal_quarter tinyint, period_type string, period_end date, results_accession string, results_form string, results_filed_date date, earnings_release_accession string, earnings_release_filed_date date, amendment_accessions array<string>, label_method string",
    "facts": "cik bigint, taxonomy string, concept string, unit string, period_start date, period_end date, value double, accession string, fy int, fp string, form string, filed date, frame string, duration_days int, duration_kind string, is_current boolean, label string",
    "statements": "accession string, cik bigint, statement string, report int, line int, line_order int, is_parenthetical boolean, concept string, taxonomy string, segments string, label string, standard_label string, negating boolean, is_abstract boolean, is_custom boolean, iord string, crdr string, datatype string, period_start date, period_end date, period_end_rounded date, qtrs int, unit string, value double, value_presented double, is_primary_period boolean, is_subtotal boolean, parent_concept string, source string, fsds_quarter string, form string, filed_date date, checks_passed boolean",
    "statement_checks": "accession string, cik bigint, statement string, check_name string, passed boolean, lhs double, rhs double, difference double, detail string, source string",
    "documents_index": "cik bigint, accession string, seq int, doc_type string, description string, filename string, url string, size bigint, label string, kind string, is_primary boolean, rank int",
    "run_log": "run_id string, kind string, started_at timestamp_ntz, finished_at timestamp_ntz, status string, index_dates array<string>, new_filings bigint, failures array<string>, error string",
    "load_log": "quarter string, table string, raw_rows bigint, loaded_rows bigint, rejected_rows bigint, unparsed_values bigint, loaded_at timestamp_ntz",
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])
