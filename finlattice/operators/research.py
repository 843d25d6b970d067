"""Answers over cited spans: who may be read, hybrid ranking, literal arithmetic, quotes."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal, InvalidOperation, localcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finlattice.operators import retrieval as R

MAX_VERSIONS, MAX_SPANS = 500, 5000


def eligible_spans(spans: DataFrame, versions: DataFrame, as_of: Column) -> DataFrame:
    """Spans of the one current version of each document that was both filed and captured by as_of. A scope beyond the limits is refused, not cut."""
    v = R.current_versions(versions, "document_id", "captured_at", as_of)
    if v.limit(MAX_VERSIONS + 1).count() > MAX_VERSIONS:
        raise ValueError(f"more than {MAX_VERSIONS} documents; narrow the question")
    s = spans.join(v.select("version_id", "document_id"), "version_id")
    if s.limit(MAX_SPANS + 1).count() > MAX_SPANS:
        raise ValueError(f"more than {MAX_SPANS} passages; narrow the question")
    return s


def overlap(spans: DataFrame, terms: Sequence[str]) -> DataFrame:
    return spans.withColumn("overlap", F.size(F.array_intersect("terms", F.array(*map(F.lit, terms)))))


def ranked_spans(spans: DataFrame, question_vector: Sequence[float], terms: Sequence[str], k: int = 12) -> DataFrame:
    """Passages by fused cosine and term-overlap ranks: one of each document first, then the rest, to k."""
    q = spans.sparkSession.createDataFrame([(-1, [float(x) for x in question_vector])], "span_id bigint, embedding array<double>")
    one = R.cosines(spans.withColumn("embedding", F.col("embedding").cast("array<double>")), q, "span_id")
    lexical = overlap(one, terms)
    both = R.fused([one.select("query_id", "span_id", "score"), lexical.where("overlap > 0").select("query_id", "span_id", F.col("overlap").cast("double").alias("score"))], "query_id", "span_id")
    j = both.join(spans.select("span_id", "version_id"), "span_id")
    return R.diversified(j, "version_id", F.desc("fused"), "span_id", k).withColumnRenamed("first_of_label", "first_of_version")


def number(text: str) -> Decimal:
    """A number as filings print it: separators, a currency sign, percent and parentheses for negatives; nothing else."""
    s = text.strip().replace(",", "").replace("$", "").replace("%", "").strip()
    negative = s.startswith("(") and s.endswith(")")
    try:
        value = Decimal(s.strip("()").strip())
    except InvalidOperation as e:
        raise ValueError(f"not a number: {text!r}") from e
    return -value if negative else value


def calculate(operation: str, operands: Sequence[str], span_text: str) -> Decimal:
    """sum, difference, ratio or growth of numbers that stand in a span word for word, to 50 digits."""
    if any(o not in span_text for o in operands):
        raise ValueError("an operand isn't in the passage")
    with localcontext() as c:
        c.prec = 50
        values = [number(o) for o in operands]
        if operation == "sum" and len(values) >= 2:
            return sum(values, Decimal(0))
        if len(values) != 2 or operation not in ("difference", "ratio", "growth"):
            raise ValueError("operation doesn't fit its operands")
        a, b = values
        if operation == "difference":
            return a - b
        if b == 0:
            raise ValueError("the base is zero")
        return a / b if operation == "ratio" else (a - b) / abs(b)


def verified_quotes(claims: DataFrame, spans: DataFrame) -> DataFrame:
    """(claim_id, supporting, opposing, refused, status) of claims (claim_id, span_id, quote, stance): a quote counts only if its span holds it word for word."""
    j = claims.join(spans.select("span_id", F.col("text").alias("__text")), "span_id", "left")
    holds = F.coalesce(F.contains("__text", "quote") & (F.length("quote") > 0), F.lit(False))
    g = j.groupBy("claim_id").agg(F.count_if(holds & (F.col("stance") == "for")).alias("supporting"), F.count_if(holds & (F.col("stance") == "against")).alias("opposing"), F.count_if(~holds).alias("refused"))
    return g.withColumn("status", F.when(F.col("supporting") == 0, "unsupported").when(F.col("opposing") > 0, "contested").otherwise("supported"))


def digest_rows(filings: DataFrame, subscriptions: DataFrame, receipts: DataFrame) -> DataFrame:
    """New results filings of each reader's companies that the reader hasn't had."""
    from finlattice.functions.core import is_results_filing

    wanted = subscriptions.select("reader", F.explode("ciks").alias("cik")).distinct()
    new = filings.where(is_results_filing("form", "items")).select("cik", "accession", "form", "filed_date")
    return new.join(wanted, "cik").join(receipts.select("reader", "accession").distinct(), ["reader", "accession"], "left_anti")


def ticker_owner(tickers: DataFrame, ticker: str) -> DataFrame:
    """The company that a ticker or a company number stands for now: the current owner first, then the primary listing."""
    match = F.col("cik") == int(ticker) if ticker.isdigit() else F.upper("ticker") == ticker.upper()
    return tickers.where(match).orderBy(F.desc_nulls_last("is_current"), F.desc_nulls_last("is_primary"), "cik").limit(1)


def model_cells(mapping: DataFrame, grid: DataFrame) -> DataFrame:
    """Mapped cells of a model with the value each would take: ready, unchanged, missing or ambiguous; nothing is proposed unless all of a company's cells are ready or unchanged."""
    key = ["cik", "statement", "line_key", "period_label"]
    g = grid.groupBy(*key).agg(F.count("*").alias("n"), F.first("value").alias("proposed"))
    j = mapping.join(g, key, "left")
    status = F.when(F.col("n").isNull() | F.col("proposed").isNull(), "missing").when(F.col("n") > 1, "ambiguous").when(F.col("proposed").eqNullSafe(F.col("current")), "unchanged").otherwise("ready")
    from pyspark.sql import Window

    whole = F.bool_and(F.col("status").isin("ready", "unchanged")).over(Window.partitionBy("cik"))
    return j.withColumn("status", status).withColumn("proposed", F.when(whole, F.col("proposed")))
