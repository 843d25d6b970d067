"""Arithmetic identities between stated and computed values, with tolerances and a verdict that may be unknown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finlattice.functions.core import tolerance


def identity_check(df: DataFrame, lhs: Column, rhs: Column, relative: float = 0.005, absolute: float = 1.0) -> DataFrame:
    """Adds lhs, rhs, difference, tolerance and passed; passed is null where a side is."""
    df = df.withColumn("lhs", lhs).withColumn("rhs", rhs)
    return df.withColumn("difference", F.col("lhs") - F.col("rhs")).withColumn("tolerance", tolerance("lhs", "rhs", relative, absolute)).withColumn("passed", F.abs("difference") <= F.col("tolerance"))


def first_closing(df: DataFrame, candidates: Sequence[tuple[str, Column]], rhs: Column, relative: float = 0.005, absolute: float = 1.0) -> DataFrame:
    """Adds candidate, lhs and passed: the first candidate that closes; where none does the first that has a value, failed."""
    one = lambda name, value: F.struct(F.lit(name).alias("candidate"), value.alias("lhs"), (F.abs(value - rhs) <= tolerance(value, rhs, relative, absolute)).alias("passed"))
    df = df.withColumn("__c", F.filter(F.array(*(one(n, v) for n, v in candidates)), lambda c: c["lhs"].isNotNull()))
    pick = F.coalesce(F.get(F.filter("__c", lambda c: c["passed"]), F.lit(0)), F.get("__c", F.lit(0)))
    return df.withColumn("__p", pick).select(*[c for c in df.columns if c != "__c"], "__p.*")


def tolerance_band(difference: str = "difference", limit: str = "tolerance") -> Column:
    """How far a gap is from its tolerance, as a multiple."""
    q = F.abs(difference) / F.col(limit)
    return F.when(F.col(difference).isNull(), "unknown").when(F.col(difference) == 0, "exact").when(q <= 0.5, "within half").when(q <= 1, "near miss").when(q <= 2, "just over").when(q <= 10, "over").otherwise("far over")


def failure_reason(lhs: str = "lhs", rhs: str = "rhs", limit: str = "tolerance") -> Column:
    """Of ordered reasons, the first that fits a failed check."""
    a, b = F.col(lhs), F.col(rhs)
    ratio = F.abs(a) / F.nullif(F.abs(b), F.lit(0.0))
    near = lambda x: F.abs(ratio - x) <= 0.005 * x
    return (
        F.when(F.abs(a - b) <= F.col(limit), "passed").when((a == 0) | (b == 0), "one side is zero").when(F.abs(a + b) <= F.col(limit), "opposite sign")
        .when(near(1000.0) | near(0.001) | near(1_000_000.0), "scale").when(F.abs(a - b) <= 2 * F.col(limit), "just over")
        .when(ratio.between(0.2, 5.0) & (near(4.0) | near(2.0) | near(0.5) | near(0.25)), "another period").otherwise("unexplained")
    )
