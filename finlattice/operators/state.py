"""Keyed upserts, scope resolution and entitlements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finlattice.operators.windows import first_per_key


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column], replaced: DataFrame | None = None) -> DataFrame:
    """One row per key of both, the first in order. Rows of old whose keys stand in `replaced` (authoritative refetches) go first."""
    if replaced is not None:
        old = old.join(replaced, replaced.columns, "left_anti")
    return first_per_key(old.unionByName(new, allowMissingColumns=True), keys, order)


def upsert_filings(old: DataFrame, new: DataFrame, replace_ciks: DataFrame | None = None) -> DataFrame:
    """Filings keyed by (cik, accession): a stub of the daily index never replaces a richer row; else the new row wins, the last given first."""
    if replace_ciks is not None:
        old = old.join(replace_ciks.select("cik").distinct(), "cik", "left_anti")
    stub = (F.col("source") == "daily_index").cast("int")
    o = old.withColumn("__new", F.lit(0)).withColumn("__at", F.lit(0).cast("long"))
    n = new.withColumn("__new", F.lit(1)).withColumn("__at", F.col("given") if "given" in new.columns else F.lit(0).cast("long"))
    both = o.unionByName(n.drop("given"), allowMissingColumns=True).withColumn("__stub", stub)
    return first_per_key(both, ["cik", "accession"], [F.asc("__stub"), F.desc("__new"), F.desc("__at")]).drop("__new", "__at", "__stub")


def superseded(provisional: DataFrame, official: DataFrame, keys: Sequence[str] = ("cik", "accession")) -> DataFrame:
    """Official rows, and provisional rows of filings that have no official ones."""
    return official.unionByName(provisional.join(official.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def resolve_scope(df: DataFrame, scopes: Sequence[tuple[str, Column]], default: Column) -> DataFrame:
    """Adds preference and scope: the value of the first scope that has one."""
    scope = F.coalesce(*(F.when(v.isNotNull(), F.lit(name)) for name, v in scopes), F.lit("default"))
    return df.withColumn("preference", F.coalesce(*(v for _, v in scopes), default)).withColumn("scope", scope)


def entitled(documents: DataFrame, grants: DataFrame, artifact: str, on: Sequence[str]) -> DataFrame:
    """Per artifact whether every document that it draws on is granted; documents without a grant refuse it."""
    g = grants.select(*on).distinct().withColumn("__granted", F.lit(True))
    seen = documents.select(artifact, *on).distinct().join(g, list(on), "left")
    return seen.groupBy(artifact).agg(F.bool_and(F.coalesce("__granted", F.lit(False))).alias("permitted"))


def inventory_gate(found: DataFrame, required: DataFrame, key: str) -> DataFrame:
    """Required sources with the rows found for each, and whether the inventory is complete; a publication needs all of them."""
    counts = found.groupBy(key).agg(F.count("*").alias("n"))
    return required.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0).cast("long")).alias("n"), (F.coalesce("n", F.lit(0)) > 0).alias("complete"))
