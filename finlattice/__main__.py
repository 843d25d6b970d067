"""Command line: list the registered queries, or run one over a folder of tables and show its rows or write them."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    from finlattice.plans.catalog import ORACLE, QUERIES
    from finlattice.session import session

    p = argparse.ArgumentParser(prog="finlattice", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    sql = commands.add_parser("sql", help="the SQL that a query is held against")
    run = commands.add_parser("run", help="run a query")
    explain = commands.add_parser("explain", help="the plan of a query")
    for c in (sql, run, explain):
        c.add_argument("query", choices=sorted(QUERIES))
    for c in (run, explain):
        c.add_argument("folder", help="folder of <table>.parquet")
        c.add_argument("--master", help="Spark master; the environment's by default")
    run.add_argument("--out", help="Parquet folder for the rows, written whole; without it some are shown")
    run.add_argument("--rows", type=int, default=20, help="rows to show")
    a = p.parse_args(argv)
    if a.command == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    if a.command == "sql":
        print(ORACLE.get(a.query, "-- no SQL counterpart").strip())
        return 0
    df = QUERIES[a.query](spark or session(a.master), a.folder)
    if a.command == "explain":
        df.explain("formatted")
    elif a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        df.show(a.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
