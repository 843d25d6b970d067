"""Every registered query of the core library against its SQL, on the smallest tables; and the entry point without a session."""

import math
import os
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from finlattice.plans.catalog import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
REPO = str(Path(__file__).parent.parent)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, (float, Decimal)) else v


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    got = df.collect()
    if name not in ORACLE:
        assert df.columns
        return
    want = con.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got) == sorted(repr(tuple(plain(r[k]) for k in at)) for r in want.fetchall())


def test_line_order_merge_has_all_suppliers(spark, con):
    folder = "/root/testdata/sf0.01"  # the smallest tables have ten suppliers only
    got = QUERIES["line_order_merge"](spark, folder).collect()
    want = con.sql(f"SELECT DISTINCT l_suppkey, l_returnflag || '/' || l_linestatus FROM '{folder}/lineitem.parquet'").fetchall()
    assert sorted((r.cik, r.line_key) for r in got) == sorted(want)
    lines = {}
    for r in got:
        lines.setdefault(r.cik, []).append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in lines.values())


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)


def test_command_line(spark, tmp_path, capsys):
    from finlattice.__main__ import main

    assert main(["list"]) == 0 and "universe" in capsys.readouterr().out
    assert main(["sql", "universe"]) == 0 and "SELECT" in capsys.readouterr().out
    assert main(["run", "touched_companies", FOLDER, "--out", str(tmp_path / "o")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() == QUERIES["touched_companies"](spark, FOLDER).count()


def test_fused_top_is_the_top_of_fused(spark):
    from finlattice.operators import retrieval as R

    rows = [(q, k, float((k * 7919 + q) % 211), float((k * 104729 + q * 3) % 97)) for q in range(3) for k in range(400)]
    df = spark.createDataFrame(rows, "q long, k long, a double, b double")
    parts = [df.select("q", "k", F.col(c).alias("score")) for c in ("a", "b")]
    got = sorted(tuple(r) for r in R.fused_top(parts, "q", "k", 12).collect())
    whole = sorted((r.q, -r.fused, r.k) for r in R.fused(parts, "q", "k").collect())
    assert got == sorted((q, k, -f) for q in range(3) for _, f, k in [x for x in whole if x[0] == q][:12])


def test_superseded_tells_orders_apart_whose_accessions_coincide(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(k, 7, 10.0 + k % 10, "1997-05-01") for k in (6, 12, 1000006, 2000006, 1000007)]  # 6, 12: official; 1000006, 2000006: provisional, with the accession of 6
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate string").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")).write.parquet(f"{folder}/orders.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet/*.parquet'")
    got = QUERIES["superseded"](spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(ORACLE["superseded"]).fetchall()) and got.count() == 4


def odd_vectors(spark, folder):
    """Copies, zeros, a NaN, nulls in every column, labels that are rare, signs; and the tables' SQL."""
    base = [[float((k * 7919 + d * 104729) % 97 - 48) / 16 for d in range(5)] for k in range(230)]
    rows = [(k - 100, base[k % 180], k % 7 if k % 11 else None) for k in range(420)]
    rows += [(1000, [0.0] * 5, 1), (1001, [0.0] * 5, 77), (1002, [1.0, float("nan"), 0.0, 0.0, 1.0], 2), (1003, None, 88), (1100, None, 3), (None, base[3], 99), (1200, [1e-170] * 5, 3), (1300, [1.0, 0.0, 0.0, 0.0, -1.0], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    return c


def test_diversified_topk_on_odd_vectors(spark, tmp_path, monkeypatch):
    from finlattice.operators import nearest

    c = odd_vectors(spark, str(tmp_path))
    for side, block in ((8192, 4096), (40, 3)):
        monkeypatch.setattr(nearest, "SIDE", side)
        monkeypatch.setattr(nearest, "QUERY_BLOCK", block)
        got = QUERIES["diversified_topk"](spark, str(tmp_path)).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, c.sql(ORACLE["diversified_topk"]).fetchall()))


def test_only_rows_that_can_matter_leave_a_tile(spark):
    from finlattice.operators import nearest

    df = spark.range(600).select(F.col("id").alias("vec_id"), (F.col("id") % 40).alias("label"), F.transform(F.sequence(F.lit(1), F.lit(6)), lambda d: F.sin(F.col("id") * d)).alias("embedding"))
    assert nearest.cosine_leaders(df, df.where("vec_id % 100 = 0"), "label", 12).count() <= 6 * 24


def test_scores_near_the_middle_of_two_steps():
    import numpy as np

    from finlattice.operators import nearest

    assert nearest.rounded(np.array([0.0009765625, -0.0009765625, 1e-10, float("nan")])).tolist() == [976563, -976563, 0, nearest.NAN]
    x = np.random.default_rng(1).normal(size=(50, 64)).astype(np.float32).astype(float)
    norm = np.sqrt(nearest.dots(x, x))
    i, j = np.divmod(np.arange(2500), 50)
    assert (nearest.steps(x, x).ravel() == nearest.rounded(nearest.dots(x[i], x[j]) / norm[i] / norm[j])).all()


def test_rrf_fusion_on_odd_vectors_and_repeated_ids(spark, tmp_path, monkeypatch):
    from finlattice.operators import nearest

    once, twice = str(tmp_path / "once"), str(tmp_path / "twice")
    c = odd_vectors(spark, once)
    want = c.sql(ORACLE["rrf_fusion"]).fetchall()
    v = spark.read.parquet(f"{once}/embeddings.parquet").where("vec_id < 1000 OR vec_id IS NULL")
    moved = v.where("vec_id % 3 = 0").withColumn("vec_id", (F.col("vec_id") / 9).cast("long"))  # other vectors and labels under ids that are there, queries too
    v.unionByName(v.where("vec_id % 50 = 0")).unionByName(moved).write.parquet(f"{twice}/embeddings.parquet")
    c.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{twice}/embeddings.parquet/*.parquet'")
    for folder, rows in ((once, want), (twice, c.sql(ORACLE["rrf_fusion"]).fetchall())):
        for side, block in ((8192, 4096), (40, 3)):
            monkeypatch.setattr(nearest, "SIDE", side)
            monkeypatch.setattr(nearest, "QUERY_BLOCK", block)
            got = QUERIES["rrf_fusion"](spark, folder).collect()
            assert sorted((q, v, round(f, 8)) for q, v, f in got) == sorted((q, v, round(f, 8)) for q, v, f in rows)
