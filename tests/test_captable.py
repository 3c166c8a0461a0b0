"""Cap tables: rows are shuffled by holder and by company, and names that repeat meet as in SQL."""

import datetime
import random

import duckdb
import pytest

import foliant.queries  # noqa: F401  registers the named queries
from foliant.plans import registry


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name, most", [("register_reconciliation", 3), ("diluted_checks", 3), ("founder_rubric", 3), ("ownership_by_role", 4)])
def test_lines_are_dealt_by_holder_and_company_only(spark, sf, name, most):
    df = registry.queries()[name](spark, sf)
    assert shuffles(df) <= most


def test_equal_names_and_words_meet_as_in_sql(spark, tmp_path):
    r = random.Random(5)
    parts = [(p, " ".join(r.choice(["ash", "bay", "stranger"]) for _ in range(r.randint(1, 3))), f"Brand#{p % 2}", r.randint(1, 30), 9.5) for p in range(1, 60)]
    parts += parts[:9]  # rows that are there twice count twice
    lines = [(r.randint(1, 6), r.randint(1, 65), r.choice("ANR"), float(r.randint(1, 50)), datetime.datetime(r.randint(1995, 2001), 3, 4)) for _ in range(600)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_returnflag string, l_quantity double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for name in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("register_reconciliation", "diluted_checks", "founder_rubric", "ownership_by_role"):
        got = registry.queries()[name](spark, str(tmp_path))
        want = con.sql(registry.oracle_sql()[name])
        rows = lambda found, columns: sorted(repr([float(f"{x:.10g}") if isinstance(x, float) else x for x in (dict(zip(columns, row))[c] for c in sorted(columns))]) for row in found)
        assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), want.columns), name
