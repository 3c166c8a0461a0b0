"""Every registered query of the library's own operators against its DuckDB counterpart."""

import duckdb
import pytest

import foliant.queries  # noqa: F401  registers the named queries
from foliant.plans import registry
from foliant.tables import NAMES


def rows(records, columns):
    def plain(x):
        if isinstance(x, float):
            return float(f"{x:.12g}") + 0.0
        return float(f"{float(x):.12g}") if type(x).__name__ == "Decimal" else str(x) if hasattr(x, "isoformat") else x

    return sorted(repr([plain(r[c]) for c in columns]) for r in records)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    got = [r.asDict() for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    relation = duck.sql(sql)
    assert sorted(relation.columns) == sorted(df.columns)
    want = [dict(zip(relation.columns, r)) for r in relation.fetchall()]
    columns = sorted(df.columns)
    assert rows(got, columns) == rows(want, columns)
