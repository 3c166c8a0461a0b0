"""Sums and roundings at their limits."""

import datetime

import foliant.queries  # noqa: F401  registers the named queries
from foliant.plans import registry


def test_halves_round_to_even(spark, tmp_path):
    # 12,500 / 5,000 is 2.5: two characters as SQL's cast has it, not three.
    rows = [(1, 1, "5-LOW", 12500.0), (1, 2, "5-LOW", 7500.0)]
    spark.createDataFrame(rows, "o_custkey long, o_orderkey long, o_orderpriority string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    assert [tuple(r) for r in registry.queries()["prompt_fill"](spark, str(tmp_path)).orderBy("position").collect()] == [(1, 1, 1, 202), (1, 2, 2, 404)]


def test_a_sum_on_the_budget_fits_in_any_order(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    units = [435.47, 786.71, 663.08, 114.74]  # as doubles 2000.0000000000002 from the left
    rows = [(i, at(i), "a", v) for i, v in enumerate(units)] + [(20 + i, at(i), "b", v) for i, v in enumerate(reversed(units))]
    rows += [(40, at(0), "c", float("nan")), (50, at(0), "d", 1e300), (51, at(1), "d", None), (60, at(0), "e", -5.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: (r.admitted, r.used_60s) for r in registry.queries()["rolling_budget"](spark, str(tmp_path)).collect()}
    assert got[3] == got[23] == (True, 2000.0) and len(got) == len(rows)
    assert not got[40][0] and got[51] == (False, 1e300) and got[60] == (True, 0.0)
