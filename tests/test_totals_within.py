"""Counts and sums of the points within intervals, without their pairs."""

import random

import pytest

from bayesloom import catalog, catalog_models  # noqa: F401
from bayesloom.operators import ordered


def test_totals_equal_those_of_all_pairs(spark):
    rng = random.Random(12)
    places = [None, float("nan"), float("inf"), 0.0, -0.0, *map(float, range(-50, 50, 7))]
    points = [(rng.choice(["a", "b", None]), rng.choice([rng.uniform(-50, 50), rng.choice(places)]), rng.choice([None, 0.01, -3.5, 1e6])) for _ in range(400)]
    spans = [(j, rng.choice(["a", "b", None]), lo := float(rng.randint(-60, 60)), lo + rng.choice([0.0, 0.001, 1.0, 3.7, 64.0, 500.0, -1.0])) for j in range(90)]
    spans += [(3, "a", -60.0, 60.0), (91, "a", None, 1.0), (92, "a", 0.0, float("inf")), (93, "b", float("nan"), 1.0), (94, "c", -60.0, 60.0)]
    p, s = spark.createDataFrame(points, "k string, x double, v double"), spark.createDataFrame(spans, "j long, k string, lo double, hi double")
    for key in ("k", None):
        want = []
        for j, q, lo, hi in spans:
            if None in (lo, hi) or not hi < float("inf") or (key and q is None):
                continue
            hit = [v or 0.0 for k, x, v in points if x is not None and lo <= x < hi and (key is None or k == q)]
            if hit:
                want.append((j, lo, hi, len(hit), pytest.approx(sum(hit), abs=1e-6)))
        for ranges in (1, 7):
            got = ordered.totals_within(p, s, "x", "lo", "hi", "v", key, ranges).collect()
            assert sorted((r.j, r.lo, r.hi, r.n, r.total) for r in got) == sorted(want, key=lambda w: w[:3])


def test_interval_join_makes_no_pairs(spark, tmp_path):
    """Every customer in every supplier's span: 225,000,000 pairs, 30,000 rows."""
    spark.range(15000).selectExpr("id * 97 AS s_suppkey", "1 AS s_nationkey", "CAST(id % 100 / 100 - 5 AS double) AS s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(15000).selectExpr("id AS c_custkey", "1 AS c_nationkey", "CAST(id % 3 / 4 AS double) AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    found = catalog.QUERIES["j12_interval_join"](spark, str(tmp_path))
    assert "_cell" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    assert len(rows) == 15000 and {(r.n, r.total) for r in rows} == {(15000, 3750.0)}
