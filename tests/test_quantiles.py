"""Exact distributed quantiles against numpy's linear interpolation."""

import numpy as np
import pytest

from lodestar.operators.aggregates import describe, exact_quantiles

CASES = {
    "ties": [5.0] * 50 + [1.0] * 3 + [9.0] * 7,
    "single": [3.5],
    "two": [1.0, 2.0],
    "spread": [float(x) for x in np.random.default_rng(7).integers(0, 40, size=997)],
    "cont": [float(x) for x in np.random.default_rng(3).normal(size=1500)],
}


@pytest.mark.parametrize("buckets", [4, 128])
def test_exact_quantiles(spark, buckets):
    rows = [(c, v) for c, vs in CASES.items() for v in vs] + [("ties", None)]
    df = spark.createDataFrame(rows, "column string, value double")
    qs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {(r["column"], r["q"]): r["value"] for r in exact_quantiles(df, qs, buckets).collect()}
    for c, vs in CASES.items():
        for q in qs:
            assert got[(c, q)] == pytest.approx(float(np.quantile(np.array(vs), q)), abs=1e-12), (c, q)


def test_quantiles_of_awkward_values(spark):
    """Infinities, neighbours near zero, the whole range of doubles, one value in most rows."""
    inf, tiny, most = float("inf"), 5e-324, 1.7976931348623157e308
    cases = {
        "infinite": [-inf] * 3 + [1.0, 2.0, 3.0] + [inf] * 3,
        "only": [inf] * 4,
        "tiny": [0.0] * 5 + [tiny] * 5 + [2 * tiny] * 3,
        "range": [-most, -1.0, 0.0, 1e-300, 1.0, 1e300, most],
        "skew": [7.0] * 900 + [float(i) for i in range(300)] + [1e12] * 5 + [float("nan")],
        "powers": [2.0**k for k in range(-300, 300)],
    }
    df = spark.createDataFrame([(c, v) for c, vs in cases.items() for v in vs], "column string, value double")
    qs = [0.0, 0.1, 0.5, 0.9, 1.0]
    for buckets, small in ((64, 20), (1024, 100_000)):
        got = {(r["column"], r["q"]): r["value"] for r in exact_quantiles(df, qs, buckets, small=small).collect()}
        for c, vs in cases.items():
            held = sorted(v for v in vs if v == v)
            for q in qs:
                at = q * (len(held) - 1)
                lo, hi = held[int(at)], held[int(-(-at // 1))]
                want = lo if lo == hi else lo + (at - int(at)) * (hi - lo)
                assert got[(c, q)] == pytest.approx(want, rel=1e-12, abs=0), (c, q, buckets)


def test_describe_quartiles(spark):
    df = spark.range(20_000).selectExpr("cast(id % 50 as double) as a", "id * 0.5 as b")
    rows = {r["column"]: r for r in describe(df, ["a", "b"]).collect()}
    assert (rows["a"]["q25"], rows["a"]["q50"], rows["a"]["q75"]) == (12.0, 24.5, 37.0)
    assert (rows["b"]["q25"], rows["b"]["q50"], rows["b"]["q75"]) == (2499.875, 4999.75, 7499.625)
