"""Exact quantiles, whatever is sliced, and the filters on top of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from breezeframe.operators import quantiles as Q


def table(spark):
    rnd = np.random.default_rng(3)
    parts = {
        "skew": rnd.lognormal(0, 3, 4000), "ties": rnd.integers(0, 4, 4000).astype(float),
        "line": np.arange(4000.0), "wild": np.r_[rnd.normal(0, 1, 3990), [1e300, -1e300, np.inf, -np.inf] + [0.0] * 6],
        "lone": np.array([7.0]), "two": np.array([1.0, 2.0]),
    }
    rows = [(g, float(v), None if i % 5 == 0 else float(-v)) for g, vs in parts.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "station string, a double, b double").repartition(6)
    return df, parts


@pytest.mark.parametrize("bound,margin,most", [(1 << 16, 0.0005, None), (16, 0.05, None), (1, 0.3, None), (1, 0.3, 4000)])
def test_equal_to_sorting(spark, monkeypatch, bound, margin, most):
    monkeypatch.setattr(Q, "BOUND", bound)
    monkeypatch.setattr(Q, "MARGIN", margin)
    df, parts = table(spark)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {(r["station"], r["column"], r["p"]): r["value"] for r in Q.exact_quantiles(df, ["a", "b"], probs, most=most).collect()}
    for g, vs in parts.items():
        for c, x in (("a", vs), ("b", np.array([-v for i, v in enumerate(vs) if i % 5]))):
            for p in probs:
                if len(x):
                    at = p * (len(x) - 1)
                    low, high = np.sort(x)[[int(np.floor(at)), int(np.ceil(at))]]
                    with np.errstate(invalid="ignore"):
                        want = low + (high - low) * (at - np.floor(at))
                    assert got.pop((g, c, p)) == pytest.approx(want, rel=1e-12, nan_ok=True), (g, c, p)
    assert not got
    whole = {r["p"]: r["value"] for r in Q.exact_quantiles(df.where("station = 'line'"), ["a"], [0.5, 0.9], keys=(), most=most).collect()}
    assert whole == {0.5: 1999.5, 0.9: pytest.approx(3599.1)}


def test_little_is_ordered(spark, monkeypatch):
    """A group of half a million distinct values orders a few hundred of them."""
    monkeypatch.setattr(Q, "BOUND", 100)
    df = spark.range(500_000).select(F.exp(F.col("id") / 50_000).alias("a"))
    plan = Q._candidates(df, ["a"], [0.5], ())
    assert plan.count() == 2
    values = Q.exact_quantiles(df, ["a"], [0.5], keys=()).first()["value"]
    assert values == pytest.approx(np.exp((249_999.5) / 50_000), rel=1e-6)
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert "slice" in plan


def test_sequential_filter_equals_plain_rounds(spark):
    from breezeframe.operators.shaping import iqr_filter_seq

    rnd = np.random.default_rng(5)
    rows = [(f"s{i % 3}", float(x), float(y), None if i % 50 == 0 else float(z)) for i, (x, y, z) in enumerate(rnd.lognormal(0, 1, (900, 3)))]
    df = spark.createDataFrame(rows, "station string, pm2_5 double, pm10 double, ozone double").repartition(4)
    for keys in (["station"], []):
        want = []
        for g in {r[0] for r in rows} if keys else {None}:
            left = [r for r in rows if g is None or r[0] == g]
            for c in (1, 2, 3):
                q1, q3 = np.percentile([r[c] for r in left if r[c] is not None], [25, 75])
                left = [r for r in left if r[c] is not None and q1 - 1.5 * (q3 - q1) <= r[c] <= q3 + 1.5 * (q3 - q1)]
            want += left
        for small in (Q.SMALL, 0):
            old, Q.SMALL = Q.SMALL, small
            try:
                got = iqr_filter_seq(df, ["pm2_5", "pm10", "ozone"], keys=keys).collect()
            finally:
                Q.SMALL = old
            assert sorted(tuple(r) for r in got) == sorted(want)
