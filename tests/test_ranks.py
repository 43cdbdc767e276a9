import numpy as np
import pytest
from pyspark.sql import functions as F

from adlake.operators.ranks import summary, upper_median


def groups():
    rng = np.random.default_rng(5)
    return {
        "one": [5.0], "two": [1.0, 2.0], "four": [1.0, 2.0, 3.0, 4.0], "equal": [7.5] * 50,
        "wide": list(rng.normal(0, 1, 500) * 10.0 ** rng.integers(-3, 9, 500)),
        "hot": list(np.round(rng.uniform(5000, 30000, 4000)) / 2), "zero": [0.0, -1.0, 1.0, -0.5, 0.0],
    }


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(k, float(v)) for k, vs in groups().items() for v in vs] + [("none", None), ("four", None)],
                                 "k string, v double")


def test_quantiles_are_exact(frame):
    got = {r.k: r for r in summary(frame, ["k"], "v", {"q1": 0.25, "q2": 0.5, "q9": 0.9}).collect()}
    assert set(got) == set(groups())
    for k, values in groups().items():
        row = got[k]
        assert (row.n, row.low, row.high) == (len(values), min(values), max(values))
        assert np.allclose([row.q1, row.q2, row.q9, row["mean"]], [*np.quantile(values, [0.25, 0.5, 0.9]), np.mean(values)])


def test_without_keys(frame):
    values = [v for vs in groups().values() for v in vs]
    row = summary(frame, [], "v", {"q": 0.5}).first()
    assert row.n == len(values) and row.q == pytest.approx(np.median(values))
    assert summary(frame.filter("k = 'nobody'"), [], "v", {"q": 0.5}).collect() == []


def test_upper_median_counts_nulls_first(frame):
    got = {r.k: r.m for r in upper_median(frame, ["k"], "v", "m").collect()}
    for k, values in groups().items():
        ordered = [None] * (k == "four") + sorted(values)
        assert got[k] == ordered[len(ordered) // 2]
    assert got["none"] is None


def test_very_many_values_within_one_per_mille(spark):
    """A million distinct values in a narrow range: the slices are split, and the answer stays exact."""
    n = 1_000_001
    rows = spark.range(n).select((F.lit(10_000.0) + (F.col("id") * 999_983 % n) / n).alias("v"))
    got = summary(rows, [], "v", {"median": 0.5, "q1": 0.25}).first()
    assert (got.n, got.low) == (n, 10_000.0)
    assert got.median == pytest.approx(10_000 + 500_000 / n, abs=1e-9) and got.q1 == pytest.approx(10_000 + 250_000 / n, abs=1e-9)
