"""Bracket refinement against numpy, with small samples so that several rounds run."""

import numpy as np
import pytest

from retail_spark.operators import quantiles as Q


@pytest.mark.parametrize("sample,collect", [(50_000, 1 << 20), (60, 200), (7, 3)])
def test_refined_quantiles_equal_numpy(spark, monkeypatch, sample, collect):
    monkeypatch.setattr(Q, "SAMPLE", sample)
    monkeypatch.setattr(Q, "COLLECT", collect)
    rng = np.random.default_rng(4)
    a = np.concatenate([np.full(900, 2.5), rng.normal(size=1100) * 10])           # one value holds a large part of the rows
    b = np.where(rng.random(2000) < 0.3, np.nan, rng.integers(0, 9, 2000))
    c = np.concatenate([[np.inf, -np.inf], np.exp(rng.normal(size=1998) * 20)])
    df = spark.createDataFrame([(float(x), None if np.isnan(y) else int(y), float(z), None) for x, y, z in zip(a, b, c)],
                               "a double, b int, c double, d double").repartition(7)
    fr = [0.0, 0.01, 0.25, 0.5, 0.733, 0.99, 1.0]
    got = Q.quantile_values(df, {"a": fr, "b": fr[::-1], "c": fr[1:-1], "d": fr})
    assert got["a"] == pytest.approx(np.quantile(a, fr).tolist())
    assert got["b"] == pytest.approx(np.quantile(b[~np.isnan(b)], fr[::-1]).tolist())
    assert got["c"] == pytest.approx(np.quantile(c, fr[1:-1]).tolist())
    assert got["d"] == []


def test_quantiles_of_no_rows(spark):
    df = spark.createDataFrame([], "a double")
    assert Q.quantile_values(df, {"a": [0.5]}) == {"a": []}
