"""Additive forecasts against numpy on the whole series."""

import datetime as dt

import numpy as np
import pytest

from retail_spark.plans import additive as AD

WEEKS = [dt.date(2019, 1, 1) + dt.timedelta(weeks=k) for k in range(260)]
HOLIDAYS = [(dt.date(y, 7, 25), "national") for y in range(2019, 2024)] + [(dt.date(y, 12, 25), "christmas") for y in range(2019, 2024)]


def series(spark):
    rng = np.random.default_rng(6)
    day = np.array([(w - AD.EPOCH).days for w in WEEKS], float)
    t = np.arange(260) / 260
    bump = np.array([any(w <= d < w + dt.timedelta(days=7) and k == "christmas" for d, k in HOLIDAYS) for w in WEEKS])
    a = 50 + 40 * t - 70 * np.maximum(t - 0.4, 0) + 12 * np.sin(2 * np.pi * day / 365.25) + 25 * bump + rng.normal(0, 2, 260)
    b = np.maximum(0, 3 - 20 * np.maximum(t - 0.5, 0) + rng.normal(0, .2, 260))
    rows = [(s, w, "train" if k < 200 else "val" if k < 230 else "test", float(v[k])) for s, v in (("a", a), ("b", b)) for k, w in enumerate(WEEKS)]
    df = spark.createDataFrame(rows + [("new", WEEKS[250], "test", 1.0)], "section string, week_start date, split string, quantity double").repartition(6)
    return df, day, {"a": a, "b": b}


def test_additive_fit_equals_numpy(spark):
    df, day, values = series(spark)
    history = df.filter("split = 'train'")
    d = AD.design(history, "week_start", HOLIDAYS)
    assert (d.first, d.last) == (day[0], day[199]) and len(d.changepoints) == 25 and d.changepoints[-1] == pytest.approx(0.8)
    got = {r["key"]: r for r in AD.fit(history, "section", "week_start", "quantity", d).collect()}
    x = d.matrix(day)
    assert x.shape[1] == 2 + 25 + 20 + 2
    assert x[:, -2].sum() == 5 and x[:, -1].sum() == 5                    # a holiday marks the week that it falls in
    for s, y in values.items():
        # ridge as extra rows of a least-squares problem
        extra = np.sqrt(d.penalty())
        whole = np.concatenate([x[:200], np.diag(extra)])
        beta = np.linalg.lstsq(whole, np.concatenate([y[:200], np.zeros(len(extra))]), rcond=None)[0]
        assert x @ np.array(got[s]["beta"]) == pytest.approx(x @ beta, abs=1e-4)
        assert np.array(got[s]["beta"])[:40] == pytest.approx(beta[:40], abs=1e-3)
        assert got[s]["spread"] == pytest.approx(np.sqrt(((y[:200] - x[:200] @ beta) ** 2).sum() / 199), rel=1e-4)


def test_additive_forecast_bands(spark):
    df, day, values = series(spark)
    history = df.filter("split = 'train'")
    d = AD.design(history, "week_start", HOLIDAYS)
    out = AD.forecast(df, AD.fit(history, "section", "week_start", "quantity", d), "section", d).toPandas()
    assert len(out) == 521
    known = out[out["section"] != "new"]
    assert (known["lower"] >= 0).all() and (known["lower"] <= known["predicted"]).all() and (known["predicted"] <= known["upper"]).all()
    assert out[out["section"] == "new"][["predicted", "lower", "upper"]].isna().all(axis=None)
    a = known[(known["section"] == "a") & (known["split"] != "train")]
    assert (a["predicted"] - a["actual"]).abs().mean() < 8
    fit = known[(known["section"] == "a") & (known["split"] == "train")]
    assert 0.7 <= ((fit["actual"] >= fit["lower"]) & (fit["actual"] <= fit["upper"])).mean() <= 0.9
