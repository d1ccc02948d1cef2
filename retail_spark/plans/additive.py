"""Additive forecasts of many series (ML20): piecewise-linear trend, yearly seasonality, holidays.

All series share one design matrix over time, so a series is fitted from sums: X'X and X'y over its history, kept by
each task for the series it sees and merged per series.  Ridge priors stand on the changepoints, the seasonality and
the holidays; the normal equations are solved per series.  A series never has to lie in one task as rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_spark.operators.broadcast import bounded

BAND = 1.2815515655446004          # half width of an 80 % band in standard deviations
EPOCH = dt.date(1970, 1, 1)


@dataclass(frozen=True)
class Design:
    """Columns over time: constant, slope, a change of slope at each changepoint, sine and cosine pairs, holiday weeks."""

    first: int                     # day numbers of the history's ends
    last: int
    changepoints: tuple[float, ...]     # in units of the history
    order: int
    holidays: tuple[tuple[int, ...], ...]    # day numbers by type
    span: int                      # days of a period
    priors: tuple[float, float, float]       # scales of slope changes, seasonality, holidays
    noise: float                   # expected noise; both are relative to a series' greatest value

    def matrix(self, day: np.ndarray) -> np.ndarray:
        t = (day - self.first) / max(self.last - self.first, 1)
        year = 2 * np.pi * day / 365.25
        columns = [np.ones(len(t)), t, *[np.maximum(t - c, 0.0) for c in self.changepoints]]
        for h in range(1, self.order + 1):
            columns += [np.sin(h * year), np.cos(h * year)]
        for days in self.holidays:
            columns.append(np.any([(day <= d) & (d < day + self.span) for d in days], axis=0).astype(float) if days else np.zeros(len(t)))
        return np.stack(columns, axis=1)

    def penalty(self) -> np.ndarray:
        change, season, holiday = self.priors
        scales = [np.inf, np.inf, *[change] * len(self.changepoints), *[season] * (2 * self.order), *[holiday] * len(self.holidays)]
        return (self.noise / np.array(scales)) ** 2


def design(history: DataFrame, date: str, holidays: Sequence[tuple[dt.date, str]] = (), changepoints: int = 25, order: int = 10,
           span: int = 7, priors: tuple[float, float, float] = (0.05, 10.0, 10.0), noise: float = 0.1) -> Design:
    """The design for a history: changepoints spread evenly over its first 80 %."""
    ends = history.agg(F.min(date).alias("a"), F.max(date).alias("b")).first()
    first, last = ((d - EPOCH).days if d else 0 for d in ends)
    types = sorted({kind for _, kind in holidays})
    return Design(first, last, tuple((0.8 * np.arange(1, changepoints + 1) / changepoints).tolist()), order,
                  tuple(tuple(sorted((d - EPOCH).days for d, k in holidays if k == kind)) for kind in types), span, priors, noise)


def solve(design: Design, gram: np.ndarray, xy: np.ndarray, n: float, yy: float) -> tuple[np.ndarray, float]:
    """Coefficients and residual spread of a series from its sums."""
    beta = np.linalg.lstsq(gram + np.diag(design.penalty()), xy, rcond=None)[0]
    squares = max(yy - 2 * beta @ xy + beta @ gram @ beta, 0.0)
    return beta, float(np.sqrt(squares / max(n - 1, 1)))


def fit(history: DataFrame, key: str, date: str, value: str, d: Design) -> DataFrame:
    """Coefficients of each series: key, beta, spread."""
    p = len(d.penalty())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = d.matrix(batch.column("day").to_numpy().astype(float)), batch.column("y").to_numpy()
            codes = batch.column("key").dictionary_encode()
            which, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
            for i, name in enumerate(names):
                a, b = x[which == i], y[which == i]
                now = [a.T @ a, a.T @ b, float(len(b)), float(b @ b)]
                held[name] = [u + v for u, v in zip(held[name], now)] if name in held else now
        for name, (gram, xy, n, yy) in held.items():
            yield pa.record_batch([pa.array([name]), pa.array([gram.ravel()], pa.list_(pa.float64())), pa.array([xy], pa.list_(pa.float64())),
                                   pa.array([n]), pa.array([yy])], names=["key", "gram", "xy", "n", "yy"])

    def merged(part: pa.Table) -> pa.Table:
        gram, xy = (part[c].combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1).sum(axis=0) for c in ("gram", "xy"))
        beta, spread = solve(d, gram.reshape(p, p), xy, part["n"].to_numpy().sum(), part["yy"].to_numpy().sum())
        return pa.table({"key": part["key"].slice(0, 1), "beta": pa.array([beta], pa.list_(pa.float64())), "spread": pa.array([spread])})

    rows = history.select(F.col(key).cast("string").alias("key"), F.unix_date(date).alias("day"), F.col(value).cast("double").alias("y")).dropna()
    return (rows.mapInArrow(sums, "key string, gram array<double>, xy array<double>, n double, yy double").groupBy("key")
            .applyInArrow(merged, "key string, beta array<double>, spread double"))


def forecast(weekly: DataFrame, fitted: DataFrame, key: str, d: Design, keep: Sequence[str] = ("week_start", "split"),
             date: str = "week_start", value: str = "quantity") -> DataFrame:
    """actual, predicted, lower and upper for every row of ``weekly``, clipped at zero; series without a fit have nulls."""
    rows = (weekly.select(F.col(key).cast("string").alias("key"), *keep, F.unix_date(date).alias("_day"), F.col(value).cast("double").alias("actual"))
            .join(bounded(fitted), "key", "left"))
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = d.matrix(batch.column("_day").to_numpy().astype(float))
            beta = batch.column("beta")
            known = beta.is_valid().to_numpy(zero_copy_only=False)
            yhat = np.full(len(x), np.nan)
            if known.any():
                yhat[known] = (x[known] * beta.drop_null().flatten().to_numpy().reshape(known.sum(), -1)).sum(axis=1)
            half = BAND * np.nan_to_num(batch.column("spread").to_numpy(zero_copy_only=False).astype(float))
            clipped = [pa.array(np.maximum(v, 0.0), mask=~known) for v in (yhat, yhat - half, yhat + half)]
            yield pa.record_batch([*[batch.column(c) for c in ("key", *keep, "actual")], *clipped],
                                  names=[key, *keep, "actual", "predicted", "lower", "upper"])

    schema = ", ".join([f"{key} string", *[f"{c} {types[c]}" for c in keep], "actual double, predicted double, lower double, upper double"])
    return rows.mapInArrow(run, schema)
