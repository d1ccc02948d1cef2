"""Window operators on keyed series (WN1–WN8, WN14–WN18, WN22).

All windows here are partitioned by a series key, so each task only holds the
rows of its own keys.  Callers aggregate to one row per (key, period) first,
which bounds a partition by the number of periods however hot a key is.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(keys, order):
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str | Column) else list(order)
    return Window.partitionBy(*keys).orderBy(*order)


def add_lags(df: DataFrame, keys, order, value: str, lags: Iterable[int],
             fmt: str = "lag_{n}") -> DataFrame:
    """``value`` shifted by each ``n`` rows within ``keys`` (WN1)."""
    w = _w(keys, order)
    return df.select("*", *[F.lag(value, n).over(w).alias(fmt.format(n=n)) for n in lags])


def add_rolling(df: DataFrame, keys, order, value: str, sizes: Iterable[int],
                fns=("mean", "std", "max", "min"), fmt: str = "rolling_{fn}_{n}") -> DataFrame:
    """Leakage-safe rolling stats over the previous ``n`` rows, min_periods 1 (WN3).

    The frame ends one row *before* the current one.  A single-row standard
    deviation is NULL (sample std), as in the reference before its fill.
    """
    base = _w(keys, order)
    cols = []
    for n in sizes:
        w = base.rowsBetween(-n, -1)
        for fn in fns:
            agg = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min,
                   "sum": F.sum}[fn](value)
            cols.append(agg.over(w).alias(fmt.format(fn=fn, n=n)))
    return df.select("*", *cols)


def latest_per(df: DataFrame, keys, ts: str, tiebreak: list[str] | None = None) -> DataFrame:
    """Latest row per key (WN14): ``max_by`` of the row over (ts, tie-breaks),
    a partial aggregate, so a hot key is reduced map-side instead of being
    ranked in one task."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return pick_per(df, keys, [ts] + list(tiebreak or []), largest=True)


def pick_per(df: DataFrame, keys: list[str], order_cols: list[str], largest: bool = False) -> DataFrame:
    """One whole row per key: the row with the smallest (or largest) value of
    ``order_cols`` (ascending struct order).  ``min_by`` / ``max_by`` keep a
    single candidate per key in each partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    key = F.struct(*[F.col(f"`{c}`") for c in order_cols])
    pick = (F.max_by if largest else F.min_by)(row, key).alias("_row")
    return df.groupBy(*keys).agg(pick).select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def preferred(df: DataFrame, key: str, c: str, weight: Column | None = None,
              name: str | None = None) -> DataFrame:
    """Most frequent (or highest-weight) value of ``c`` per ``key``; ties go to
    the alphabetically first value (WN15, WN16).  Aggregates first, so the
    window holds one row per (key, value)."""
    agg = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.filter(F.col(c).isNotNull()).groupBy(key, c).agg(agg.alias("_n"))
    w = Window.partitionBy(key).orderBy(F.desc("_n"), F.asc(c))
    return (counts.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
            .select(key, F.col(c).alias(name or f"preferred_{c}")))


def sequences(df: DataFrame, keys, order, feats: list[str], length: int,
              name: str = "sequence") -> DataFrame:
    """Previous ``length`` feature rows as a nested array; only full windows (WN22)."""
    w = _w(keys, order).rowsBetween(-length, -1)
    seq = F.collect_list(F.array(*[F.col(f).cast("double") for f in feats])).over(w)
    return df.withColumn(name, seq).filter(F.size(name) == length)
