"""Filters, joins, aggregates and set operations (FIL*, JN*, AG13–AG21,
AG33, AG43, SO*, TK*).

Join policy: a side is broadcast explicitly only when its size is bounded by
construction (a fixed rule table, a calendar of a few periods, a one-row
aggregate, one row per partition).  Every other join is left to the planner:
with AQE on, Spark measures the shuffled side at run time and switches to a
broadcast only below ``spark.sql.autoBroadcastJoinThreshold``; above it, the
sort-merge join stays, and skewed keys are split by the AQE skew-join rule.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retail_spark.operators.ordered import exact_quantiles, global_row_number

# ---------------------------------------------------------------------------
# Filters (FIL1–FIL10)


def where_eq(df: DataFrame, **eq) -> DataFrame:
    """Optional conjunctive equality filters: ``None`` means no filter (FIL1, FIL6, FIL7)."""
    for k, v in eq.items():
        if v is not None:
            df = df.filter(F.col(k) == F.lit(v))
    return df


def where_in(df: DataFrame, c: str, values: Sequence) -> DataFrame:
    """IN-list filter (FIL2)."""
    return df.filter(F.col(c).isin(*values))


def search(df: DataFrame, text: str, cols: Sequence[str]) -> DataFrame:
    """Case-insensitive substring match on any of ``cols`` (FIL5)."""
    pat = f"%{text}%"
    cond = functools.reduce(lambda a, b: a | b, [F.col(c).ilike(pat) for c in cols])
    return df.filter(cond)


def since(df: DataFrame, ts: str, days: int, as_of) -> DataFrame:
    """Rows within the last ``days`` days before ``as_of`` (FIL8)."""
    from retail_spark.functions.exprs import wall_clock
    return df.filter(F.col(ts) >= wall_clock(as_of) - F.make_interval(days=F.lit(days)))


def between_dates(df: DataFrame, c: str, lo, hi) -> DataFrame:
    """Inclusive date-range slice (FIL9)."""
    return df.filter(F.col(c).cast("date").between(F.lit(lo), F.lit(hi)))


def above_quantile(df: DataFrame, c: str, q: float) -> DataFrame:
    """Rows with ``c`` at or above its exact linear ``q`` quantile (FIL10)."""
    thr = exact_quantiles(df, {"_thr": (c, q)})
    return df.crossJoin(F.broadcast(thr)).filter(F.col(c) >= F.col("_thr")).drop("_thr")


# ---------------------------------------------------------------------------
# Joins (JN2–JN8, JN13, JN15, JN16)


def enrich(df: DataFrame, dim: DataFrame, key: str | list[str], bounded: bool = False,
           defaults: dict[str, object] | None = None) -> DataFrame:
    """Left dimension enrichment with defaults for missing matches (JN2)."""
    right = F.broadcast(dim) if bounded else dim
    out = df.join(right, key, "left")
    for c, d in (defaults or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(d)))
    return out


def map_or(df: DataFrame, lookup: DataFrame, key: str, value: str, order_cols: list[str],
           default) -> DataFrame:
    """Per-key first value of ``lookup`` in ascending ``order_cols`` with a
    default (JN4).  ``min_by`` is a partial aggregate: a key with many lookup
    rows is reduced map-side, not ranked in one task."""
    first = (lookup.groupBy(key)
             .agg(F.min_by(F.col(value), F.struct(*[F.col(c) for c in order_cols])).alias("_mapped")))
    return (df.join(first, key, "left")
            .withColumn(value, F.coalesce("_mapped", F.lit(default))).drop("_mapped"))


def merge_all(frames: Sequence[DataFrame], key: str | list[str], how: str = "left") -> DataFrame:
    """Chain of merges on one key (JN5)."""
    return functools.reduce(lambda a, b: a.join(b, key, how), frames)


def outer_indicator(left: DataFrame, right: DataFrame, key: str, name: str = "match") -> DataFrame:
    """Full outer merge with a pandas-style indicator (JN6)."""
    lt = left.withColumn("_l", F.lit(True))
    rt = right.withColumn("_r", F.lit(True))
    return (lt.join(rt, key, "full_outer")
            .withColumn(name, F.when(F.col("_l") & F.col("_r"), "both")
                        .when(F.col("_l"), "left_only").otherwise("right_only"))
            .drop("_l", "_r"))


def semi(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is in ``keys`` (JN8)."""
    return df.join(keys, on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is not in ``keys`` (JN8, SO3)."""
    return df.join(keys, on, "left_anti")


def dense_grid(df: DataFrame, key: str, day: str, value: str, fill=0.0,
               start=None, end=None, keep: Sequence[str] = ()) -> DataFrame:
    """Every day between the global first and last day for every key, missing
    values filled (JN7).  The day range is one aggregate row; each key row
    explodes its own calendar, so the grid is generated, not cross-joined."""
    bounds = df.agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    if start is not None:
        bounds = bounds.withColumn("_lo", F.lit(start).cast("date"))
    if end is not None:
        bounds = bounds.withColumn("_hi", F.lit(end).cast("date"))
    keys = df.select(key, *keep).distinct()
    grid = (keys.crossJoin(F.broadcast(bounds))   # one-row bounds
            .select(key, *keep, F.explode(F.sequence("_lo", "_hi")).alias(day)))
    return (grid.join(df.select(key, day, value), [key, day], "left")
            .withColumn(value, F.coalesce(F.col(value), F.lit(fill))))


def ingredient_need(forecast: DataFrame, recipe: DataFrame, ingredients: DataFrame,
                    qty: str = "forecast") -> DataFrame:
    """Bill-of-materials explosion: Σ forecast × quantity needed per ingredient (JN13)."""
    units = F.greatest(F.lit(0.0), F.rint(qty))      # an item's forecast is a number of whole servings
    need = (forecast.join(recipe, "product_id")
            .groupBy("ingredient_id")
            .agg(F.sum(units * F.col("quantity_needed")).alias("need")))
    return need.join(ingredients, "ingredient_id")


# ---------------------------------------------------------------------------
# Aggregates (AG13–AG21, AG33, AG43)


def share_pivot(df: DataFrame, key: str, c: str, v: Column | None, values: Sequence,
                prefix: str = "share_") -> DataFrame:
    """Row-normalised cross tab with an explicit value list (AG14).  ``v``
    None counts rows; otherwise sums ``v``."""
    agg = F.count(F.lit(1)) if v is None else F.sum(v)
    piv = df.groupBy(key).pivot(c, list(values)).agg(agg)
    total = functools.reduce(lambda a, b: a + b, [F.coalesce(F.col(f"`{x}`"), F.lit(0)) for x in values])
    return piv.select(key, *[F.try_divide(F.coalesce(F.col(f"`{x}`"), F.lit(0)).cast("double"), total)
                             .alias(f"{prefix}{x}") for x in values])


def crosstab_long(df: DataFrame, r: str, c: str) -> DataFrame:
    """Count cross tab in long form (AG15); wide form is a pivot of it."""
    return df.groupBy(r, c).agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """Frequency table with percentage of the total (AG20)."""
    counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("count"))
    tot = df.agg(F.count(F.lit(1)).alias("_tot"))
    return (counts.crossJoin(F.broadcast(tot))
            .withColumn("pct", F.col("count") * 100.0 / F.col("_tot")).drop("_tot"))


def with_shares(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Share of total per row for each ``{source: name}`` (AG19)."""
    tot = df.agg(*[F.sum(s).alias(f"_t_{s}") for s in cols])
    out = df.crossJoin(F.broadcast(tot))
    for s, n in cols.items():
        out = out.withColumn(n, F.try_divide(F.col(s) * 100.0, F.col(f"_t_{s}")))
    return out.drop(*[f"_t_{s}" for s in cols])


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles, max per column, long form (AG21)."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    long = df.select(F.expr(f"stack({len(cols)}, {pairs}) AS (column_name, value)"))
    plain = long.groupBy("column_name").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = exact_quantiles(long, {"q25": ("value", 0.25), "q50": ("value", 0.5), "q75": ("value", 0.75)}, ["column_name"])
    return plain.join(q, "column_name", "left").select("column_name", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def feature_corr(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of each feature with the target, ranked by |r| (AG33)."""
    row = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in cols])
    pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = row.select(F.expr(f"stack({len(cols)}, {pairs}) AS (feature, corr)"))
    return long.withColumn("abs_corr", F.abs("corr"))


def concentration(df: DataFrame, value: str, key: str, pcts: Iterable[float]) -> DataFrame:
    """Share of the total held by the top p of keys by value (AG43)."""
    ranked = global_row_number(df.select(key, value), [F.desc(value), F.asc(key)], "rk")
    tot = df.agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    r = ranked.crossJoin(F.broadcast(tot))
    aggs = []
    for p in pcts:
        k = F.floor(F.col("_n") * F.lit(p))
        aggs.append(F.try_divide(F.sum(F.when(F.col("rk") <= k, F.col(value)).otherwise(0.0)) * 100.0,
                                 F.first("_s")).alias(f"top_{int(round(p * 100))}_pct_share"))
    return r.agg(*aggs)


# ---------------------------------------------------------------------------
# Set operations (SO1–SO5)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name, missing columns NULL (SO1)."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedup(df: DataFrame, keys: list[str], order_cols: list[str], last: bool = False) -> DataFrame:
    """Drop duplicates on ``keys`` keeping the first (or last) row in the
    ascending order of ``order_cols`` (SO2) — unlike ``dropDuplicates``,
    which keeps any row.  Partial-aggregating ``min_by`` / ``max_by``."""
    from retail_spark.operators.windows import pick_per
    return pick_per(df, list(keys), list(order_cols), largest=last)


def top_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int,
                    rank: str = "rank") -> DataFrame:
    """Top n rows per group in ``order`` (TK4, TK7)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Offset paging in a total order (TK3)."""
    return df.orderBy(*order).offset(offset).limit(limit)
