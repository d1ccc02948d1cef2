"""Demand time series: dense daily grid, Tuesday–Monday weeks, leakage-safe
lag / rolling / hierarchy features, EDA operators, naive baselines and
forecast metrics (JN7, JN9–JN11, JN15, SF11, SF14, SF21, WN1–WN12, WN20,
WN22, WN23, AG23–AG29, AG41, AG45, PRJ8, DP31–DP36).

Scale: every series is first aggregated to one row per (series, day) or
(series, week), so windows partitioned by series hold at most one row per
period — a hot item that owns a third of all sale lines still gives one row
per day.  Chain-wide totals are one row per period; their windows run over a
table bounded by the calendar, not by the data volume.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retail_spark.functions import exprs as X
from retail_spark.operators.broadcast import bounded
from retail_spark.operators.ordered import exact_quantiles, global_running_sum
from retail_spark.operators.relational import dense_grid
from retail_spark.operators.windows import add_lags, add_rolling
from retail_spark.session import cut_lineage

EPS = 1e-6
LAGS_WEEKLY = (1, 2, 3, 4, 8)
DROP_FIRST_WEEKS = 8


# ---------------------------------------------------------------------------
# Series construction


def daily_demand(lines: DataFrame, key: str = "section") -> DataFrame:
    """Quantity per (key, day) on a dense grid, missing days 0 (JN7)."""
    d = lines.groupBy(key, "order_date").agg(F.sum("quantity").alias("quantity"))
    return dense_grid(d, key, "order_date", "quantity", 0.0)


def weekly_demand(daily: DataFrame, key: str = "section") -> DataFrame:
    """Tuesday–Monday weekly totals, full 7-day weeks only (SF11)."""
    return (daily.withColumn("week_start", X.week_start_tue("order_date"))
            .groupBy(key, "week_start")
            .agg(F.sum("quantity").alias("quantity"), F.countDistinct("order_date").alias("_days"))
            .filter(F.col("_days") == 7).drop("_days"))


def split_by_date(df: DataFrame, c: str, train_end: dt.date, val_end: dt.date) -> DataFrame:
    """train ≤ train_end < val ≤ val_end < test (WN20)."""
    d = F.col(c)
    return df.withColumn("split", F.when(d <= F.lit(train_end), "train")
                         .when(d <= F.lit(val_end), "val").otherwise("test"))


# ---------------------------------------------------------------------------
# Weekly features (WN1–WN6)


def weekly_features(weekly: DataFrame, key: str, start: dt.date | None = None) -> DataFrame:
    """Lags, lag combinations, leakage-safe rolling stats, expanding mean,
    volatility and momentum, chain totals, calendar; first 8 weeks dropped and
    fills applied as in the reference."""
    df = add_lags(weekly, key, "week_start", "quantity", LAGS_WEEKLY, "lag_{n}w")
    c = F.col
    df = df.select("*", (c("lag_1w") / (c("lag_2w") + 1)).alias("lag_1_2_ratio"),
                   (c("lag_1w") - c("lag_2w")).alias("lag_1_2_diff"),
                   ((c("lag_1w") + c("lag_2w") + c("lag_3w") + c("lag_4w")) / 4).alias("lag_1_4_mean"))
    df = add_rolling(df, key, "week_start", "quantity", [4], ("mean", "std", "max", "min"), "rolling_{fn}_{n}w")
    df = add_rolling(df, key, "week_start", "quantity", [8], ("mean", "std"), "rolling_{fn}_{n}w")
    df = add_rolling(df, key, "week_start", "quantity", [13], ("mean",), "rolling_{fn}_{n}w")
    exp = Window.partitionBy(key).orderBy("week_start").rowsBetween(Window.unboundedPreceding, -1)
    df = df.select("*", (c("rolling_std_4w") / (c("rolling_mean_4w") + EPS)).alias("rolling_cv_4w"),
                   (c("rolling_mean_4w") / (c("rolling_mean_13w") + EPS)).alias("demand_momentum"),
                   F.avg("quantity").over(exp).alias("expanding_mean"))
    # chain-wide context: one row per week, window over the calendar only
    tot = weekly.groupBy("week_start").agg(F.sum("quantity").alias("_tw"))
    wt = Window.orderBy("week_start")
    tot = tot.select("week_start", F.lag("_tw", 1).over(wt).alias("total_lag_1w"),
                     F.avg("_tw").over(wt.rowsBetween(-4, -1)).alias("total_rolling_4w"))
    df = df.join(F.broadcast(tot), "week_start", "left")   # one row per week: calendar-bounded
    wk = F.col("week_start")
    first = weekly.agg(F.min("week_start").alias("_w0"))
    df = (df.crossJoin(F.broadcast(first))
          .withColumn("weeks_since_start", F.floor(F.datediff(wk, F.col("_w0")) / 7).cast("int"))
          .filter(F.col("weeks_since_start") >= DROP_FIRST_WEEKS).drop("_w0"))
    woy = F.weekofyear(wk)
    msin, mcos = X.cyclic(F.month(wk), 12)
    wsin, wcos = X.cyclic(woy, 52)
    df = df.select("*", woy.alias("week_of_year"), F.month(wk).alias("month"), F.year(wk).alias("year"),
                   msin.alias("month_sin"), mcos.alias("month_cos"), wsin.alias("week_sin"), wcos.alias("week_cos"))
    roll = [x for x in df.columns if "rolling" in x or "expanding" in x]
    df = df.fillna(0.0, subset=roll).fillna({"lag_1_2_ratio": 1.0, "lag_1_2_diff": 0.0, "lag_1_4_mean": 0.0,
                                             "demand_momentum": 1.0, "rolling_cv_4w": 0.0})
    med = df.agg(F.median("total_lag_1w").alias("_med"))
    return (df.crossJoin(F.broadcast(med))
            .withColumn("total_lag_1w", F.coalesce("total_lag_1w", "_med")).drop("_med"))


def hierarchy_features(weekly: DataFrame, key: str, parent: str) -> DataFrame:
    """Parent-level weekly totals lagged and rolled, joined back; share of the
    child in its parent; missing parent lag → parent median (WN6)."""
    pw = weekly.groupBy(parent, "week_start").agg(F.sum("quantity").alias("_pw"))
    w = Window.partitionBy(parent).orderBy("week_start")
    pw = pw.select(parent, "week_start", F.lag("_pw", 1).over(w).alias("parent_lag_1w"),
                   F.avg("_pw").over(w.rowsBetween(-4, -1)).alias("parent_rolling_4w"))
    cw = Window.partitionBy(key).orderBy("week_start").rowsBetween(-4, -1)
    df = (weekly.withColumn("rolling_mean_4w", F.avg("quantity").over(cw))
          .join(pw, [parent, "week_start"], "left"))
    df = cut_lineage(df)
    med = exact_quantiles(df, {"_med": ("parent_lag_1w", 0.5)}, [parent])
    return (df.join(bounded(med), parent, "left").withColumn("parent_lag_1w", F.coalesce("parent_lag_1w", "_med")).drop("_med")
            .withColumn("share_of_parent",
                        F.coalesce(F.col("rolling_mean_4w") / (F.col("parent_rolling_4w") + EPS), F.lit(0.0))))


def standardise(df: DataFrame, cols: Sequence[str], split: str = "split", fit_on: str = "train") -> DataFrame:
    """(x − train mean) / (train population std + 1e-6) (PRJ8)."""
    is_fit = F.col(split) == fit_on
    st = df.agg(*[F.avg(F.when(is_fit, F.col(x))).alias(f"_m_{x}") for x in cols],
                *[F.stddev_pop(F.when(is_fit, F.col(x))).alias(f"_s_{x}") for x in cols])
    out = df.crossJoin(F.broadcast(st))
    for x in cols:
        out = out.withColumn(f"{x}_std", (F.col(x) - F.col(f"_m_{x}")) / (F.col(f"_s_{x}") + EPS))
    return out.drop(*[f"_m_{x}" for x in cols], *[f"_s_{x}" for x in cols])


# ---------------------------------------------------------------------------
# Calendar dimensions supplied by the caller (JN9–JN11, SF14)


def overlap_days(weeks: DataFrame, periods: DataFrame, min_days: int = 4) -> DataFrame:
    """Days of each 7-day week inside any period, and a flag when ≥ min_days
    (JN9).  ``periods`` (start, end) is a small dimension: broadcast range join."""
    we = F.date_add("week_start", 6)
    j = weeks.join(F.broadcast(periods), (F.col("week_start") <= F.col("end")) & (we >= F.col("start")), "left")
    days = F.datediff(F.least(we, F.col("end")), F.greatest(F.col("week_start"), F.col("start"))) + 1
    return (j.groupBy("week_start")
            .agg(F.coalesce(F.sum(F.when(F.col("start").isNotNull(), days)), F.lit(0)).cast("int").alias("period_days"))
            .withColumn("in_period", (F.col("period_days") >= min_days).cast("int")))


def period_phase(weeks: DataFrame, periods: DataFrame, window_days: int = 7) -> DataFrame:
    """pre when 0 < days from week end to period start ≤ 7; post when
    0 < days from period end to week start ≤ 7; pre tested first (JN11)."""
    we = F.date_add("week_start", 6)
    pre = F.datediff(F.col("start"), we)
    post = F.datediff(F.col("week_start"), F.col("end"))
    j = weeks.join(F.broadcast(periods), (pre.between(1, window_days)) | (post.between(1, window_days)), "left")
    return (j.groupBy("week_start")
            .agg(F.max(pre.between(1, window_days).cast("int")).alias("_pre"),
                 F.max(post.between(1, window_days).cast("int")).alias("_post"))
            .select("week_start", F.when(F.col("_pre") == 1, "pre").when(F.col("_post") == 1, "post")
                    .otherwise("none").alias("period_phase")))


def event_proximity(days: DataFrame, events: DataFrame, cap: int = 30) -> DataFrame:
    """Days since the previous and until the next event date, capped (JN10).
    ``events`` is a small calendar: broadcast, range join, min per day."""
    j = days.join(F.broadcast(events.select(F.col("date").alias("_e"))), how="left")
    diff = F.datediff(F.col("order_date"), F.col("_e"))
    return (j.groupBy("order_date")
            .agg(F.min(F.when(diff >= 0, diff)).alias("_prev"), F.min(F.when(diff <= 0, -diff)).alias("_next"))
            .select("order_date", F.least(F.coalesce("_prev", F.lit(cap)), F.lit(cap)).alias("days_since_event"),
                    F.least(F.coalesce("_next", F.lit(cap)), F.lit(cap)).alias("days_to_event")))


# Holiday order and codes.
HOLIDAY_PRIORITY = ["new_year_eve", "eid_al_fitr", "eid_al_adha", "christmas", "national", "new_year"]
HOLIDAY_CODES = {"none": 0, "new_year": 1, "new_year_eve": 2, "eid_al_fitr": 3, "eid_al_adha": 4,
                 "national": 5, "christmas": 6}


def holiday_features(weeks: DataFrame, holidays: DataFrame) -> DataFrame:
    """Holidays per week, flag, highest-priority type and its code (SF14)."""
    prio = F.array_position(F.array(*[F.lit(h) for h in HOLIDAY_PRIORITY]), F.col("type"))
    we = F.date_add("week_start", 6)
    j = weeks.join(F.broadcast(holidays), F.col("date").between(F.col("week_start"), we), "left")
    g = j.groupBy("week_start").agg(F.count("date").alias("holiday_count"),
                                    F.min_by("type", prio).alias("_t"))
    code = None
    for k, v in HOLIDAY_CODES.items():
        code = F.when(F.col("holiday_type") == k, v) if code is None else code.when(F.col("holiday_type") == k, v)
    return (g.select("week_start", "holiday_count", (F.col("holiday_count") > 0).cast("int").alias("has_holiday"),
                     F.coalesce("_t", F.lit("none")).alias("holiday_type"))
            .withColumn("holiday_code", code))


# ---------------------------------------------------------------------------
# EDA operators (AG23–AG29, AG41, WN7–WN11, WN23)


def weekday_profile(daily: DataFrame, key: str) -> DataFrame:
    """Mean daily quantity by weekday and its ratio to the key's mean (AG23)."""
    g = (daily.groupBy(key, X.weekday0("order_date").alias("weekday"))
         .agg(F.avg("quantity").alias("avg_daily_quantity")))
    return g.withColumn("weekday_index",
                        F.col("avg_daily_quantity") / F.avg("avg_daily_quantity").over(Window.partitionBy(key)))


def monthly_swing(daily: DataFrame, year: int) -> DataFrame:
    """Monthly totals of one year: peak month, trough month, swing % (AG24)."""
    m = (daily.filter(F.year("order_date") == year).groupBy(F.month("order_date").alias("month"))
         .agg(F.sum("quantity").alias("q")))
    return m.agg(F.max_by("month", "q").alias("peak_month"), F.max("q").alias("peak_quantity"),
                 F.min_by("month", "q").alias("trough_month"), F.min("q").alias("trough_quantity"),
                 ((F.max("q") / F.min("q") - 1) * 100).alias("swing_pct"))


def period_impact(daily: DataFrame, key: str, pre: tuple, during: tuple) -> DataFrame:
    """Mean daily quantity during versus before a period, % change (AG25)."""
    d = F.col("order_date")
    g = daily.groupBy(key).agg(
        F.avg(F.when(d.between(F.lit(pre[0]), F.lit(pre[1])), F.col("quantity"))).alias("pre_mean"),
        F.avg(F.when(d.between(F.lit(during[0]), F.lit(during[1])), F.col("quantity"))).alias("during_mean"))
    return g.withColumn("change_pct", F.when(F.col("pre_mean") > 0,
                                             (F.col("during_mean") / F.col("pre_mean") - 1) * 100).otherwise(0.0))


def event_lift(daily: DataFrame, key: str, event_day: dt.date) -> DataFrame:
    """Event-day quantity ÷ mean quantity on other days of the same weekday (AG26)."""
    d = F.col("order_date")
    same = (X.weekday0(d) == event_day.weekday()) & (d != F.lit(event_day))
    g = daily.groupBy(key).agg(F.sum(F.when(d == F.lit(event_day), F.col("quantity"))).alias("event_quantity"),
                               F.avg(F.when(same, F.col("quantity"))).alias("normal_mean"))
    return g.withColumn("lift", F.try_divide(F.col("event_quantity"), F.nullif("normal_mean", F.lit(0.0))))


def sparsity_bands(daily: DataFrame, key: str) -> DataFrame:
    """Zero-day rate % and volume band by mean daily quantity (AG27)."""
    g = daily.groupBy(key).agg((F.avg((F.col("quantity") == 0).cast("double")) * 100).alias("zero_rate_pct"),
                               F.avg("quantity").alias("avg_daily"))
    return g.withColumn("volume_band", F.when(F.col("avg_daily") >= 5, "high")
                        .when(F.col("avg_daily") >= 1, "medium").otherwise("low"))


def split_summary(df: DataFrame, date_col: str, key: str) -> DataFrame:
    """Rows, periods, date range and mean per split (AG28)."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(date_col).alias("periods"),
                                   F.countDistinct(key).alias("series"), F.min(date_col).alias("min_date"),
                                   F.max(date_col).alias("max_date"), F.avg("quantity").alias("mean_quantity"))


def median_cv(daily: DataFrame, key: str) -> DataFrame:
    """Per-series coefficient of variation and the median of it (AG29)."""
    cv = daily.groupBy(key).agg((F.stddev_samp("quantity") / F.avg("quantity")).alias("cv"))
    cv = cut_lineage(cv)
    return exact_quantiles(cv, {"median_cv": ("cv", 0.5)}).crossJoin(cv.agg(F.count(F.lit(1)).alias("series")))      # one row each


def group_monthly(daily: DataFrame, key: str, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Mean monthly quantity per item group, with peak and trough month (AG41)."""
    arr = F.array(*[F.when(F.col(key).isin(*members), F.lit(g)) for g, members in groups.items()])
    d = daily.select("*", F.explode(F.array_compact(arr)).alias("item_group"))
    m = (d.groupBy("item_group", F.year("order_date").alias("year"), F.month("order_date").alias("month"))
         .agg(F.sum("quantity").alias("q")))
    mm = m.groupBy("item_group", "month").agg(F.avg("q").alias("avg_monthly_quantity"))
    return mm.groupBy("item_group").agg(F.max_by("month", "avg_monthly_quantity").alias("peak_month"),
                                        F.min_by("month", "avg_monthly_quantity").alias("trough_month"),
                                        F.avg("avg_monthly_quantity").alias("mean_monthly_quantity"))


def chain_daily(daily: DataFrame) -> DataFrame:
    """One row per day: chain-wide quantity (bounded by the calendar)."""
    return daily.groupBy("order_date").agg(F.sum("quantity").alias("quantity"))


def trend(series: DataFrame, key: str | None = None) -> DataFrame:
    """Least-squares slope / intercept over day index and first→last growth (WN9)."""
    t = F.datediff("order_date", F.lit(dt.date(1970, 1, 1))).cast("double")
    keys = [key] if key else []
    return series.groupBy(*keys).agg(
        F.regr_slope("quantity", t).alias("slope"), F.regr_intercept("quantity", t).alias("intercept"),
        ((F.try_divide(F.max_by("quantity", "order_date"),
                       F.nullif(F.min_by("quantity", "order_date"), F.lit(0.0))) - 1) * 100).alias("growth_pct"))


def acf(series: DataFrame, nlags: int, key: str | None = None) -> DataFrame:
    """Autocorrelation at lags 0..nlags with the series' global mean (WN10).

    Lag pairs come from an equi-join on (key, day − k) with the k values
    exploded, so no ordered window spans the whole series."""
    keys = [key] if key else []
    mu = series.groupBy(*keys).agg(F.avg("quantity").alias("_mu"))
    s = (series.join(bounded(mu), keys) if keys else series.crossJoin(F.broadcast(mu)))
    s = s.withColumn("_x", F.col("quantity") - F.col("_mu"))
    den = s.groupBy(*keys).agg(F.sum(F.col("_x") * F.col("_x")).alias("_den"))
    lagged = (s.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(nlags))).alias("lag"),
                       F.col("order_date").alias("_d"), F.col("_x").alias("_xl"))
              .withColumn("order_date", F.date_add("_d", F.col("lag"))).drop("_d"))
    pairs = s.select(*keys, "order_date", "_x").join(lagged, keys + ["order_date"])
    num = pairs.groupBy(*keys, "lag").agg(F.sum(F.col("_x") * F.col("_xl")).alias("_num"))
    out = num.join(den, keys) if keys else num.crossJoin(den)
    return out.select(*keys, "lag", (F.col("_num") / F.col("_den")).alias("acf"))


def moving_averages(series: DataFrame) -> DataFrame:
    """Trailing 7 / 30-row and centred 30-row means, full windows only (WN7, WN8)."""
    w = Window.orderBy("order_date")
    out = series
    for n in (7, 30):
        fr = w.rowsBetween(-(n - 1), 0)
        out = out.withColumn(f"ma_{n}", F.when(F.count(F.lit(1)).over(fr) == n, F.avg("quantity").over(fr)))
    fr = w.rowsBetween(-15, 14)
    return out.withColumn("centred_ma_30", F.when(F.count(F.lit(1)).over(fr) == 30, F.avg("quantity").over(fr)))


def decompose(series: DataFrame, period: int = 7) -> DataFrame:
    """Additive decomposition with an odd period: centred trend, phase means
    of the detrended series minus their mean, residual (WN11)."""
    half = period // 2
    w = Window.orderBy("order_date")
    fr = w.rowsBetween(-half, half)
    s = series.withColumn("trend", F.when(F.count(F.lit(1)).over(fr) == period, F.avg("quantity").over(fr)))
    s = s.withColumn("phase", F.pmod(F.datediff("order_date", F.lit(dt.date(1970, 1, 1))), F.lit(period)))
    ph = (s.groupBy("phase").agg(F.avg(F.col("quantity") - F.col("trend")).alias("_pm")))
    ph = ph.withColumn("seasonal", F.col("_pm") - F.avg("_pm").over(Window.partitionBy())).drop("_pm")
    return (s.join(F.broadcast(ph), "phase")   # one row per phase
            .withColumn("residual", F.col("quantity") - F.col("trend") - F.col("seasonal")))


def explained_variance(decomposed: DataFrame) -> DataFrame:
    """(1 − var(residual) / var(series)) · 100 with sample variances (WN11)."""
    return decomposed.agg(((1 - F.var_samp("residual") / F.var_samp("quantity")) * 100).alias("explained_pct"))


def spike(series: DataFrame, events: DataFrame) -> DataFrame:
    """Event-day quantity versus its own trailing 7-day mean (WN23)."""
    w = Window.orderBy("order_date").rowsBetween(-7, -1)
    s = series.withColumn("trailing_7", F.avg("quantity").over(w))
    return (s.join(F.broadcast(events.select(F.col("date").alias("order_date"))), "order_date", "left_semi")
            .withColumn("spike_ratio", F.try_divide(F.col("quantity"), F.nullif("trailing_7", F.lit(0.0)))))


# ---------------------------------------------------------------------------
# Baselines and metrics (DP31–DP36, AG45, JN15, SF21)


def naive_forecasts(weekly: DataFrame, key: str) -> DataFrame:
    """Predictions for validation and test weeks from the training weeks: mean,
    last value, seasonal naive over the last 4 and 52 weeks tiled (DP32)."""
    hist = weekly.filter(F.col("split") == "train")
    test = weekly.filter(F.col("split") != "train")
    wd = Window.partitionBy(key).orderBy(F.desc("week_start"))
    h = hist.withColumn("_back", F.row_number().over(wd))        # 1 = last training week
    weeks = h.groupBy(key).agg(F.count(F.lit(1)).alias("_weeks"))
    stats = h.groupBy(key).agg(F.avg("quantity").alias("pred_mean"),
                               F.max_by("quantity", "week_start").alias("pred_last"))
    t = test.withColumn("h", F.row_number().over(Window.partitionBy(key).orderBy("week_start")))
    out = t.join(stats, key, "left").join(weeks, key, "left")
    for m in (4, 52):
        # horizon h uses the value m − pmod(h − 1, m) weeks back; shorter histories are tiled whole
        span = F.least(F.lit(m), F.col("_weeks"))
        back = h.select(key, F.col("_back").alias(f"_b{m}"), F.col("quantity").alias(f"pred_seasonal_{m}"))
        out = (out.withColumn(f"_b{m}", (span - F.pmod(F.col("h") - 1, span)).cast("int"))
               .join(back, [key, f"_b{m}"], "left").drop(f"_b{m}"))
    return out.drop("_weeks")


def long_predictions(fc: DataFrame, key: str, models: Sequence[str]) -> DataFrame:
    """Wide prediction columns → (key, week, model, actual, predicted) (SO1)."""
    pairs = ", ".join(f"'{m}', pred_{m}" for m in models)
    return fc.select(key, "week_start", "quantity",
                     F.expr(f"stack({len(models)}, {pairs}) AS (model, predicted)")) \
        .withColumnRenamed("quantity", "actual")


def forecast_metrics(preds: DataFrame, by: Sequence[str], scale: DataFrame | None = None,
                     scale_keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, MAPE (actual > 0), sMAPE, WAPE, R², bias, MASE (DP31, DP33)."""
    a, p = F.col("actual"), F.col("predicted")
    e = a - p
    ae = F.abs(e)
    den = (F.abs(a) + F.abs(p)) / 2
    g = preds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(ae).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.when(a > 0, ae / a)).alias("mape"),
        F.avg(F.when(den > 0, ae / den)).alias("smape"),
        F.try_divide(F.sum(ae), F.sum(a)).alias("wape"), F.avg(e).alias("bias"),
        F.sum(e * e).alias("_ssr"), (F.sum(a * a) - F.sum(a) * F.sum(a) / F.count(F.lit(1))).alias("_sst"))
    g = g.withColumn("r2", F.when(F.col("_sst") > 0, 1 - F.col("_ssr") / F.col("_sst")).otherwise(0.0)) \
        .drop("_ssr", "_sst")
    if scale is not None:
        g = (g.join(scale, list(scale_keys), "left") if scale_keys else g.crossJoin(scale))
        g = g.withColumn("mase", F.try_divide(F.col("mae"), F.nullif("naive_mae", F.lit(0.0)))).drop("naive_mae")
    return g


def naive_scale(weekly: DataFrame, key: str, m: int = 1, per_series: bool = True) -> DataFrame:
    """Mean |y_t − y_{t−m}| on the training split (MASE denominator)."""
    w = Window.partitionBy(key).orderBy("week_start")
    tr = weekly.filter(F.col("split") == "train").withColumn("_d", F.abs(F.col("quantity") - F.lag("quantity", m).over(w)))
    keys = [key] if per_series else []
    return tr.groupBy(*keys).agg(F.avg("_d").alias("naive_mae"))


def head_to_head(per_series: DataFrame, key: str, a: str, b: str, metric: str = "mae") -> DataFrame:
    """Share of series where model a beats b on a metric (DP34)."""
    x = per_series.filter(F.col("model") == a).select(key, F.col(metric).alias("_a"))
    y = per_series.filter(F.col("model") == b).select(key, F.col(metric).alias("_b"))
    j = x.join(y, key)
    return j.agg(F.count(F.lit(1)).alias("series"),
                 (F.avg((F.col("_a") < F.col("_b")).cast("double")) * 100).alias(f"{a}_wins_pct"),
                 (F.avg((F.col("_b") < F.col("_a")).cast("double")) * 100).alias(f"{b}_wins_pct"),
                 (F.avg((F.col("_a") == F.col("_b")).cast("double")) * 100).alias("ties_pct"))


def wilcoxon(per_series: DataFrame, key: str, a: str, b: str, metric: str = "mae") -> DataFrame:
    """Wilcoxon signed-rank test on paired per-series errors, normal
    approximation with tie correction; zero differences dropped (DP35)."""
    x = per_series.filter(F.col("model") == a).select(key, F.col(metric).alias("_a"))
    y = per_series.filter(F.col("model") == b).select(key, F.col(metric).alias("_b"))
    d = x.join(y, key).select((F.col("_a") - F.col("_b")).alias("d")).filter(F.col("d") != 0)
    d = d.withColumn("ad", F.abs("d"))
    # average rank of |d| among ties = (lowest rank + highest rank) / 2; one
    # row per distinct |d| (bounded by the number of series) carries the ranks
    ties = d.groupBy("ad").agg(F.count(F.lit(1)).alias("t"))
    ties = cut_lineage(global_running_sum(ties, [F.asc("ad")], {"upto": F.col("t")}).withColumn("r", F.col("upto") - F.col("t") + (F.col("t") + 1) / 2.0))
    r = d.join(bounded(ties), "ad")
    g = r.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"),
              F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("w_minus"))
    tc = ties.agg(F.coalesce(F.sum(F.pow("t", 3) - F.col("t")), F.lit(0.0)).alias("_tc"))
    n = F.col("n")
    mean = n * (n + 1) / 4
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_tc") / 48
    stat = F.least("w_plus", "w_minus")
    return (g.crossJoin(tc).select("n", "w_plus", "w_minus", stat.alias("statistic"),
                                   F.try_divide(stat - mean, F.sqrt(var)).alias("z"))
            .withColumn("effect_size", F.abs("z") / F.sqrt("n")))


def winners(per_series: DataFrame, key: str, metric: str = "mae") -> DataFrame:
    """Best model per series (lowest metric, ties by name) and the vote (DP36)."""
    w = Window.partitionBy(key).orderBy(F.asc(metric), F.asc("model"))
    best = per_series.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    return best.groupBy(F.col("model").alias("winner")).agg(F.count(F.lit(1)).alias("series_won"))


def votes(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Winner of each group by WAPE, R² and |bias| (ties by name), and the vote over the three (DP36).

    Models that win as many criteria are told apart by the WAPE winner, then by name."""
    m = forecast_metrics(preds, [*by, "model"])
    order = {"wape": F.col("wape"), "r2": -F.col("r2"), "bias": F.abs("bias")}
    best = m.groupBy(*by).agg(*[F.min(F.struct(v.alias("v"), F.col("model"))).getField("model").alias(f"{c}_winner") for c, v in order.items()])
    picks = F.array(*[F.col(f"{c}_winner") for c in order])
    score = F.array_max(F.transform(F.array_distinct(picks), lambda x: F.struct(
        F.size(F.filter(picks, lambda y: y == x)).alias("votes"), (x == F.col("wape_winner")).alias("first"), x.alias("model"))))
    return best.withColumn("_s", score).select(*by, *[f"{c}_winner" for c in order], F.col("_s.model").alias("winner"), F.col("_s.votes").cast("int").alias("votes"))


def residual_profile(preds: DataFrame) -> DataFrame:
    """MAE and bias by week-of-year (AG45)."""
    e = F.col("actual") - F.col("predicted")
    return (preds.groupBy("model", F.weekofyear("week_start").alias("week_of_year"))
            .agg(F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.sum(e).alias("residual_sum")))


def residual_by_month(preds: DataFrame) -> DataFrame:
    """MAE and bias by model and calendar month (AG45)."""
    e = F.col("actual") - F.col("predicted")
    return (preds.groupBy("model", F.month("week_start").alias("month"))
            .agg(F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias")))


def daily_features(daily: DataFrame, key: str, lags=(1, 2, 3, 7, 14, 21, 28)) -> DataFrame:
    """Daily lags and leakage-safe rolling windows of earlier days (WN1, WN3): mean, std, max, min over 7,
    mean and std over 14, mean over 28.  One row per key and day: a key's window is bounded by the calendar."""
    w = Window.partitionBy(key).orderBy("order_date")
    back = lambda n: w.rowsBetween(-n, -1)
    q = F.col("quantity")
    return daily.select(
        key, "order_date", "quantity", *[F.lag("quantity", n).over(w).alias(f"lag_{n}") for n in lags],
        F.avg(q).over(back(7)).alias("rolling_mean_7"), F.stddev_samp(q).over(back(7)).alias("rolling_std_7"),
        F.max(q).over(back(7)).alias("rolling_max_7"), F.min(q).over(back(7)).alias("rolling_min_7"),
        F.avg(q).over(back(14)).alias("rolling_mean_14"), F.stddev_samp(q).over(back(14)).alias("rolling_std_14"),
        F.avg(q).over(back(28)).alias("rolling_mean_28"))


def volume_tiers(weekly: DataFrame, key: str) -> DataFrame:
    """Series tier from its train-split mean weekly quantity (SF21)."""
    return (weekly.filter(F.col("split") == "train").groupBy(key)
            .agg(F.avg("quantity").alias("train_mean"))
            .withColumn("volume_tier", X.volume_tier("train_mean")))


def align(pred: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Predictions aligned with actuals on (series, period) (JN15)."""
    return pred.join(actual, list(keys), "inner")


def horizon(base: DataFrame, n: int, band: float = 0.2) -> DataFrame:
    """Flat multi-week horizon with a ±band (SF25; the reference's random drift
    is replaced by a flat repeat so results are reproducible)."""
    return base.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("week_offset")) \
        .withColumn("predicted_demand", F.greatest(F.lit(1), F.round("base_pred").cast("bigint"))) \
        .withColumn("confidence_upper", F.round(F.col("predicted_demand") * (1 + band)).cast("bigint")) \
        .withColumn("confidence_lower", F.greatest(F.lit(0), F.round(F.col("predicted_demand") * (1 - band)).cast("bigint")))
