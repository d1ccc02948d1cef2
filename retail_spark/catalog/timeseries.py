"""Demand time-series queries on the section series (25 per fixture)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from retail_spark.catalog import register
from retail_spark.catalog.segments import cte
from retail_spark.functions import exprs as X
from retail_spark.operators.windows import sequences
from retail_spark.plans import timeseries as TS
from retail_spark.session import cut_lineage

TRAIN_END = dt.date(2000, 6, 30)
VAL_END = dt.date(2000, 12, 31)

# Fixed calendar dimensions of the fixture: three 30-day periods, ten dates.
PERIODS = [(dt.date(1998, 12, 20), dt.date(1999, 1, 18)),
           (dt.date(1999, 12, 9), dt.date(2000, 1, 7)),
           (dt.date(2000, 11, 27), dt.date(2000, 12, 26))]
HOLIDAYS = [(dt.date(1998, 12, 25), "christmas"), (dt.date(1998, 12, 31), "new_year_eve"),
            (dt.date(1999, 1, 1), "new_year"), (dt.date(1999, 5, 1), "national"),
            (dt.date(1999, 12, 25), "christmas"), (dt.date(1999, 12, 31), "new_year_eve"),
            (dt.date(2000, 1, 1), "new_year"), (dt.date(2000, 1, 8), "eid_al_fitr"),
            (dt.date(2000, 3, 16), "eid_al_adha"), (dt.date(2000, 5, 1), "national")]
ITEM_GROUPS = {"group_a": ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5"],
               "group_b": ["Brand#20", "Brand#21", "Brand#22", "Brand#23", "Brand#24"]}
MODELS = ["mean", "last", "seasonal_4", "seasonal_52"]


def _periods(spark):
    return spark.createDataFrame(PERIODS, "start date, `end` date")


def _holidays(spark):
    return spark.createDataFrame(HOLIDAYS, "date date, type string")


def daily(t):
    return TS.daily_demand(t.valid_lines, "section")


def weekly(t):
    # series × weeks (calendar-bounded per series), reused by forecasts,
    # scales and metrics: materialized once
    return cut_lineage(TS.split_by_date(TS.weekly_demand(daily(t), "section"), "week_start", TRAIN_END, VAL_END))


def preds_long(t):
    return TS.long_predictions(TS.naive_forecasts(weekly(t), "section"), "section", MODELS)


def _vals(rows, cols):
    def lit(v):
        return f"DATE '{v}'" if isinstance(v, dt.date) else f"'{v}'"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({', '.join(cols)})"


PERIODS_SQL = f"periods AS (SELECT * FROM {_vals(PERIODS, ['start', 'end_'])})"
HOLIDAYS_SQL = f"holidays AS (SELECT * FROM {_vals(HOLIDAYS, ['date', 'type'])})"

DAILY = """
daily_raw AS (SELECT section, order_date, sum(quantity) AS quantity FROM valid_lines GROUP BY section, order_date),
days AS (SELECT CAST(x AS DATE) AS order_date FROM (
  SELECT unnest(generate_series(min(order_date), max(order_date), INTERVAL 1 DAY)) AS x FROM daily_raw)),
daily AS (SELECT s.section, d.order_date, coalesce(r.quantity, 0.0) AS quantity
  FROM (SELECT DISTINCT section FROM daily_raw) s CROSS JOIN days d
  LEFT JOIN daily_raw r ON s.section = r.section AND d.order_date = r.order_date)"""

WEEKLY = """
weekly_raw AS (SELECT section, CAST(date_trunc('week', order_date - INTERVAL 1 DAY) AS DATE) + 1 AS week_start,
                      sum(quantity) AS quantity, count(DISTINCT order_date) AS nd FROM daily GROUP BY 1, 2),
weekly AS (SELECT section, week_start, quantity,
                  CASE WHEN week_start <= DATE '2000-06-30' THEN 'train' WHEN week_start <= DATE '2000-12-31' THEN 'val'
                       ELSE 'test' END AS split FROM weekly_raw WHERE nd = 7)"""


def _w(frame=""):
    return f"OVER (PARTITION BY section ORDER BY week_start {frame})".replace(" )", ")")


def _rows(n):
    return f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING"


FEATS = f"""
f1 AS (SELECT *, lag(quantity, 1) {_w()} AS lag_1w, lag(quantity, 2) {_w()} AS lag_2w,
              lag(quantity, 3) {_w()} AS lag_3w, lag(quantity, 4) {_w()} AS lag_4w, lag(quantity, 8) {_w()} AS lag_8w,
              avg(quantity) {_w(_rows(4))} AS rolling_mean_4w, stddev_samp(quantity) {_w(_rows(4))} AS rolling_std_4w,
              max(quantity) {_w(_rows(4))} AS rolling_max_4w, min(quantity) {_w(_rows(4))} AS rolling_min_4w,
              avg(quantity) {_w(_rows(8))} AS rolling_mean_8w, stddev_samp(quantity) {_w(_rows(8))} AS rolling_std_8w,
              avg(quantity) {_w(_rows(13))} AS rolling_mean_13w,
              avg(quantity) {_w('ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING')} AS expanding_mean
       FROM weekly),
tot AS (SELECT week_start, lag(tw, 1) OVER (ORDER BY week_start) AS total_lag_1w,
               avg(tw) OVER (ORDER BY week_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS total_rolling_4w
        FROM (SELECT week_start, sum(quantity) AS tw FROM weekly GROUP BY week_start)),
f2 AS (SELECT f1.*, lag_1w / (lag_2w + 1) AS lag_1_2_ratio, lag_1w - lag_2w AS lag_1_2_diff,
              (lag_1w + lag_2w + lag_3w + lag_4w) / 4 AS lag_1_4_mean,
              rolling_std_4w / (rolling_mean_4w + 1e-6) AS rolling_cv_4w,
              rolling_mean_4w / (rolling_mean_13w + 1e-6) AS demand_momentum,
              tot.total_lag_1w, tot.total_rolling_4w,
              CAST(floor(date_diff('day', (SELECT min(week_start) FROM weekly), f1.week_start) / 7) AS INTEGER) AS weeks_since_start
       FROM f1 LEFT JOIN tot ON f1.week_start = tot.week_start),
f3 AS (SELECT section, week_start, quantity, split, lag_1w, lag_2w, lag_3w, lag_4w, lag_8w,
              coalesce(lag_1_2_ratio, 1.0) AS lag_1_2_ratio, coalesce(lag_1_2_diff, 0.0) AS lag_1_2_diff,
              coalesce(lag_1_4_mean, 0.0) AS lag_1_4_mean,
              coalesce(rolling_mean_4w, 0.0) AS rolling_mean_4w, coalesce(rolling_std_4w, 0.0) AS rolling_std_4w,
              coalesce(rolling_max_4w, 0.0) AS rolling_max_4w, coalesce(rolling_min_4w, 0.0) AS rolling_min_4w,
              coalesce(rolling_mean_8w, 0.0) AS rolling_mean_8w, coalesce(rolling_std_8w, 0.0) AS rolling_std_8w,
              coalesce(rolling_mean_13w, 0.0) AS rolling_mean_13w, coalesce(rolling_cv_4w, 0.0) AS rolling_cv_4w,
              coalesce(demand_momentum, 1.0) AS demand_momentum, coalesce(expanding_mean, 0.0) AS expanding_mean,
              total_lag_1w, coalesce(total_rolling_4w, 0.0) AS total_rolling_4w, weeks_since_start,
              weekofyear(week_start) AS week_of_year, month(week_start) AS month, year(week_start) AS year,
              sin(2 * pi() * month(week_start) / 12.0) AS month_sin, cos(2 * pi() * month(week_start) / 12.0) AS month_cos,
              sin(2 * pi() * weekofyear(week_start) / 52.0) AS week_sin, cos(2 * pi() * weekofyear(week_start) / 52.0) AS week_cos
       FROM f2 WHERE weeks_since_start >= 8),
feats AS (SELECT * REPLACE (coalesce(total_lag_1w, (SELECT median(total_lag_1w) FROM f3)) AS total_lag_1w) FROM f3)"""

PREDS = """
hist AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY week_start DESC) AS back FROM weekly WHERE split = 'train'),
stats AS (SELECT section, avg(quantity) AS pred_mean, max_by(quantity, week_start) AS pred_last, count(*) AS weeks FROM hist GROUP BY section),
test AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY week_start) AS h FROM weekly WHERE split <> 'train'),
fc AS (SELECT t.*, s.pred_mean, s.pred_last, h4.quantity AS pred_seasonal_4, h52.quantity AS pred_seasonal_52
       FROM test t LEFT JOIN stats s ON t.section = s.section
       LEFT JOIN hist h4 ON t.section = h4.section AND h4.back = least(4, s.weeks) - ((t.h - 1) % least(4, s.weeks))
       LEFT JOIN hist h52 ON t.section = h52.section AND h52.back = least(52, s.weeks) - ((t.h - 1) % least(52, s.weeks))),
preds AS (
  SELECT section, week_start, quantity AS actual, 'mean' AS model, pred_mean AS predicted FROM fc
  UNION ALL SELECT section, week_start, quantity, 'last', pred_last FROM fc
  UNION ALL SELECT section, week_start, quantity, 'seasonal_4', pred_seasonal_4 FROM fc
  UNION ALL SELECT section, week_start, quantity, 'seasonal_52', pred_seasonal_52 FROM fc)"""


def _metrics(by):
    keys = ", ".join(by)
    return f"""SELECT {keys}, count(*) AS n, avg(abs(actual - predicted)) AS mae,
       sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse,
       avg(CASE WHEN actual > 0 THEN abs(actual - predicted) / actual END) AS mape,
       avg(CASE WHEN (abs(actual) + abs(predicted)) / 2 > 0 THEN abs(actual - predicted) / ((abs(actual) + abs(predicted)) / 2) END) AS smape,
       sum(abs(actual - predicted)) / nullif(sum(actual), 0) AS wape, avg(actual - predicted) AS bias,
       CASE WHEN sum(actual * actual) - sum(actual) * sum(actual) / count(*) > 0
            THEN 1 - sum((actual - predicted) * (actual - predicted)) / (sum(actual * actual) - sum(actual) * sum(actual) / count(*))
            ELSE 0.0 END AS r2"""


SCALE_SERIES = """
scale AS (SELECT section, avg(d) AS naive_mae FROM (
  SELECT section, abs(quantity - lag(quantity, 1) OVER (PARTITION BY section ORDER BY week_start)) AS d
  FROM weekly WHERE split = 'train') GROUP BY section)"""

PER_SERIES = f"""
m AS ({_metrics(['model', 'section'])} FROM preds GROUP BY model, section),
per_series AS (SELECT m.*, m.mae / nullif(scale.naive_mae, 0) AS mase FROM m LEFT JOIN scale USING (section))"""


# -- series construction ---------------------------------------------------

@register("daily_demand_grid", sql=cte(DAILY) + "SELECT * FROM daily")
def daily_demand_grid(t):
    """JN7: dense section × day grid, missing days 0."""
    return daily(t)


@register("weekly_demand", sql=cte(DAILY, WEEKLY) + "SELECT * FROM weekly")
def weekly_demand(t):
    """SF11 Tuesday weeks (full weeks only) + WN20 date split."""
    return weekly(t)


@register("weekly_features", sql=cte(DAILY, WEEKLY, FEATS) + "SELECT * FROM feats")
def weekly_features(t):
    """WN1 lags, WN2 lag combinations, WN3 leakage-safe rolling stats, WN4
    expanding mean, WN5 volatility and momentum, chain totals, calendar."""
    return TS.weekly_features(weekly(t), "section")


@register("hierarchy_features", sql=cte(DAILY, WEEKLY) + """
, child AS (SELECT s.section || '/' || s.category AS series, s.section, w.week_start, sum(s.quantity) AS quantity
            FROM valid_lines s JOIN weekly w ON s.section = w.section
             AND s.order_date BETWEEN w.week_start AND w.week_start + 6
            GROUP BY 1, 2, 3),
pw AS (SELECT section, week_start, lag(q, 1) OVER (PARTITION BY section ORDER BY week_start) AS parent_lag_1w,
              avg(q) OVER (PARTITION BY section ORDER BY week_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS parent_rolling_4w
       FROM (SELECT section, week_start, sum(quantity) AS q FROM child GROUP BY 1, 2)),
j AS (SELECT c.*, avg(c.quantity) OVER (PARTITION BY series ORDER BY c.week_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS rolling_mean_4w,
             pw.parent_lag_1w, pw.parent_rolling_4w
      FROM child c LEFT JOIN pw ON c.section = pw.section AND c.week_start = pw.week_start)
SELECT series, section, week_start, quantity, rolling_mean_4w,
       coalesce(parent_lag_1w, median(parent_lag_1w) OVER (PARTITION BY section)) AS parent_lag_1w, parent_rolling_4w,
       coalesce(rolling_mean_4w / (parent_rolling_4w + 1e-6), 0.0) AS share_of_parent
FROM j""")
def hierarchy_features(t):
    """WN6: (section, category) series under their section: parent lag / rolling and share."""
    # each line's Tuesday week is computed, aggregated per (section, category,
    # week), then kept only for the section's full weeks: an equi semi-join
    full_weeks = weekly(t).select("section", "week_start")
    child = (t.valid_lines
             .groupBy(F.concat_ws("/", "section", "category").alias("series"), "section",
                      X.week_start_tue("order_date").alias("week_start"))
             .agg(F.sum("quantity").alias("quantity"))
             .join(full_weeks, ["section", "week_start"], "left_semi"))
    return TS.hierarchy_features(child, "series", "section")


@register("standardised_features", sql=cte(DAILY, WEEKLY, FEATS) + """
, st AS (SELECT avg(lag_1w) FILTER (WHERE split = 'train') AS m1, stddev_pop(lag_1w) FILTER (WHERE split = 'train') AS s1,
                avg(rolling_mean_4w) FILTER (WHERE split = 'train') AS m2,
                stddev_pop(rolling_mean_4w) FILTER (WHERE split = 'train') AS s2 FROM feats)
SELECT section, week_start, split, lag_1w, rolling_mean_4w, (lag_1w - m1) / (s1 + 1e-6) AS lag_1w_std,
       (rolling_mean_4w - m2) / (s2 + 1e-6) AS rolling_mean_4w_std FROM feats, st""")
def standardised_features(t):
    """PRJ8: standardise with train-split mean and population std (+1e-6)."""
    f = TS.weekly_features(weekly(t), "section").select("section", "week_start", "split", "lag_1w", "rolling_mean_4w")
    return TS.standardise(f, ["lag_1w", "rolling_mean_4w"])


@register("lstm_sequences", sql=cte(DAILY, WEEKLY) + """
SELECT * FROM (SELECT section, week_start, quantity, split,
  list([quantity]) OVER (PARTITION BY section ORDER BY week_start ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS sequence
  FROM weekly) WHERE len(sequence) = 12""")
def lstm_sequences(t):
    """WN22: the previous 12 weekly rows as a nested array, full windows only."""
    return sequences(weekly(t), "section", "week_start", ["quantity"], 12)


# -- calendar dimensions -----------------------------------------------------

@register("period_overlap_weeks", sql=cte(DAILY, WEEKLY, PERIODS_SQL) + """
, wk AS (SELECT DISTINCT week_start FROM weekly)
SELECT week_start, CAST(coalesce(sum(CASE WHEN p.start IS NOT NULL THEN
         date_diff('day', greatest(week_start, p.start), least(week_start + 6, p.end_)) + 1 END), 0) AS INTEGER) AS period_days,
       CASE WHEN coalesce(sum(CASE WHEN p.start IS NOT NULL THEN
         date_diff('day', greatest(week_start, p.start), least(week_start + 6, p.end_)) + 1 END), 0) >= 4 THEN 1 ELSE 0 END AS in_period
FROM wk LEFT JOIN periods p ON wk.week_start <= p.end_ AND wk.week_start + 6 >= p.start GROUP BY week_start""")
def period_overlap_weeks(t):
    """JN9: days of each week inside a period; flag at ≥ 4 days."""
    wk = weekly(t).select("week_start").distinct()
    return TS.overlap_days(wk, _periods(t.spark))


@register("period_phase_weeks", sql=cte(DAILY, WEEKLY, PERIODS_SQL) + """
, wk AS (SELECT DISTINCT week_start FROM weekly),
j AS (SELECT week_start,
        max(CASE WHEN date_diff('day', week_start + 6, p.start) BETWEEN 1 AND 7 THEN 1 ELSE 0 END) AS pre,
        max(CASE WHEN date_diff('day', p.end_, week_start) BETWEEN 1 AND 7 THEN 1 ELSE 0 END) AS post
      FROM wk LEFT JOIN periods p ON date_diff('day', week_start + 6, p.start) BETWEEN 1 AND 7
                                  OR date_diff('day', p.end_, week_start) BETWEEN 1 AND 7
      GROUP BY week_start)
SELECT week_start, CASE WHEN pre = 1 THEN 'pre' WHEN post = 1 THEN 'post' ELSE 'none' END AS period_phase FROM j""")
def period_phase_weeks(t):
    """JN11: pre / post status of each week against the periods."""
    wk = weekly(t).select("week_start").distinct()
    return TS.period_phase(wk, _periods(t.spark).withColumnRenamed("end", "end"))


@register("event_proximity_days", sql=cte(DAILY, HOLIDAYS_SQL) + """
, d AS (SELECT DISTINCT order_date FROM daily)
SELECT order_date,
  least(coalesce(min(CASE WHEN date_diff('day', h.date, order_date) >= 0 THEN date_diff('day', h.date, order_date) END), 30), 30) AS days_since_event,
  least(coalesce(min(CASE WHEN date_diff('day', h.date, order_date) <= 0 THEN -date_diff('day', h.date, order_date) END), 30), 30) AS days_to_event
FROM d CROSS JOIN holidays h GROUP BY order_date""")
def event_proximity_days(t):
    """JN10: days since the previous / until the next event date, capped at 30."""
    d = daily(t).select("order_date").distinct()
    return TS.event_proximity(d, _holidays(t.spark))


@register("holiday_week_features", sql=cte(DAILY, WEEKLY, HOLIDAYS_SQL) + """
, wk AS (SELECT DISTINCT week_start FROM weekly),
g AS (SELECT week_start, count(h.date) AS holiday_count,
             arg_min(h.type, list_position(['new_year_eve', 'eid_al_fitr', 'eid_al_adha', 'christmas', 'national', 'new_year'], h.type)) AS t
      FROM wk LEFT JOIN holidays h ON h.date BETWEEN week_start AND week_start + 6 GROUP BY week_start)
SELECT week_start, holiday_count, CASE WHEN holiday_count > 0 THEN 1 ELSE 0 END AS has_holiday,
       coalesce(t, 'none') AS holiday_type,
       CASE coalesce(t, 'none') WHEN 'none' THEN 0 WHEN 'new_year' THEN 1 WHEN 'new_year_eve' THEN 2
            WHEN 'eid_al_fitr' THEN 3 WHEN 'eid_al_adha' THEN 4 WHEN 'national' THEN 5 WHEN 'christmas' THEN 6 END AS holiday_code
FROM g""")
def holiday_week_features(t):
    """SF14: holiday count, flag, priority type and code per week."""
    wk = weekly(t).select("week_start").distinct()
    return TS.holiday_features(wk, _holidays(t.spark))


# -- EDA ------------------------------------------------------------------------

@register("weekday_profile", sql=cte(DAILY) + """
, g AS (SELECT section, isodow(order_date) - 1 AS weekday, avg(quantity) AS avg_daily_quantity FROM daily GROUP BY 1, 2)
SELECT *, avg_daily_quantity / avg(avg_daily_quantity) OVER (PARTITION BY section) AS weekday_index FROM g""")
def weekday_profile(t):
    """AG23: mean daily quantity by weekday, normalised to mean 1 per section."""
    return TS.weekday_profile(daily(t), "section")


@register("monthly_swing", sql=cte(DAILY) + """
, m AS (SELECT month(order_date) AS month, sum(quantity) AS q FROM daily WHERE year(order_date) = 1999 GROUP BY 1)
SELECT arg_max(month, q) AS peak_month, max(q) AS peak_quantity, arg_min(month, q) AS trough_month,
       min(q) AS trough_quantity, (max(q) / min(q) - 1) * 100 AS swing_pct FROM m""")
def monthly_swing(t):
    """AG24: 1999 monthly totals — peak, trough and swing %."""
    return TS.monthly_swing(daily(t), 1999)


@register("period_impact", sql=cte(DAILY) + """
, g AS (SELECT section,
          avg(quantity) FILTER (WHERE order_date BETWEEN DATE '1999-11-09' AND DATE '1999-12-08') AS pre_mean,
          avg(quantity) FILTER (WHERE order_date BETWEEN DATE '1999-12-09' AND DATE '2000-01-07') AS during_mean
        FROM daily GROUP BY section)
SELECT *, CASE WHEN pre_mean > 0 THEN (during_mean / pre_mean - 1) * 100 ELSE 0.0 END AS change_pct FROM g""")
def period_impact(t):
    """AG25: period effect by section — during vs the 30 days before."""
    return TS.period_impact(daily(t), "section", (dt.date(1999, 11, 9), dt.date(1999, 12, 8)),
                            (dt.date(1999, 12, 9), dt.date(2000, 1, 7)))


@register("event_lift", sql=cte(DAILY) + """
, g AS (SELECT section, sum(quantity) FILTER (WHERE order_date = DATE '1999-12-31') AS event_quantity,
               avg(quantity) FILTER (WHERE isodow(order_date) = 5 AND order_date <> DATE '1999-12-31') AS normal_mean
        FROM daily GROUP BY section)
SELECT *, event_quantity / nullif(normal_mean, 0) AS lift FROM g""")
def event_lift(t):
    """AG26: event-day quantity vs ordinary same-weekday mean, per section."""
    return TS.event_lift(daily(t), "section", dt.date(1999, 12, 31))


@register("sparsity_bands", sql=cte(DAILY) + """
SELECT section, avg(CASE WHEN quantity = 0 THEN 1.0 ELSE 0.0 END) * 100 AS zero_rate_pct, avg(quantity) AS avg_daily,
       CASE WHEN avg(quantity) >= 5 THEN 'high' WHEN avg(quantity) >= 1 THEN 'medium' ELSE 'low' END AS volume_band
FROM daily GROUP BY section""")
def sparsity_bands(t):
    """AG27: zero-day rate and volume band per section."""
    return TS.sparsity_bands(daily(t), "section")


@register("split_summary", sql=cte(DAILY, WEEKLY) + """
SELECT split, count(*) AS rows, count(DISTINCT week_start) AS periods, count(DISTINCT section) AS series,
       min(week_start) AS min_date, max(week_start) AS max_date, avg(quantity) AS mean_quantity FROM weekly GROUP BY split""")
def split_summary(t):
    """AG28: rows, periods, date range and mean per split."""
    return TS.split_summary(weekly(t), "week_start", "section")


@register("median_cv", sql=cte(DAILY) + """
SELECT median(cv) AS median_cv, count(*) AS series FROM (
  SELECT section, stddev_samp(quantity) / avg(quantity) AS cv FROM daily GROUP BY section)""")
def median_cv(t):
    """AG29: per-series coefficient of variation and its median."""
    return TS.median_cv(daily(t), "section")


@register("group_monthly", sql=cte(DAILY) + """
, d AS (SELECT *, CASE WHEN section IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5') THEN 'group_a'
                       WHEN section IN ('Brand#20', 'Brand#21', 'Brand#22', 'Brand#23', 'Brand#24') THEN 'group_b' END AS item_group
        FROM daily),
m AS (SELECT item_group, year(order_date) AS year, month(order_date) AS month, sum(quantity) AS q
      FROM d WHERE item_group IS NOT NULL GROUP BY 1, 2, 3),
mm AS (SELECT item_group, month, avg(q) AS a FROM m GROUP BY 1, 2)
SELECT item_group, arg_max(month, a) AS peak_month, arg_min(month, a) AS trough_month, avg(a) AS mean_monthly_quantity
FROM mm GROUP BY item_group""")
def group_monthly(t):
    """AG41: item-group monthly mean with peak and trough month."""
    return TS.group_monthly(daily(t), "section", ITEM_GROUPS)


CHAIN = "chain AS (SELECT order_date, sum(quantity) AS quantity FROM daily GROUP BY order_date)"


@register("chain_moving_averages", sql=cte(DAILY, CHAIN) + """
SELECT order_date, quantity,
  CASE WHEN count(*) OVER (ORDER BY order_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7
       THEN avg(quantity) OVER (ORDER BY order_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END AS ma_7,
  CASE WHEN count(*) OVER (ORDER BY order_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) = 30
       THEN avg(quantity) OVER (ORDER BY order_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) END AS ma_30,
  CASE WHEN count(*) OVER (ORDER BY order_date ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) = 30
       THEN avg(quantity) OVER (ORDER BY order_date ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) END AS centred_ma_30
FROM chain""")
def chain_moving_averages(t):
    """WN7 trailing 7/30-day and WN8 centred 30-day means (full windows only)."""
    return TS.moving_averages(TS.chain_daily(daily(t)))


@register("section_trend", sql=cte(DAILY) + """
SELECT section, regr_slope(quantity, CAST(date_diff('day', DATE '1970-01-01', order_date) AS DOUBLE)) AS slope,
       regr_intercept(quantity, CAST(date_diff('day', DATE '1970-01-01', order_date) AS DOUBLE)) AS intercept,
       (arg_max(quantity, order_date) / nullif(arg_min(quantity, order_date), 0) - 1) * 100 AS growth_pct
FROM daily GROUP BY section""")
def section_trend(t):
    """WN9: linear trend per section (slope, intercept, first→last growth)."""
    return TS.trend(daily(t), "section")


@register("chain_acf", sql=cte(DAILY, CHAIN) + """
, c AS (SELECT order_date, quantity - avg(quantity) OVER () AS x FROM chain),
lags AS (SELECT unnest(range(0, 36)) AS lag)
SELECT lag, sum(a.x * b.x) / (SELECT sum(x * x) FROM c) AS acf
FROM c a, lags JOIN c b ON b.order_date = a.order_date - CAST(lag AS INTEGER)
GROUP BY lag""")
def chain_acf(t):
    """WN10: chain-wide autocorrelation at lags 0..35."""
    return TS.acf(TS.chain_daily(daily(t)), 35)


@register("section_acf", sql=cte(DAILY) + """
, c AS (SELECT section, order_date, quantity - avg(quantity) OVER (PARTITION BY section) AS x FROM daily),
den AS (SELECT section, sum(x * x) AS d FROM c GROUP BY section),
lags AS (SELECT unnest(range(0, 31)) AS lag)
SELECT a.section, lag, sum(a.x * b.x) / max(den.d) AS acf
FROM c a CROSS JOIN lags JOIN c b ON b.section = a.section AND b.order_date = a.order_date - CAST(lag AS INTEGER)
JOIN den ON den.section = a.section
GROUP BY a.section, lag""")
def section_acf(t):
    """WN10: autocorrelation by section at lags 0..30."""
    return TS.acf(daily(t), 30, "section")


@register("chain_decomposition", sql=cte(DAILY, CHAIN) + """
, s AS (SELECT order_date, quantity,
          CASE WHEN count(*) OVER (ORDER BY order_date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 7
               THEN avg(quantity) OVER (ORDER BY order_date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS trend,
          date_diff('day', DATE '1970-01-01', order_date) % 7 AS phase FROM chain),
ph AS (SELECT phase, avg(quantity - trend) AS pm FROM s GROUP BY phase),
ph2 AS (SELECT phase, pm - avg(pm) OVER () AS seasonal FROM ph)
SELECT s.phase, s.order_date, s.quantity, s.trend, ph2.seasonal, s.quantity - s.trend - ph2.seasonal AS residual
FROM s JOIN ph2 ON s.phase = ph2.phase""")
def chain_decomposition(t):
    """WN11: additive decomposition, period 7."""
    return TS.decompose(TS.chain_daily(daily(t)), 7)


@register("decomposition_explained", sql=cte(DAILY, CHAIN) + """
, s AS (SELECT order_date, quantity,
          CASE WHEN count(*) OVER (ORDER BY order_date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 7
               THEN avg(quantity) OVER (ORDER BY order_date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS trend,
          date_diff('day', DATE '1970-01-01', order_date) % 7 AS phase FROM chain),
ph AS (SELECT phase, avg(quantity - trend) AS pm FROM s GROUP BY phase),
ph2 AS (SELECT phase, pm - avg(pm) OVER () AS seasonal FROM ph)
SELECT (1 - var_samp(s.quantity - s.trend - ph2.seasonal) / var_samp(s.quantity)) * 100 AS explained_pct
FROM s JOIN ph2 ON s.phase = ph2.phase""")
def decomposition_explained(t):
    """WN11: explained variance of the decomposition."""
    return TS.explained_variance(TS.decompose(TS.chain_daily(daily(t)), 7))


@register("event_spikes", sql=cte(DAILY, CHAIN, HOLIDAYS_SQL) + """
, s AS (SELECT order_date, quantity,
          avg(quantity) OVER (ORDER BY order_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS trailing_7 FROM chain)
SELECT s.*, quantity / nullif(trailing_7, 0) AS spike_ratio FROM s WHERE order_date IN (SELECT date FROM holidays)""")
def event_spikes(t):
    """WN23: event-day quantity versus its trailing 7-day mean."""
    return TS.spike(TS.chain_daily(daily(t)), _holidays(t.spark))


# -- baselines and metrics ---------------------------------------------------------

@register("naive_forecasts", sql=cte(DAILY, WEEKLY, PREDS) + "SELECT * FROM fc")
def naive_forecasts(t):
    """DP32: mean, last value and seasonal naive (4 and 52 weeks tiled) from train weeks, for validation and test weeks."""
    return TS.naive_forecasts(weekly(t), "section")


@register("forecast_metrics_pooled", sql=cte(DAILY, WEEKLY, PREDS) + """
, scale AS (SELECT avg(d) AS naive_mae FROM (
  SELECT abs(quantity - lag(quantity, 1) OVER (PARTITION BY section ORDER BY week_start)) AS d
  FROM weekly WHERE split = 'train')),
m AS (""" + _metrics(["model"]) + """ FROM preds GROUP BY model)
SELECT m.*, m.mae / nullif(scale.naive_mae, 0) AS mase FROM m, scale""")
def forecast_metrics_pooled(t):
    """DP31: pooled forecast metrics per model with MASE (lag-1 naive on train)."""
    return TS.forecast_metrics(preds_long(t), ["model"],
                               TS.naive_scale(weekly(t), "section", 1, per_series=False))


@register("forecast_metrics_by_series", sql=cte(DAILY, WEEKLY, PREDS, SCALE_SERIES, PER_SERIES) + "SELECT * FROM per_series")
def forecast_metrics_by_series(t):
    """DP33: metrics by model and section with per-series MASE."""
    w = weekly(t)
    return TS.forecast_metrics(preds_long(t), ["model", "section"], TS.naive_scale(w, "section", 1), ["section"])


@register("forecast_metrics_by_tier", sql=cte(DAILY, WEEKLY, PREDS) + """
, tiers AS (SELECT section, CASE WHEN avg(quantity) >= 35 THEN 'High' WHEN avg(quantity) >= 7 THEN 'Medium' ELSE 'Low' END AS volume_tier
            FROM weekly WHERE split = 'train' GROUP BY section),
p2 AS (SELECT p.*, tiers.volume_tier FROM preds p JOIN tiers USING (section))
""" + _metrics(["model", "volume_tier"]) + " FROM p2 GROUP BY model, volume_tier")
def forecast_metrics_by_tier(t):
    """DP33 + SF21: metrics by model and volume tier."""
    tiers = TS.volume_tiers(weekly(t), "section").select("section", "volume_tier")
    return TS.forecast_metrics(preds_long(t).join(tiers, "section"), ["model", "volume_tier"])


@register("volume_tiers", sql=cte(DAILY, WEEKLY) + """
SELECT section, avg(quantity) AS train_mean,
       CASE WHEN avg(quantity) >= 35 THEN 'High' WHEN avg(quantity) >= 7 THEN 'Medium' ELSE 'Low' END AS volume_tier
FROM weekly WHERE split = 'train' GROUP BY section""")
def volume_tiers(t):
    """SF21: volume tier from the train-split weekly mean."""
    return TS.volume_tiers(weekly(t), "section")


@register("model_head_to_head", sql=cte(DAILY, WEEKLY, PREDS, SCALE_SERIES, PER_SERIES) + """
, j AS (SELECT a.section, a.mae AS ma, b.mae AS mb FROM per_series a JOIN per_series b
        ON a.section = b.section AND a.model = 'seasonal_52' AND b.model = 'mean')
SELECT count(*) AS series, avg(CASE WHEN ma < mb THEN 1.0 ELSE 0.0 END) * 100 AS seasonal_52_wins_pct,
       avg(CASE WHEN mb < ma THEN 1.0 ELSE 0.0 END) * 100 AS mean_wins_pct,
       avg(CASE WHEN ma = mb THEN 1.0 ELSE 0.0 END) * 100 AS ties_pct FROM j""")
def model_head_to_head(t):
    """DP34: head-to-head wins of seasonal-52 versus mean on MAE."""
    w = weekly(t)
    per = TS.forecast_metrics(preds_long(t), ["model", "section"], TS.naive_scale(w, "section", 1), ["section"])
    return TS.head_to_head(per, "section", "seasonal_52", "mean")


@register("wilcoxon_seasonal_vs_mean", sql=cte(DAILY, WEEKLY, PREDS, SCALE_SERIES, PER_SERIES) + """
, d AS (SELECT a.mae - b.mae AS d FROM per_series a JOIN per_series b
        ON a.section = b.section AND a.model = 'seasonal_52' AND b.model = 'mean' WHERE a.mae - b.mae <> 0),
r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d),
ties AS (SELECT count(*) AS t FROM d GROUP BY abs(d)),
g AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0.0 END) AS w_plus,
             sum(CASE WHEN d < 0 THEN r ELSE 0.0 END) AS w_minus FROM r)
SELECT n, w_plus, w_minus, least(w_plus, w_minus) AS statistic,
       (least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - (SELECT coalesce(sum(t * t * t - t), 0) FROM ties) / 48) AS z,
       abs((least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - (SELECT coalesce(sum(t * t * t - t), 0) FROM ties) / 48)) / sqrt(n) AS effect_size
FROM g""")
def wilcoxon_seasonal_vs_mean(t):
    """DP35: Wilcoxon signed-rank test on paired per-series MAE."""
    w = weekly(t)
    per = TS.forecast_metrics(preds_long(t), ["model", "section"], TS.naive_scale(w, "section", 1), ["section"])
    return TS.wilcoxon(per, "section", "seasonal_52", "mean")


@register("model_winners", sql=cte(DAILY, WEEKLY, PREDS, SCALE_SERIES, PER_SERIES) + """
SELECT model AS winner, count(*) AS series_won FROM (
  SELECT *, row_number() OVER (PARTITION BY section ORDER BY mae, model) AS rn FROM per_series) WHERE rn = 1
GROUP BY model""")
def model_winners(t):
    """DP36: best model per section and the vote."""
    w = weekly(t)
    per = TS.forecast_metrics(preds_long(t), ["model", "section"], TS.naive_scale(w, "section", 1), ["section"])
    return TS.winners(per, "section")


@register("model_votes", sql=cte(DAILY, WEEKLY, PREDS) + """
, tiers AS (SELECT section, CASE WHEN avg(quantity) >= 35 THEN 'High' WHEN avg(quantity) >= 7 THEN 'Medium' ELSE 'Low' END AS volume_tier
            FROM weekly WHERE split = 'train' GROUP BY section),
ps AS (SELECT *, CASE WHEN week_start <= DATE '""" + str(VAL_END) + """' THEN 'val' ELSE 'test' END AS split FROM preds),
p2 AS (SELECT ps.*, 'section' AS scope, section AS name FROM ps UNION ALL SELECT ps.*, 'tier', volume_tier FROM ps JOIN tiers USING (section)
       UNION ALL SELECT ps.*, 'all', 'all' FROM ps),
m AS (""" + _metrics(["split", "scope", "name", "model"]) + """ FROM p2 GROUP BY split, scope, name, model),
b AS (SELECT split, scope, name, first(model ORDER BY wape, model) AS wape_winner, first(model ORDER BY r2 DESC, model) AS r2_winner,
             first(model ORDER BY abs(bias), model) AS bias_winner FROM m GROUP BY ALL),
v AS (SELECT b.*, x.model, (wape_winner = x.model)::INT + (r2_winner = x.model)::INT + (bias_winner = x.model)::INT AS votes
      FROM b, (SELECT DISTINCT model FROM m) x)
SELECT split, scope, name, wape_winner, r2_winner, bias_winner, model AS winner, votes FROM v
QUALIFY row_number() OVER (PARTITION BY split, scope, name ORDER BY votes DESC, model = wape_winner DESC, model DESC) = 1""")
def model_votes(t):
    """DP36: winners by WAPE, R² and |bias| and the vote over them, by split: all, each section, each volume tier."""
    p = TS.split_by_date(preds_long(t), "week_start", TRAIN_END, VAL_END)
    tiers = TS.volume_tiers(weekly(t), "section").select("section", "volume_tier")
    scoped = (p.select("*", F.lit("section").alias("scope"), F.col("section").alias("name"))
              .unionByName(p.join(tiers, "section").select(*p.columns, F.lit("tier").alias("scope"), F.col("volume_tier").alias("name")))
              .unionByName(p.select("*", F.lit("all").alias("scope"), F.lit("all").alias("name"))))
    return TS.votes(scoped, ["split", "scope", "name"])


@register("residual_profile", sql=cte(DAILY, WEEKLY, PREDS) + """
SELECT model, weekofyear(week_start) AS week_of_year, avg(abs(actual - predicted)) AS mae,
       avg(actual - predicted) AS bias, sum(actual - predicted) AS residual_sum FROM preds GROUP BY 1, 2""")
def residual_profile(t):
    """AG45: residual MAE / bias / sum by model and week of year."""
    return TS.residual_profile(preds_long(t))


@register("residual_by_month", sql=cte(DAILY, WEEKLY, PREDS) + """
SELECT model, month(week_start) AS month, avg(abs(actual - predicted)) AS mae, avg(actual - predicted) AS bias FROM preds GROUP BY 1, 2""")
def residual_by_month(t):
    """AG45: residual MAE and bias by model and month."""
    return TS.residual_by_month(preds_long(t))


@register("daily_features", sql=cte(DAILY) + """
SELECT section, order_date, quantity, """ + ", ".join(f"lag(quantity, {n}) OVER w AS lag_{n}" for n in (1, 2, 3, 7, 14, 21, 28)) + """,
  avg(quantity) OVER w7 AS rolling_mean_7, stddev_samp(quantity) OVER w7 AS rolling_std_7, max(quantity) OVER w7 AS rolling_max_7,
  min(quantity) OVER w7 AS rolling_min_7, avg(quantity) OVER w14 AS rolling_mean_14, stddev_samp(quantity) OVER w14 AS rolling_std_14,
  avg(quantity) OVER w28 AS rolling_mean_28
FROM daily WINDOW w AS (PARTITION BY section ORDER BY order_date),
  w7 AS (PARTITION BY section ORDER BY order_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
  w14 AS (PARTITION BY section ORDER BY order_date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING),
  w28 AS (PARTITION BY section ORDER BY order_date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)""")
def daily_features(t):
    """WN1 + WN3, daily: lags 1, 2, 3, 7, 14, 21, 28 and rolling windows 7, 14, 28 per section."""
    return TS.daily_features(daily(t), "section")


@register("prediction_alignment", sql=cte(DAILY, WEEKLY, PREDS) + """
SELECT p.section, p.week_start, p.model, p.predicted, w.quantity, w.split
FROM (SELECT section, week_start, model, predicted FROM preds) p
JOIN weekly w ON p.section = w.section AND p.week_start = w.week_start""")
def prediction_alignment(t):
    """JN15: predictions aligned with actuals on (section, week)."""
    p = preds_long(t).select("section", "week_start", "model", "predicted")
    return TS.align(p, weekly(t), ["section", "week_start"])
