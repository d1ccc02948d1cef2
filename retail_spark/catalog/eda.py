"""Exploratory aggregates and remaining scalar operators (AG15, AG20–AG22,
AG32, AG33, WN14, SF6, SF26)."""

from __future__ import annotations

from pyspark.sql import functions as F

from retail_spark.catalog import register
from retail_spark.functions import exprs as X
from retail_spark.operators import relational as O
from retail_spark.operators.windows import latest_per

CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
DESCRIBE_COLS = ["quantity", "price", "discount_rate", "line_total"]
CORR_COLS = ["quantity", "price", "discount_rate", "list_price"]


@register("section_category_crosstab", sql="""
SELECT section, """ + ", ".join(f"count(*) FILTER (WHERE category = '{c}') AS \"{c}\"" for c in CATEGORIES) + """
FROM valid_lines GROUP BY section""")
def section_category_crosstab(t):
    """AG15: count cross tab section × category (explicit pivot values, zeros filled)."""
    return (t.valid_lines.groupBy("section").pivot("category", CATEGORIES).count()
            .na.fill(0, subset=CATEGORIES))


@register("event_hour_crosstab", sql="""
SELECT event_type, hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2""")
def event_hour_crosstab(t):
    """AG15: activity × hour heat map in long form."""
    e = t.raw("events").withColumn("hour", F.hour("ts"))
    return O.crosstab_long(e, "event_type", "hour")


@register("category_value_counts", sql="""
SELECT category, count(*) AS count, count(*) * 100.0 / (SELECT count(*) FROM valid_lines) AS pct
FROM valid_lines GROUP BY category""")
def category_value_counts(t):
    """AG20: frequency table with percentage."""
    return O.value_counts(t.valid_lines, "category")


@register("line_describe", sql="""
WITH long AS (UNPIVOT (SELECT quantity, price, discount_rate, line_total FROM sale_lines)
              ON quantity, price, discount_rate, line_total INTO NAME column_name VALUE value)
SELECT column_name, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
       quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75,
       max(value) AS max FROM long GROUP BY column_name""")
def line_describe(t):
    """AG21: count / mean / std / min / exact quartiles / max per column."""
    return O.describe(t.sale_lines, DESCRIBE_COLS)


@register("aov_by_section", sql="""
WITH o AS (SELECT order_id, section, sum(line_total) AS order_value, count(*) AS basket FROM valid_lines GROUP BY 1, 2)
SELECT section, avg(order_value) AS mean_order_value, avg(basket) AS mean_basket_lines, count(*) AS orders
FROM o GROUP BY section""")
def aov_by_section(t):
    """AG22: mean of per-order sums by section (two-level aggregation)."""
    o = (t.valid_lines.groupBy("order_id", "section")
         .agg(F.sum("line_total").alias("order_value"), F.count(F.lit(1)).alias("basket")))
    return o.groupBy("section").agg(F.avg("order_value").alias("mean_order_value"),
                                    F.avg("basket").alias("mean_basket_lines"), F.count(F.lit(1)).alias("orders"))


@register("recomputed_demand", sql="""
WITH d AS (SELECT order_date, section, count(*) AS lines, avg(price) AS mean_price FROM valid_lines GROUP BY 1, 2),
grid AS (SELECT DISTINCT order_date, section FROM sale_lines)
SELECT g.order_date, g.section, coalesce(d.lines, 0) AS lines, d.mean_price
FROM grid g LEFT JOIN d ON d.order_date = g.order_date AND d.section = g.section""")
def recomputed_demand(t):
    """AG32: demand recomputed from the lines that are left (voided ones are
    out) over the original (day, section) grid, missing → 0."""
    grid = t.sale_lines.select("order_date", "section").distinct()
    d = (t.valid_lines.groupBy("order_date", "section")
         .agg(F.count(F.lit(1)).alias("lines"), F.avg("price").alias("mean_price")))
    return (grid.join(d, ["order_date", "section"], "left")
            .withColumn("lines", F.coalesce("lines", F.lit(0))))


@register("feature_correlations", sql="""
WITH c AS (SELECT corr(quantity, line_total) AS quantity, corr(price, line_total) AS price,
                  corr(discount_rate, line_total) AS discount_rate, corr(list_price, line_total) AS list_price
           FROM sale_lines)
SELECT feature, corr, abs(corr) AS abs_corr FROM (UNPIVOT c ON quantity, price, discount_rate, list_price
       INTO NAME feature VALUE corr)""")
def feature_correlations(t):
    """AG33: Pearson correlation of each feature with the target, |r| for ranking."""
    return O.feature_corr(t.sale_lines, "line_total", CORR_COLS)


@register("latest_line_per_item", sql="""
SELECT * EXCLUDE (rn) FROM (
  SELECT order_id, item_id, order_ts, quantity, line_number, price,
         row_number() OVER (PARTITION BY item_id ORDER BY order_ts DESC, order_id DESC, line_number DESC, price DESC) AS rn
  FROM valid_lines) WHERE rn = 1""")
def latest_line_per_item(t):
    """WN14: latest sale line per item (ties by order, line, price)."""
    v = t.valid_lines.select("order_id", "item_id", "order_ts", "quantity", "line_number", "price")
    return latest_per(v, "item_id", "order_ts", ["order_id", "line_number", "price"])
