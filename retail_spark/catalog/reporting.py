"""Reporting queries (AG1–AG5, TK1, DP37–DP38, AG46)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from retail_spark.catalog import register
from retail_spark.plans import reporting as R
from retail_spark.sources.tables import has_status

AS_OF = dt.date(2001, 8, 1)
AS_OF_TS = dt.datetime(2001, 8, 1, 12, 0, 0)


@register("product_performance", sql="""
SELECT item_id AS product_id, item_name AS product_name, sum(quantity) AS total_quantity,
       sum(line_total) AS total_revenue, count(*) AS order_count
FROM sale_lines WHERE status = 'paid' GROUP BY item_id, item_name""")
def product_performance(t):
    """AG4: per-product quantity, revenue and line count over paid orders."""
    return R.product_performance(t.sale_lines)


@register("top_products", sql="""
SELECT item_name AS product_name, sum(quantity) AS total_qty, sum(line_total) AS total_revenue
FROM sale_lines WHERE status = 'paid' GROUP BY item_name
ORDER BY total_qty DESC, product_name LIMIT 10""")
def top_products(t):
    """TK1: top-10 products by quantity (top-k is the feature)."""
    return R.top_products(t.sale_lines, 10)


@register("payment_mix", sql="""
SELECT cashier_id AS method, count(*) AS count, sum(total_amount) AS total
FROM orders_v WHERE status = 'paid' GROUP BY cashier_id""")
def payment_mix(t):
    """AG2: paid orders count and amount by payment method."""
    return R.payment_mix(t.orders_v)


@register("sales_daily", sql="""
SELECT CAST(created_at AS DATE) AS period_start, count(*) AS orders, sum(total_amount) AS revenue
FROM orders_v WHERE status = 'paid' GROUP BY 1""")
def sales_daily(t):
    """AG3: paid orders and revenue per day."""
    return R.sales_by(t.orders_v, "daily")


@register("sales_weekly", sql="""
SELECT CAST(date_trunc('week', created_at) AS DATE) AS period_start, count(*) AS orders,
       sum(total_amount) AS revenue
FROM orders_v WHERE status = 'paid' GROUP BY 1""")
def sales_weekly(t):
    """AG3: paid orders and revenue per ISO week (Monday start)."""
    return R.sales_by(t.orders_v, "weekly")


@register("sales_monthly_since", sql="""
SELECT CAST(date_trunc('month', created_at) AS DATE) AS period_start, count(*) AS orders,
       sum(total_amount) AS revenue
FROM orders_v WHERE status = 'paid' AND created_at >= TIMESTAMP '2000-08-01 00:00:00' GROUP BY 1""")
def sales_monthly_since(t):
    """AG3 + FIL8: monthly paid revenue over the last 365 days before as-of."""
    return R.sales_by(t.orders_v, "monthly", since=dt.datetime(2000, 8, 1))


@register("dashboard_kpis", sql="""
WITH o AS (
  SELECT count(*) FILTER (WHERE status = 'paid') AS total_orders,
         coalesce(sum(total_amount) FILTER (WHERE status = 'paid'), 0.0) AS total_revenue,
         count(*) FILTER (WHERE status = 'paid' AND CAST(created_at AS DATE) = DATE '2001-08-01') AS today_orders,
         coalesce(sum(total_amount) FILTER (WHERE status = 'paid' AND CAST(created_at AS DATE) = DATE '2001-08-01'), 0.0) AS today_revenue,
         count(*) FILTER (WHERE status IN ('draft', 'in_progress', 'served')) AS active_orders
  FROM orders_v),
p AS (SELECT count(*) FILTER (WHERE stock_quantity <= low_stock_threshold) AS low_stock_count FROM products_v),
c AS (SELECT count(*) AS customer_count FROM customers_v)
SELECT o.*, p.low_stock_count, c.customer_count,
       total_revenue / greatest(total_orders, 1) AS avg_basket,
       total_revenue * 0.60 AS gross_profit, total_revenue * 0.36 AS net_profit
FROM o, p, c""")
def dashboard_kpis(t):
    """AG1: dashboard KPI row at the as-of date."""
    return R.dashboard_kpis(t.orders_v, t.products_v, t.customers_v, AS_OF)


@register("category_counts", sql="""
WITH cats AS (SELECT DISTINCT category FROM products_v)
SELECT c.category, count(p.product_id) AS product_count
FROM cats c LEFT JOIN products_v p ON c.category = p.category
GROUP BY c.category""")
def category_counts(t):
    """AG5: products per category, empty categories kept."""
    cats = t.products_v.select("category").distinct()
    return R.category_counts(t.products_v, cats)


@register("peak_hours", sql="""
SELECT hour(ts) AS hour, count(*) AS events, sum(value) AS total_value FROM events GROUP BY 1""")
def peak_hours(t):
    """DP37: activity by hour of day."""
    return R.peak_hours(t.raw("events"))


@register("revenue_last_7_days", sql="""
WITH cal AS (SELECT CAST(d AS DATE) AS day FROM range(DATE '2001-07-26', DATE '2001-08-02', INTERVAL 1 DAY) r(d)),
daily AS (SELECT CAST(created_at AS DATE) AS day, sum(total_amount) AS revenue, count(*) AS orders
          FROM orders_v WHERE status = 'paid'
            AND CAST(created_at AS DATE) BETWEEN DATE '2001-07-26' AND DATE '2001-08-01' GROUP BY 1)
SELECT cal.day, coalesce(revenue, 0.0) AS revenue, coalesce(orders, 0) AS orders
FROM cal LEFT JOIN daily USING (day)""")
def revenue_last_7_days(t):
    """DP37: daily revenue for the last 7 days, zero-filled."""
    return R.revenue_last_days(t.orders_v, AS_OF, 7)


@register("transactions", sql="""
WITH per_order AS (
  SELECT order_id, sum(price * quantity) AS subtotal, sum(line_total) AS net, count(*) AS items
  FROM sale_lines GROUP BY order_id)
SELECT o.order_id, o.created_at, o.status, o.cashier_id, items, subtotal,
       subtotal - net AS discount, net * 0.1 AS tax, net * (1 + 0.1) AS total,
       coalesce('Table ' || CAST(CASE WHEN o.status = 'paid' THEN o.table_id END AS VARCHAR), 'Takeaway') AS table_label
FROM orders_v o JOIN per_order p ON o.order_id = p.order_id""")
def transactions(t):
    """DP38: transaction list; paid orders sit at a table, others are takeaway."""
    o = t.orders_v
    return R.transactions(t.sale_lines, o,
                          table_col=F.when(F.col("status") == "paid", F.col("table_id")))


@register("open_order_age", sql="""
SELECT order_id, table_id,
       CAST(greatest(0, floor(date_diff('second', created_at, TIMESTAMP '2001-08-01 12:00:00') / 60)) AS BIGINT) AS age_minutes
FROM orders_v WHERE status IN ('draft', 'in_progress', 'served')""")
def open_order_age(t):
    """AG46: age in whole minutes of open orders at the as-of time."""
    return R.open_age_minutes(t.orders_v.filter(has_status(*R.ACTIVE_STATUSES)), AS_OF_TS)   # the code reaches the scan
