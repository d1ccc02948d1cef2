"""Streaming queries: batch-equal to their SQL twins once the stream has
consumed the whole table."""

from __future__ import annotations

from retail_spark.catalog import register
from retail_spark.catalog.inventory import LEDGER
from retail_spark.catalog.segments import cte
from retail_spark.streaming import jobs


@register("stream_stock_ledger", sql=cte(LEDGER) + """
, lv2 AS (SELECT *, coalesce(lag(stock_level) OVER (PARTITION BY product_id
            ORDER BY ts, order_id, line_number, supplier_id, delta, amount, flag), coalesce(start_stock, 0.0)) AS prev_level
          FROM lv)
SELECT product_id, count(*) AS movements,
       greatest(0.0, max(coalesce(start_stock, 0.0)) + sum(delta) - least(0.0, min(running_unclamped))) AS final_stock,
       min(stock_level) AS min_level, count(*) FILTER (WHERE stock_level <= 1e-6) AS zero_hits,
       count(*) FILTER (WHERE stock_level <= 100 AND prev_level > 100) AS low_stock_alerts
FROM lv2 GROUP BY product_id""")
def stream_stock_ledger(t):
    """ST1: stock ledger as keyed running state floored at 0, low-stock crossings."""
    return jobs.stock_ledger_stream(t.spark, t.sf_dir, t.products_v)


@register("stream_daily_sales", sql="""
SELECT CAST(created_at AS DATE) AS period_start, count(*) AS orders, sum(total_amount) AS revenue
FROM orders_v WHERE status = 'paid' GROUP BY 1""")
def stream_daily_sales(t):
    """ST2: daily paid orders and revenue from an order stream (watermark + window)."""
    return jobs.daily_sales_stream(t.spark, t.sf_dir)
