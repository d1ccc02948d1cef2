"""Sales reporting: dashboard KPIs, payment mix, sales by period, product
performance, category sizes, top products, transaction list, peak hours.

All inputs are the canonical views (``sale_lines``, ``orders_v``,
``products_v``, ``customers_v``).  Every report is one declarative plan;
aggregations are algebraic, so Spark combines map-side before the shuffle and
hot groups never concentrate raw rows in one task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_spark.functions.exprs import wall_clock

# Fixed values of the reference dashboard.
GROSS_MARGIN = 0.60
NET_MARGIN = 0.36
ACTIVE_STATUSES = ("draft", "in_progress", "served")
TAX_RATE = 0.10


def paid(df: DataFrame) -> DataFrame:
    """Paid rows.  Filters on the raw status code when the view carries it, so
    the predicate reaches the Parquet scan (a CASE-derived label cannot)."""
    if "status_code" in df.columns:
        return df.filter(F.col("status_code") == "F")
    return df.filter(F.col("status") == "paid")


def product_performance(lines: DataFrame) -> DataFrame:
    """Quantity, revenue and line count per product over paid orders (AG4)."""
    return (paid(lines)
            .groupBy(F.col("item_id").alias("product_id"),
                     F.col("item_name").alias("product_name"))
            .agg(F.sum("quantity").alias("total_quantity"),
                 F.sum("line_total").alias("total_revenue"),
                 F.count(F.lit(1)).alias("order_count"))
            .orderBy(F.desc("total_revenue"), "product_id"))


def top_products(lines: DataFrame, n: int = 10) -> DataFrame:
    """Top-n products by quantity over paid orders; ties by name (TK1)."""
    return (paid(lines).groupBy(F.col("item_name").alias("product_name"))
            .agg(F.sum("quantity").alias("total_qty"),
                 F.sum("line_total").alias("total_revenue"))
            .orderBy(F.desc("total_qty"), "product_name")
            .limit(n))


def payment_mix(orders: DataFrame, method: str = "cashier_id") -> DataFrame:
    """Count and sum of paid order amounts by payment method (AG2)."""
    return (paid(orders).groupBy(F.col(method).alias("method"))
            .agg(F.count(F.lit(1)).alias("count"),
                 F.sum("total_amount").alias("total")))


_TRUNC = {"daily": "day", "weekly": "week", "monthly": "month"}


def sales_by(orders: DataFrame, period: str = "daily", since: dt.datetime | None = None,
             ts: str = "created_at") -> DataFrame:
    """Paid orders and revenue per day / ISO week / month, oldest first (AG3)."""
    df = paid(orders)
    if since is not None:
        df = df.filter(F.col(ts) >= wall_clock(since))
    bucket = F.date_trunc(_TRUNC[period], F.col(ts)).cast("date")
    return (df.groupBy(bucket.alias("period_start"))
            .agg(F.count(F.lit(1)).alias("orders"),
                 F.sum("total_amount").alias("revenue"))
            .orderBy("period_start"))


def dashboard_kpis(orders: DataFrame, products: DataFrame, customers: DataFrame,
                   as_of: dt.date) -> DataFrame:
    """One KPI row (AG1): one conditional aggregate pass per table, then a
    1×1×1 combination of the three single-row results."""
    is_paid = F.col("status") == "paid"
    today = is_paid & (F.col("created_at").cast("date") == F.lit(as_of))
    o = orders.agg(
        F.count_if(is_paid).alias("total_orders"),
        F.coalesce(F.sum(F.when(is_paid, F.col("total_amount"))), F.lit(0.0)).alias("total_revenue"),
        F.count_if(today).alias("today_orders"),
        F.coalesce(F.sum(F.when(today, F.col("total_amount"))), F.lit(0.0)).alias("today_revenue"),
        F.count_if(F.col("status").isin(*ACTIVE_STATUSES)).alias("active_orders"),
    )
    p = products.agg(F.count_if(F.col("stock_quantity") <= F.col("low_stock_threshold"))
                     .alias("low_stock_count"))
    c = customers.agg(F.count(F.lit(1)).alias("customer_count"))
    return (o.crossJoin(p).crossJoin(c)   # three single-row frames
            .withColumn("avg_basket", F.col("total_revenue") / F.greatest(F.col("total_orders"), F.lit(1)))
            .withColumn("gross_profit", F.col("total_revenue") * GROSS_MARGIN)
            .withColumn("net_profit", F.col("total_revenue") * NET_MARGIN))


def category_counts(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Products per category including empty categories (AG5)."""
    return (categories.join(products.select("category", "product_id"), "category", "left")
            .groupBy("category").agg(F.count("product_id").alias("product_count")))


def peak_hours(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Activity count and value by hour of day (DP37)."""
    return (events.groupBy(F.hour(ts).alias("hour"))
            .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total_value"))
            .orderBy("hour"))


def revenue_last_days(orders: DataFrame, as_of: dt.date, days: int = 7) -> DataFrame:
    """Daily paid revenue for the ``days`` days ending at ``as_of``, with empty
    days present as zero (DP37)."""
    start = as_of - dt.timedelta(days=days - 1)
    cal = orders.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(start), F.lit(as_of))).alias("day"))
    daily = (paid(orders).filter(F.col("created_at").cast("date").between(F.lit(start), F.lit(as_of)))
             .groupBy(F.col("created_at").cast("date").alias("day"))
             .agg(F.sum("total_amount").alias("revenue"), F.count(F.lit(1)).alias("orders")))
    return (cal.join(daily, "day", "left")
            .select("day", F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
                    F.coalesce("orders", F.lit(0)).alias("orders")))


def transactions(lines: DataFrame, orders: DataFrame, tax_rate: float = TAX_RATE,
                 table_col: Column | None = None) -> DataFrame:
    """Transaction list (DP38): subtotal before discount, discount, tax on the
    discounted subtotal, total, and 'Takeaway' when an order has no table."""
    per_order = (lines.groupBy("order_id")
                 .agg(F.sum(F.col("price") * F.col("quantity")).alias("subtotal"),
                      F.sum("line_total").alias("net"),
                      F.count(F.lit(1)).alias("items")))
    o = orders.select("order_id", "created_at", "status", "cashier_id",
                      (table_col if table_col is not None else F.col("table_id")).alias("table_id"))
    return (o.join(per_order, "order_id")
            .select("order_id", "created_at", "status", "cashier_id", "items", "subtotal",
                    (F.col("subtotal") - F.col("net")).alias("discount"),
                    (F.col("net") * tax_rate).alias("tax"),
                    (F.col("net") * (1 + tax_rate)).alias("total"),
                    F.coalesce(F.concat(F.lit("Table "), F.col("table_id").cast("string")),
                               F.lit("Takeaway")).alias("table_label")))


def open_age_minutes(orders: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Whole minutes each open order has been open, never negative (AG46)."""
    mins = F.floor(F.timestamp_diff("SECOND", F.col("created_at"), wall_clock(as_of)) / 60)
    return (orders.filter(F.col("status").isin(*ACTIVE_STATUSES))
            .select("order_id", "table_id", F.greatest(F.lit(0), mins).cast("bigint").alias("age_minutes")))
