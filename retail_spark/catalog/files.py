"""Source / sink round trips over Spark-derived data of the given tables.

Each query writes a view of the input tables into a fresh folder under the
shared checkpoint folder and reads it back through the library readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from retail_spark.catalog import register
from retail_spark.catalog.segments import AUDIENCES, BASE, NAMED, cte
from retail_spark.plans import customers as C
from retail_spark.session import shared_path
from retail_spark.sources import files as IO

ORDERS_SCHEMA = ("order_id BIGINT, customer_id BIGINT, status STRING, status_code STRING, total_amount DOUBLE, "
                 "created_at TIMESTAMP_NTZ, cashier_id STRING, table_id BIGINT")


@register("orders_pipe_csv_round_trip", sql="SELECT * FROM orders_v")
def orders_pipe_csv_round_trip(t):
    """SNK1 write CSV (pipe separator, header) → SRC1 read with a fixed schema."""
    path = IO.write_csv(t.orders_v, shared_path(t.spark, "orders_csv"), sep="|")
    return IO.read_lines(t.spark, path, ORDERS_SCHEMA)


@register("lines_csv_dates", sql="""
SELECT order_id, item_id, quantity, order_date FROM sale_lines""")
def lines_csv_dates(t):
    """SRC2: comma CSV with a text date column parsed to DATE."""
    src = t.sale_lines.select("order_id", "item_id", "quantity",
                              F.date_format("order_date", "yyyy-MM-dd").alias("order_date"))
    path = IO.write_csv(src, shared_path(t.spark, "lines_csv"))
    return IO.read_csv(t.spark, path, "order_id BIGINT, item_id BIGINT, quantity DOUBLE, order_date STRING",
                       ["order_date"])


@register("segment_summary_json", sql=cte(*BASE) + """
SELECT rfm_segment, count(*) AS customers, avg(recency) AS avg_recency, sum(monetary) AS total_revenue
FROM features GROUP BY rfm_segment""")
def segment_summary_json(t):
    """SNK3 JSON summary of aggregates → SRC3 read back with a schema."""
    from retail_spark.catalog.segments import features
    f = features(t)[1]
    summ = f.groupBy("rfm_segment").agg(F.count(F.lit(1)).alias("customers"), F.avg("recency").alias("avg_recency"),
                                        F.sum("monetary").alias("total_revenue"))
    path = IO.write_json(summ, shared_path(t.spark, "segments_json"))
    return IO.read_json(t.spark, path, "rfm_segment STRING, customers BIGINT, avg_recency DOUBLE, total_revenue DOUBLE")


@register("orders_via_sql_view", sql="""
SELECT status, count(*) AS orders, sum(total_amount) AS revenue FROM orders_v GROUP BY status""")
def orders_via_sql_view(t):
    """SRC4: a registered view queried through SQL text."""
    t.orders_v.createOrReplaceTempView("rs_orders_v")
    return IO.read_table(t.spark, "rs_orders_v",
                         "SELECT status, count(*) AS orders, sum(total_amount) AS revenue FROM rs_orders_v GROUP BY status")


@register("lineitem_audit", sql="""
WITH n AS (SELECT count(*) AS rows FROM lineitem),
d AS (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM lineitem)),
nulls AS (UNPIVOT (SELECT """ + ", ".join(
    f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in
    ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
     "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]) + """ FROM lineitem)
   ON COLUMNS(*) INTO NAME column_name VALUE null_count)
SELECT rows, rows - d AS duplicate_rows, column_name, null_count FROM n, d, nulls""")
def lineitem_audit(t):
    """SRC5 required-column check + SRC6 audit: rows, duplicates, NULLs per column."""
    li = IO.require_columns(t.raw("lineitem"), ["l_orderkey", "l_partkey", "l_quantity"])
    return IO.audit(li)


@register("coerced_event_text", sql="""
SELECT event_id, TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) AS value, TRY_CAST(props AS DOUBLE) AS props,
       TRY_CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS ts_text, NULL::TIMESTAMP AS bad_ts
FROM events""")
def coerced_event_text(t):
    """SRC7: text → number / timestamp with bad values as NULL (ANSI-safe)."""
    e = t.raw("events").select("event_id", F.col("value").cast("string").alias("value"), "props",
                               F.date_format("ts", IO.TS_FORMAT).alias("ts_text"),
                               F.col("props").alias("bad_ts"))
    out = IO.coerce(e, numeric=["value", "props"], timestamps=["ts_text", "bad_ts"])
    return out.withColumn("ts_text", F.col("ts_text").cast("timestamp_ntz")) \
        .withColumn("bad_ts", F.col("bad_ts").cast("timestamp_ntz"))


@register("appended_line_flags", sql="""
SELECT section, is_voided, count(*) AS lines FROM sale_lines GROUP BY section, is_voided""")
def appended_line_flags(t):
    """SNK2: two bulk appends into one table with the 0/1 → boolean fix-up."""
    path = shared_path(t.spark, "lines_append")
    s = t.sale_lines.select("section", F.col("is_voided").cast("int").alias("is_voided"))
    IO.append_table(s.filter("is_voided = 0"), path, ["is_voided"])
    IO.append_table(s.filter("is_voided = 1"), path, ["is_voided"])
    return t.spark.read.parquet(path).groupBy("section", "is_voided").agg(F.count(F.lit(1)).alias("lines"))


@register("audience_partitions", sql=cte(*BASE, NAMED, AUDIENCES) + "SELECT customer_id, target_group FROM long")
def audience_partitions(t):
    """SNK4: one folder per target audience, read back with the partition column."""
    from retail_spark.catalog.segments import named_features
    from retail_spark.plans.customers import target_audiences
    long = target_audiences(named_features(t)).select("customer_id", "target_group")
    path = IO.write_partitioned(long, shared_path(t.spark, "audiences"), "target_group")
    return t.spark.read.parquet(path).select("customer_id", "target_group")
