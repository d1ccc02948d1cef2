"""Structured Streaming jobs (ST1, ST2).

* ``stock_ledger_stream`` — stock movements arrive as a file stream; each
  product's level is floored at zero after every movement and low-stock
  crossings are counted (ST1).  A micro-batch is sorted over many tasks; each
  (task, product) segment is a pair (sum, lowest running sum) under an
  associative operation, so segments combine without passing a product's rows
  through one task, and the level of the state table is applied to the result.
  The state table has a row for each product and a version for each batch, so
  a batch that runs again starts from the same levels.
* ``daily_sales_stream`` — paid orders arrive as a file stream; a
  watermarked one-day tumbling window counts orders and sums revenue (ST2).

Both run with ``Trigger.AvailableNow`` (process what is there, then stop),
checkpoint into the shared checkpoint folder, and write each micro-batch with
its batch id through ``foreachBatch``.  A result table is the latest row per
key over all batches, so re-emitted (updated) keys are read correctly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retail_spark.operators.broadcast import bounded
from retail_spark.operators.ordered import keyed_clamped_running
from retail_spark.session import shared_path

LINEITEM_SCHEMA = ("l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                   "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                   "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ")
ORDERS_SCHEMA = ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
                 "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING")

ORDER_COLS = ["ts", "order_id", "line_number", "supplier_id", "delta", "amount", "flag"]


def _file_stream(spark: SparkSession, folder: str, table: str, schema: str) -> DataFrame:
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
            .option("maxFilesPerTrigger", 1).parquet(folder))


def _latest(path: str, spark: SparkSession, keys: list[str]) -> DataFrame:
    out = spark.read.parquet(path)
    w = Window.partitionBy(*keys).orderBy(F.desc("batch_id"))
    return out.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "batch_id")


def _run(query_df: DataFrame, spark: SparkSession, name: str, mode: str) -> str:
    out = shared_path(spark, f"{name}-out")
    ckpt = shared_path(spark, f"{name}-ckpt")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    q = (query_df.writeStream.outputMode(mode).option("checkpointLocation", ckpt)
         .foreachBatch(sink).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def apply_movements(moves: DataFrame, state: DataFrame | None, start: DataFrame, threshold: float) -> DataFrame:
    """The state table after some movements: level, movements, lowest level, zero hits and low-stock crossings by product."""
    opened = start.select("product_id", "start_stock")
    if state is not None:
        opened = opened.join(state.select("product_id", "level"), "product_id", "full_outer")
        opened = opened.select("product_id", F.coalesce("level", "start_stock").alias("start_stock"))
    joined = moves.join(bounded(opened), "product_id", "left").fillna(0.0, subset=["start_stock"])
    run = keyed_clamped_running(joined, "product_id", [F.asc(c) for c in ORDER_COLS], F.col("delta"), F.col("start_stock"), "level", "ahead")
    new = run.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("movements"), F.min("level").alias("min_level"), F.count_if(F.col("level") <= 1e-6).alias("zero_hits"),
        F.count_if((F.col("level") <= threshold) & (F.col("ahead") > threshold)).alias("low_stock_alerts"),
        # the last level without picking a last row: C_T - min(0, min C)
        F.greatest(F.lit(0.0), F.max("start_stock") + F.sum("delta") - F.least(F.lit(0.0), F.min("running_unclamped"))).alias("level"))
    if state is None:
        return new
    both = new.select("product_id", *[F.col(c).alias(f"_{c}") for c in new.columns[1:]]).join(state, "product_id", "full_outer")
    total = lambda c: (F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c)
    return both.select("product_id", total("movements"), F.least("min_level", "_min_level").alias("min_level"), total("zero_hits"),
                       total("low_stock_alerts"), F.coalesce("_level", "level").alias("level"))


def stock_ledger(moves: DataFrame, products: DataFrame, threshold: float = 100.0) -> DataFrame:
    """ST1 over a stream of movements: per-product floored running stock and low-stock crossings."""
    spark = moves.sparkSession
    versions = shared_path(spark, "stock-ledger-state")
    start = products.select("product_id", F.col("stock_quantity").cast("double").alias("start_stock"))
    done: list[int] = []

    def step(batch: DataFrame, batch_id: int) -> None:
        here = batch.sparkSession
        state = here.read.parquet(f"{versions}/{batch_id - 1}") if batch_id else None
        apply_movements(batch, state, start, threshold).write.mode("overwrite").parquet(f"{versions}/{batch_id}")
        done.append(batch_id)

    q = (moves.writeStream.option("checkpointLocation", shared_path(spark, "stock-ledger-ckpt"))
         .foreachBatch(step).trigger(availableNow=True).start())
    q.awaitTermination()
    if not done:
        return spark.createDataFrame([], "product_id long, movements long, final_stock double, min_level double, zero_hits long, low_stock_alerts long")
    return spark.read.parquet(f"{versions}/{max(done)}").select(
        "product_id", "movements", F.col("level").alias("final_stock"), "min_level", "zero_hits", "low_stock_alerts")


def stock_ledger_stream(spark: SparkSession, folder: str, products: DataFrame,
                        threshold: float = 100.0) -> DataFrame:
    """ST1 on the line items: sales take from the stock, returns add to it."""
    li = _file_stream(spark, folder, "lineitem", LINEITEM_SCHEMA)
    q = F.col("l_quantity")
    moves = li.select(F.col("l_partkey").alias("product_id"), F.col("l_shipdate").alias("ts"),
                      F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_number"),
                      F.col("l_suppkey").alias("supplier_id"),
                      F.when(F.col("l_returnflag") == "R", q).otherwise(-q).alias("delta"),
                      F.col("l_extendedprice").alias("amount"), F.col("l_returnflag").alias("flag"))
    return stock_ledger(moves, products, threshold)


def daily_sales_stream(spark: SparkSession, folder: str, watermark: str = "1 day") -> DataFrame:
    """ST2: paid orders per day and revenue, watermarked tumbling windows."""
    o = _file_stream(spark, folder, "orders", ORDERS_SCHEMA).filter(F.col("o_orderstatus") == "F")
    # event time must be TIMESTAMP: read the wall clock as UTC, independent of
    # the session time zone, and map window starts back to UTC dates
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    o = o.withColumn("event_ts", F.timestamp_seconds(F.timestamp_diff("SECOND", epoch, F.col("o_orderdate"))))
    agg = (o.withWatermark("event_ts", watermark)
           .groupBy(F.window("event_ts", "1 day").alias("w"))
           .agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("revenue"))
           .select(F.date_from_unix_date(F.floor(F.unix_seconds(F.col("w.start")) / 86400).cast("int"))
                   .alias("period_start"), "orders", "revenue"))
    out = _run(agg, spark, "daily-sales-stream", "update")
    return _latest(out, spark, ["period_start"])
