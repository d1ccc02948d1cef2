"""Input tables and the canonical views every analysis reads.

The driver tables are a star schema (orders / lineitem / part / customer /
supplier / events).  The views below give them the point-of-sale meaning the
analyses expect.  Each view exists twice: as a DataFrame builder (used by the
library) and as DuckDB CTE text (used only by the independent SQL checks in
``retail_spark.oracles``).  Both spell out the same mapping.

Mapping (fixed values of the fixture, see FIXTURES.md):

* sale line   — lineitem ⋈ orders ⋈ part; sale date is ``o_orderdate``;
  item = part, section = ``p_brand``, category = ``p_type``;
  ``is_voided`` = return flag 'R'; price = extended price / quantity.
* order status — F → paid, O → in_progress, P → draft.
* cashier and payment method — ``o_orderpriority``.
* price tier   — account balance < 3000 budget, < 7000 mid, else premium.
* product stock = ``p_size * 10``, low-stock threshold 100.
* recipe       — distinct (part, supplier) pairs of lineitem; quantity needed
  ``1 + pmod(part + supplier, 5)``.
* ingredient   — supplier; stock ``abs(s_acctbal)``; unit cost ``1 + pmod(id, 7)``.
* stock move   — each line at its ship date: +quantity for 'R', else −quantity.
* anomaly label — an order is anomalous when one of its lines has discount
  ≥ 0.10 and quantity ≥ 45.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders",
               "lineitem", "events", "documents", "embeddings", "pages",
               "benchmark", "labels", "conversations")

# Fixed values of the fixture mapping.
STATUS_BY_CODE = {"F": "paid", "O": "in_progress", "P": "draft"}
TIER_BOUNDS = (3000.0, 7000.0)           # budget < 3000 <= mid < 7000 <= premium
STOCK_PER_SIZE = 10
LOW_STOCK_THRESHOLD = 100
ANOMALY_MIN_DISCOUNT = 0.10
ANOMALY_MIN_QUANTITY = 45.0


CODE_BY_STATUS = {v: k for k, v in STATUS_BY_CODE.items()}


def has_status(*labels: str) -> Column:
    """Status test on the stored code, so that it reaches the scan (labels without a code match nothing)."""
    return F.col("status_code").isin([CODE_BY_STATUS[s] for s in labels if s in CODE_BY_STATUS])


def status_of(code: Column) -> Column:
    return (F.when(code == "F", "paid").when(code == "O", "in_progress")
            .when(code == "P", "draft"))


class Tables:
    """Lazy access to the parquet tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- canonical views -------------------------------------------------
    @cached_property
    def sale_lines(self) -> DataFrame:
        li = self.raw("lineitem")
        o = self.raw("orders")
        p = self.raw("part")
        return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
                .join(p, F.col("l_partkey") == F.col("p_partkey"))
                .select(
                    F.col("l_orderkey").alias("order_id"),
                    F.col("l_linenumber").alias("line_number"),
                    F.col("o_orderdate").alias("order_ts"),
                    F.col("o_orderdate").cast("date").alias("order_date"),
                    F.col("l_partkey").alias("item_id"),
                    F.col("p_name").alias("item_name"),
                    F.col("p_brand").alias("section"),
                    F.col("p_type").alias("category"),
                    F.col("l_quantity").alias("quantity"),
                    F.try_divide("l_extendedprice", "l_quantity").alias("price"),
                    F.col("p_retailprice").alias("list_price"),
                    F.col("l_discount").alias("discount_rate"),
                    (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("line_total"),
                    F.col("o_custkey").alias("customer_id"),
                    F.col("l_suppkey").alias("supplier_id"),
                    F.col("o_orderpriority").alias("payment_method"),
                    F.col("o_orderpriority").alias("cashier_id"),
                    (F.col("l_returnflag") == "R").alias("is_voided"),
                    status_of(F.col("o_orderstatus")).alias("status"),
                    F.col("o_orderstatus").alias("status_code"),
                ))

    @cached_property
    def valid_lines(self) -> DataFrame:
        return self.sale_lines.filter(~F.col("is_voided"))

    @cached_property
    def orders_v(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            status_of(F.col("o_orderstatus")).alias("status"),
            F.col("o_orderstatus").alias("status_code"),
            F.col("o_totalprice").alias("total_amount"),
            F.col("o_orderdate").alias("created_at"),
            F.col("o_orderpriority").alias("cashier_id"),
            (F.pmod(F.col("o_orderkey"), F.lit(30)) + 1).alias("table_id"),
        )

    @cached_property
    def customers_v(self) -> DataFrame:
        bal = F.col("c_acctbal")
        return self.raw("customer").select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            F.col("c_nationkey").alias("nation_id"),
            bal.alias("account_balance"),
            F.col("c_mktsegment").alias("archetype"),
            F.when(bal < TIER_BOUNDS[0], "budget").when(bal < TIER_BOUNDS[1], "mid")
             .otherwise("premium").alias("price_tier"),
        )

    @cached_property
    def products_v(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_brand").alias("section"),
            F.col("p_type").alias("category"),
            F.col("p_retailprice").alias("price"),
            (F.col("p_size") * STOCK_PER_SIZE).alias("stock_quantity"),
            F.lit(LOW_STOCK_THRESHOLD).alias("low_stock_threshold"),
        )

    @cached_property
    def recipe_v(self) -> DataFrame:
        pairs = self.raw("lineitem").select(
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("ingredient_id")).distinct()
        return pairs.withColumn(
            "quantity_needed",
            (1 + F.pmod(F.col("product_id") + F.col("ingredient_id"), F.lit(5))).cast("double"))

    @cached_property
    def ingredients_v(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("ingredient_id"),
            F.col("s_name").alias("ingredient_name"),
            F.lit("unit").alias("unit"),
            F.abs("s_acctbal").alias("current_stock"),
            (1 + F.pmod(F.col("s_suppkey"), F.lit(7))).cast("double").alias("cost_per_unit"),
        )

    @cached_property
    def movements_v(self) -> DataFrame:
        q = F.col("l_quantity")
        return self.raw("lineitem").select(
            F.col("l_partkey").alias("product_id"),
            F.col("l_shipdate").alias("ts"),
            F.when(F.col("l_returnflag") == "R", q).otherwise(-q).alias("delta"),
            F.when(F.col("l_returnflag") == "R", "refund").otherwise("sale").alias("reason"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line_number"),
            F.col("l_suppkey").alias("supplier_id"),
            F.col("l_extendedprice").alias("amount"),
            F.col("l_returnflag").alias("flag"),
        )

    @cached_property
    def hourly_v(self) -> DataFrame:
        return self.raw("events").withColumn("hour", F.hour("ts"))

    @cached_property
    def transitions_v(self) -> DataFrame:
        return self.raw("events").select(
            "user_id", "ts", "event_id", F.col("event_type").alias("state"))

    @cached_property
    def labels_v(self) -> DataFrame:
        """Order-level 0/1 label plus line-level anomaly kinds."""
        li = self.raw("lineitem")
        hit = (F.col("l_discount") >= ANOMALY_MIN_DISCOUNT) & (F.col("l_quantity") >= ANOMALY_MIN_QUANTITY)
        return (li.groupBy(F.col("l_orderkey").alias("order_id"))
                .agg(F.max(hit.cast("int")).alias("is_anomaly")))

    @cached_property
    def anomaly_lines_v(self) -> DataFrame:
        """One labelled row per suspicious line: order, kind, description."""
        li = self.raw("lineitem")
        hit = (F.col("l_discount") >= ANOMALY_MIN_DISCOUNT) & (F.col("l_quantity") >= ANOMALY_MIN_QUANTITY)
        return li.filter(hit).select(
            F.col("l_orderkey").alias("order_id"),
            F.when(F.col("l_returnflag") == "R", "void_after_discount")
             .otherwise("discount_abuse").alias("anomaly_type"),
            F.concat(F.lit("line "), F.col("l_linenumber").cast("string"),
                     F.lit(" qty "), F.col("l_quantity").cast("bigint").cast("string"))
             .alias("description"),
        )


# ---------------------------------------------------------------------------
# DuckDB twins of the views (CTE bodies), for the independent SQL checks.

VIEW_SQL: dict[str, str] = {
    "sale_lines": """
SELECT l.l_orderkey AS order_id, l.l_linenumber AS line_number,
       o.o_orderdate AS order_ts, CAST(o.o_orderdate AS DATE) AS order_date,
       l.l_partkey AS item_id, p.p_name AS item_name, p.p_brand AS section,
       p.p_type AS category, l.l_quantity AS quantity,
       l.l_extendedprice / l.l_quantity AS price, p.p_retailprice AS list_price,
       l.l_discount AS discount_rate,
       l.l_extendedprice * (1 - l.l_discount) AS line_total,
       o.o_custkey AS customer_id, l.l_suppkey AS supplier_id,
       o.o_orderpriority AS payment_method, o.o_orderpriority AS cashier_id,
       l.l_returnflag = 'R' AS is_voided,
       CASE o.o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'in_progress'
            WHEN 'P' THEN 'draft' END AS status, o.o_orderstatus AS status_code
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN part p ON l.l_partkey = p.p_partkey""",
    "valid_lines": "SELECT * FROM sale_lines WHERE NOT is_voided",
    "orders_v": """
SELECT o_orderkey AS order_id, o_custkey AS customer_id,
       CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'in_progress'
            WHEN 'P' THEN 'draft' END AS status, o_orderstatus AS status_code,
       o_totalprice AS total_amount, o_orderdate AS created_at,
       o_orderpriority AS cashier_id, (o_orderkey % 30) + 1 AS table_id
FROM orders""",
    "customers_v": """
SELECT c_custkey AS customer_id, c_name AS customer_name, c_nationkey AS nation_id,
       c_acctbal AS account_balance, c_mktsegment AS archetype,
       CASE WHEN c_acctbal < 3000 THEN 'budget' WHEN c_acctbal < 7000 THEN 'mid'
            ELSE 'premium' END AS price_tier
FROM customer""",
    "products_v": """
SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS section,
       p_type AS category, p_retailprice AS price, p_size * 10 AS stock_quantity,
       100 AS low_stock_threshold
FROM part""",
    "recipe_v": """
SELECT product_id, ingredient_id,
       CAST(1 + ((product_id + ingredient_id) % 5) AS DOUBLE) AS quantity_needed
FROM (SELECT DISTINCT l_partkey AS product_id, l_suppkey AS ingredient_id FROM lineitem)""",
    "ingredients_v": """
SELECT s_suppkey AS ingredient_id, s_name AS ingredient_name, 'unit' AS unit,
       abs(s_acctbal) AS current_stock, CAST(1 + (s_suppkey % 7) AS DOUBLE) AS cost_per_unit
FROM supplier""",
    "movements_v": """
SELECT l_partkey AS product_id, l_shipdate AS ts,
       CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END AS delta,
       CASE WHEN l_returnflag = 'R' THEN 'refund' ELSE 'sale' END AS reason,
       l_orderkey AS order_id, l_linenumber AS line_number, l_suppkey AS supplier_id,
       l_extendedprice AS amount, l_returnflag AS flag
FROM lineitem""",
    "hourly_v": "SELECT *, hour(ts) AS hour FROM events",
    "transitions_v": "SELECT user_id, ts, event_id, event_type AS state FROM events",
    "labels_v": """
SELECT l_orderkey AS order_id,
       max(CASE WHEN l_discount >= 0.10 AND l_quantity >= 45 THEN 1 ELSE 0 END) AS is_anomaly
FROM lineitem GROUP BY l_orderkey""",
    "anomaly_lines_v": """
SELECT l_orderkey AS order_id,
       CASE WHEN l_returnflag = 'R' THEN 'void_after_discount' ELSE 'discount_abuse' END AS anomaly_type,
       'line ' || CAST(l_linenumber AS VARCHAR) || ' qty ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS description
FROM lineitem WHERE l_discount >= 0.10 AND l_quantity >= 45""",
}

VIEW_DEPS = {"valid_lines": ["sale_lines"]}
