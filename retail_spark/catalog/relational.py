"""Filters, projections, joins, set operations, top-k and scalar functions
(FIL*, PRJ*, JN1–JN8, JN16, SO*, TK2–TK3, TK7, SF*)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from retail_spark.catalog import register
from retail_spark.functions import exprs as X
from retail_spark.operators import relational as O
from retail_spark.operators.ordered import global_row_number
from retail_spark.sources.tables import has_status

AS_OF = dt.datetime(2001, 8, 1)
CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]   # p_type domain


# -- filters ---------------------------------------------------------------

@register("paid_orders", sql="SELECT * FROM orders_v WHERE status = 'paid'")
def paid_orders(t):
    """FIL1: equality filter on order status."""
    return t.orders_v.filter(has_status("paid"))


@register("active_orders", sql="""
SELECT * FROM orders_v WHERE status IN ('draft', 'in_progress', 'served')""")
def active_orders(t):
    """FIL2: IN-list filter (open orders)."""
    return t.orders_v.filter(has_status("draft", "in_progress", "served"))


@register("low_stock_flags", sql="""
SELECT product_id, product_name, stock_quantity, low_stock_threshold,
       stock_quantity <= low_stock_threshold AS is_low_stock
FROM products_v""")
def low_stock_flags(t):
    """FIL3: column-versus-column predicate as a flag on every product."""
    p = t.products_v
    return p.select("product_id", "product_name", "stock_quantity", "low_stock_threshold",
                    (F.col("stock_quantity") <= F.col("low_stock_threshold")).alias("is_low_stock"))


@register("voided_line_share", sql="""
SELECT section, count(*) FILTER (WHERE NOT is_voided) AS valid_lines,
       count(*) FILTER (WHERE is_voided) AS voided_lines
FROM sale_lines GROUP BY section""")
def voided_line_share(t):
    """FIL4: valid (non-voided) versus voided lines per section."""
    return (t.sale_lines.groupBy("section")
            .agg(F.count_if(~F.col("is_voided")).alias("valid_lines"),
                 F.count_if(F.col("is_voided")).alias("voided_lines")))


@register("search_products", sql="""
SELECT * FROM products_v WHERE product_name ILIKE '%ring%' OR category ILIKE '%ring%'""")
def search_products(t):
    """FIL5: case-insensitive substring search over two columns."""
    return O.search(t.products_v, "RING", ["product_name", "category"])


@register("list_orders_filtered", sql="""
SELECT * FROM orders_v WHERE status = 'paid' AND cashier_id = '1-URGENT'""")
def list_orders_filtered(t):
    """FIL6: optional conjunctive filters (table not given → not filtered)."""
    return O.where_eq(t.orders_v.filter(has_status("paid")), table_id=None, cashier_id="1-URGENT")


@register("visible_orders", sql="SELECT * FROM orders_v WHERE cashier_id = '3-MEDIUM'")
def visible_orders(t):
    """FIL7: a non-elevated cashier sees only their own orders."""
    elevated, me = False, "3-MEDIUM"
    return t.orders_v if elevated else O.where_eq(t.orders_v, cashier_id=me)


@register("orders_last_90_days", sql="""
SELECT * FROM orders_v WHERE created_at >= TIMESTAMP '2001-08-01' - INTERVAL 90 DAY""")
def orders_last_90_days(t):
    """FIL8: relative time filter against an explicit as-of time."""
    return O.since(t.orders_v, "created_at", 90, AS_OF)


@register("lines_q1_2000", sql="""
SELECT order_id, item_id, quantity, line_total FROM sale_lines
WHERE order_date BETWEEN DATE '2000-01-01' AND DATE '2000-03-31'""")
def lines_q1_2000(t):
    """FIL9: inclusive date-range slice."""
    return O.between_dates(t.sale_lines, "order_date", dt.date(2000, 1, 1), dt.date(2000, 3, 31)) \
        .select("order_id", "item_id", "quantity", "line_total")


@register("top_quartile_customers", sql="""
WITH s AS (SELECT customer_id, sum(line_total) AS monetary FROM valid_lines GROUP BY customer_id)
SELECT * FROM s WHERE monetary >= (SELECT quantile_cont(monetary, 0.75) FROM s)""")
def top_quartile_customers(t):
    """FIL10: customers whose spend is at or above the exact 75 % quantile."""
    s = t.valid_lines.groupBy("customer_id").agg(F.sum("line_total").alias("monetary"))
    return O.above_quantile(s, "monetary", 0.75)


# -- projections -----------------------------------------------------------

@register("line_projections", sql="""
SELECT order_id, line_number, item_id,
       least(greatest(discount_rate * 10, 0.0), 0.5) AS discount_clipped,
       CASE WHEN isnan(ln(price / list_price)) OR isinf(ln(price / list_price)) THEN NULL
            ELSE ln(price / list_price) END AS log_price_ratio,
       CAST(round(CAST(price * quantity * (1 - discount_rate * 100 / 100) AS DECIMAL(20, 6)), 2) AS DOUBLE) AS line_amount,
       CASE WHEN discount_rate * 100 > 1 THEN discount_rate * 100 / 100 ELSE discount_rate * 100 END AS discount_norm
FROM sale_lines""")
def line_projections(t):
    """PRJ1 clip, PRJ2 non-finite → NULL, SF15 per-cent normalisation, SF16
    money rounding on decimals (half up), PRJ4 column order."""
    s = t.sale_lines
    pct = F.col("discount_rate") * 100
    out = s.select(
        "order_id", "line_number", "item_id",
        X.clip(F.col("discount_rate") * 10, 0.0, 0.5).alias("discount_clipped"),
        X.finite(F.ln(F.try_divide("price", "list_price"))).alias("log_price_ratio"),
        X.line_amount("price", "quantity", pct).alias("line_amount"),
        X.discount_rate(pct).alias("discount_norm"))
    front = ["item_id", "order_id"]
    return out.select(*front, *[c for c in out.columns if c not in front])


@register("order_totals", sql="""
WITH a AS (SELECT order_id, sum(CAST(round(CAST(price * quantity AS DECIMAL(20, 6)), 2) AS DECIMAL(20, 2))) AS subtotal,
                  max(discount_rate) * 100 AS pct FROM sale_lines GROUP BY order_id),
b AS (SELECT *, CAST(round(CAST(CAST(subtotal AS DOUBLE) * pct / 100 AS DECIMAL(20, 6)), 2) AS DECIMAL(20, 2)) AS discount FROM a)
SELECT order_id, CAST(subtotal AS DOUBLE) AS subtotal, CAST(discount AS DOUBLE) AS discount_amount, CAST(subtotal - discount AS DOUBLE) AS total_amount FROM b""")
def order_totals(t):
    """SF16: order subtotal, order discount and total, each rounded to cents (an order's discount is its highest line rate)."""
    return X.order_totals(t.sale_lines, F.col("price") * F.col("quantity"), F.max("discount_rate") * 100)


@register("section_codes", sql="""
SELECT section, CAST(dense_rank() OVER (ORDER BY section) - 1 AS BIGINT) AS section_code
FROM (SELECT DISTINCT section FROM sale_lines)""")
def section_codes(t):
    """PRJ5: label encoding by sorted distinct value, 0-based."""
    d = t.sale_lines.select("section").distinct()
    return global_row_number(d, [F.asc("section")], "rn").select(
        "section", (F.col("rn") - 1).alias("section_code"))


@register("category_interactions", sql="""
SELECT order_id, line_number, item_id,
""" + ",\n".join(f"CASE WHEN category = '{c}' THEN quantity ELSE 0 END AS qty_x_{c.lower()}"
                 for c in CATEGORIES) + "\nFROM sale_lines")
def category_interactions(t):
    """PRJ6: value × (category == g) for each category g, one select; SF3
    slugged column names."""
    s = t.sale_lines
    return s.select("order_id", "line_number", "item_id",
                    *[F.when(F.col("category") == c, F.col("quantity")).otherwise(0)
                      .alias(f"qty_x_{X.slug(c)}") for c in CATEGORIES])


@register("masked_customers", sql="""
SELECT customer_id,
       CASE WHEN length(regexp_replace(customer_name, '\\s+', '', 'g')) <= 4
            THEN regexp_replace(customer_name, '\\s+', '', 'g')
            ELSE repeat('*', length(regexp_replace(customer_name, '\\s+', '', 'g')) - 4)
                 || right(regexp_replace(customer_name, '\\s+', '', 'g'), 4) END AS masked_name
FROM customers_v""")
def masked_customers(t):
    """PRJ7: mask all but the last four characters of an identifier."""
    return t.customers_v.select("customer_id", X.mask_tail("customer_name", 4).alias("masked_name"))


# -- joins -----------------------------------------------------------------

@register("paid_items", sql="""
SELECT l.l_orderkey AS order_id, l.l_partkey AS item_id, l.l_quantity AS quantity,
       o.o_totalprice AS order_total
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F'""")
def paid_items(t):
    """JN1: order lines ⋈ paid orders (inner equi-join)."""
    li = t.raw("lineitem").select(F.col("l_orderkey").alias("order_id"),
                                  F.col("l_partkey").alias("item_id"), F.col("l_quantity").alias("quantity"))
    o = t.orders_v.filter(has_status("paid")).select("order_id", F.col("total_amount").alias("order_total"))
    return li.join(o, "order_id")


@register("orders_with_customer", sql="""
SELECT o.order_id, o.total_amount, coalesce(c.customer_name, 'Système') AS customer_name,
       coalesce(c.price_tier, 'unknown') AS price_tier
FROM orders_v o LEFT JOIN customers_v c
  ON o.customer_id = c.customer_id""")
def orders_with_customer(t):
    """JN2: left dimension enrichment with defaults for unmatched rows."""
    dim = t.customers_v.select("customer_id", "customer_name", "price_tier")
    return O.enrich(t.orders_v.select("order_id", "customer_id", "total_amount"), dim, "customer_id",
                    defaults={"customer_name": "Système", "price_tier": "unknown"}).drop("customer_id")


@register("first_cashier_per_customer", sql="""
WITH f AS (SELECT customer_id, cashier_id FROM (
   SELECT customer_id, cashier_id,
          row_number() OVER (PARTITION BY customer_id ORDER BY created_at, order_id) AS rn
   FROM orders_v) WHERE rn = 1)
SELECT c.customer_id, coalesce(f.cashier_id, 'cash') AS cashier_id
FROM customers_v c LEFT JOIN f ON c.customer_id = f.customer_id""")
def first_cashier_per_customer(t):
    """JN4: dictionary lookup with default — the first order's cashier or 'cash'."""
    return O.map_or(t.customers_v.select("customer_id"), t.orders_v, "customer_id", "cashier_id",
                    ["created_at", "order_id"], "cash")


@register("customer_merge_chain", sql="""
WITH n AS (SELECT customer_id, count(*) AS n_orders FROM orders_v GROUP BY customer_id),
s AS (SELECT customer_id, sum(line_total) AS spend FROM valid_lines GROUP BY customer_id),
i AS (SELECT customer_id, count(DISTINCT item_id) AS n_items FROM valid_lines GROUP BY customer_id)
SELECT c.customer_id, c.archetype, n.n_orders, s.spend, i.n_items
FROM customers_v c LEFT JOIN n USING (customer_id) LEFT JOIN s USING (customer_id)
LEFT JOIN i USING (customer_id)""")
def customer_merge_chain(t):
    """JN5: chain of left merges on one key."""
    n = t.orders_v.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_orders"))
    s = t.valid_lines.groupBy("customer_id").agg(F.sum("line_total").alias("spend"))
    i = t.valid_lines.groupBy("customer_id").agg(F.countDistinct("item_id").alias("n_items"))
    return O.merge_all([t.customers_v.select("customer_id", "archetype"), n, s, i], "customer_id")


@register("profile_match", sql="""
WITH p AS (SELECT customer_id, archetype FROM customers_v),
s AS (SELECT customer_id, sum(line_total) AS spend FROM valid_lines GROUP BY customer_id)
SELECT coalesce(p.customer_id, s.customer_id) AS customer_id, p.archetype, s.spend,
       CASE WHEN p.customer_id IS NOT NULL AND s.customer_id IS NOT NULL THEN 'both'
            WHEN p.customer_id IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS profile_transaction_match
FROM p FULL OUTER JOIN s ON p.customer_id = s.customer_id""")
def profile_match(t):
    """JN6: full outer merge of profiles and transactions with a match indicator."""
    p = t.customers_v.select("customer_id", "archetype")
    s = t.valid_lines.groupBy("customer_id").agg(F.sum("line_total").alias("spend"))
    return O.outer_indicator(p, s, "customer_id", "profile_transaction_match")


@register("anomalous_orders_semi", sql="""
SELECT * FROM orders_v o WHERE o.order_id IN (SELECT order_id FROM labels_v WHERE is_anomaly = 1)""")
def anomalous_orders_semi(t):
    """JN8: semi-join with a key set."""
    return O.semi(t.orders_v, t.labels_v.filter("is_anomaly = 1").select("order_id"), "order_id")


@register("customers_without_orders", sql="""
SELECT * FROM customers_v c WHERE NOT EXISTS (SELECT 1 FROM orders_v o WHERE o.customer_id = c.customer_id)""")
def customers_without_orders(t):
    """JN8 / SO3: anti-join."""
    return O.anti(t.customers_v, t.orders_v.select("customer_id"), "customer_id")


@register("recipe_lines", sql="""
SELECT r.product_id, p.product_name, r.ingredient_id, i.ingredient_name, i.unit, r.quantity_needed
FROM recipe_v r JOIN ingredients_v i ON r.ingredient_id = i.ingredient_id
JOIN products_v p ON r.product_id = p.product_id""")
def recipe_lines(t):
    """JN16: recipe lines with product and ingredient name and unit."""
    return (t.recipe_v.join(t.ingredients_v.select("ingredient_id", "ingredient_name", "unit"), "ingredient_id")
            .join(t.products_v.select("product_id", "product_name"), "product_id")
            .select("product_id", "product_name", "ingredient_id", "ingredient_name", "unit", "quantity_needed"))


# -- set operations ----------------------------------------------------------

@register("union_line_summaries", sql="""
SELECT section, 'valid' AS kind, sum(line_total) AS amount, NULL::BIGINT AS lines FROM valid_lines GROUP BY section
UNION ALL
SELECT section, 'voided' AS kind, NULL::DOUBLE AS amount, count(*) AS lines FROM sale_lines WHERE is_voided GROUP BY section""")
def union_line_summaries(t):
    """SO1: union by name with missing columns as NULL."""
    a = t.valid_lines.groupBy("section").agg(F.sum("line_total").alias("amount")).withColumn("kind", F.lit("valid"))
    b = (t.sale_lines.filter("is_voided").groupBy("section").agg(F.count(F.lit(1)).alias("lines"))
         .withColumn("kind", F.lit("voided")))
    return O.union_all([a, b])


@register("first_label_per_order", sql="""
SELECT order_id, anomaly_type, description FROM (
  SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY anomaly_type, description) AS rn
  FROM anomaly_lines_v) WHERE rn = 1""")
def first_label_per_order(t):
    """SO2: drop duplicate order labels, keeping the first in a stated order."""
    return O.dedup(t.anomaly_lines_v, ["order_id"], ["anomaly_type", "description"])


@register("unsold_products", sql="""
SELECT product_id, product_name FROM products_v
EXCEPT SELECT item_id, item_name FROM valid_lines""")
def unsold_products(t):
    """SO3: catalogue minus everything sold."""
    sold = t.valid_lines.select(F.col("item_id").alias("product_id")).distinct()
    return O.anti(t.products_v.select("product_id", "product_name"), sold, "product_id").distinct()


@register("customer_history", sql="""
SELECT DISTINCT customer_id, item_id FROM sale_lines WHERE status = 'paid'""")
def customer_history(t):
    """SO5: distinct products each customer bought in paid orders."""
    return t.sale_lines.filter(has_status("paid")).select("customer_id", "item_id").distinct()


# -- sorts and limits --------------------------------------------------------

@register("recent_orders", sql="""
SELECT * FROM orders_v ORDER BY created_at DESC, order_id DESC LIMIT 20""")
def recent_orders(t):
    """TK2: newest-first page (the limit is the feature)."""
    return t.orders_v.orderBy(F.desc("created_at"), F.desc("order_id")).limit(20)


@register("customer_page", sql="""
SELECT * FROM customers_v ORDER BY customer_id LIMIT 50 OFFSET 100""")
def customer_page(t):
    """TK3: offset paging."""
    return O.page(t.customers_v, [F.asc("customer_id")], 100, 50)


@register("top_items_per_section", sql="""
SELECT section, item_id, qty, rank FROM (
  SELECT section, item_id, sum(quantity) AS qty,
         row_number() OVER (PARTITION BY section ORDER BY sum(quantity) DESC, item_id) AS rank
  FROM valid_lines GROUP BY section, item_id) WHERE rank <= 3""")
def top_items_per_section(t):
    """TK7: largest three items by quantity within each section."""
    q = t.valid_lines.groupBy("section", "item_id").agg(F.sum("quantity").alias("qty"))
    return O.top_n_per_group(q, ["section"], [F.desc("qty"), F.asc("item_id")], 3)


# -- scalar functions ----------------------------------------------------------

@register("order_calendar", sql="""
SELECT order_id, year(created_at) AS year, quarter(created_at) AS quarter, month(created_at) AS month,
       day(created_at) AS day, isodow(created_at) - 1 AS weekday, dayname(created_at) AS weekday_name,
       weekofyear(created_at) AS iso_week,
       sin(2 * pi() * month(created_at) / 12.0) AS month_sin, cos(2 * pi() * month(created_at) / 12.0) AS month_cos,
       sin(2 * pi() * (isodow(created_at) - 1) / 7.0) AS weekday_sin,
       CAST(floor(date_diff('day', DATE '1995-01-01', CAST(created_at AS DATE)) / 7) AS BIGINT) AS weeks_since_start,
       CASE WHEN isodow(created_at) >= 6 THEN 1 ELSE 0 END AS is_weekend
FROM orders_v""")
def order_calendar(t):
    """SF7 date parts, SF8 cyclic encoding, SF10 weeks since start."""
    o = t.orders_v
    cal = X.calendar_cols("created_at")
    msin, mcos = X.cyclic(cal["month"], 12)
    wsin, _ = X.cyclic(cal["weekday"], 7)
    return o.select("order_id", *[cal[k].alias(k) for k in
                                  ["year", "quarter", "month", "day", "weekday", "weekday_name", "iso_week"]],
                    msin.alias("month_sin"), mcos.alias("month_cos"), wsin.alias("weekday_sin"),
                    X.weeks_since(F.col("created_at").cast("date"), dt.date(1995, 1, 1)).cast("bigint")
                    .alias("weeks_since_start"),
                    cal["is_weekend"].alias("is_weekend"))


@register("event_time_features", sql="""
SELECT event_id, hour(ts) AS hour,
       CASE WHEN hour(ts) >= 6 AND hour(ts) < 11 THEN 'morning' WHEN hour(ts) >= 11 AND hour(ts) < 16 THEN 'lunch'
            WHEN hour(ts) >= 16 AND hour(ts) < 23 THEN 'dinner' ELSE 'late_night' END AS meal_segmentation,
       CASE WHEN hour(ts) >= 5 AND hour(ts) < 11 THEN 'breakfast' WHEN hour(ts) >= 11 AND hour(ts) < 16 THEN 'lunch'
            WHEN hour(ts) >= 16 AND hour(ts) < 22 THEN 'dinner' ELSE 'late_night' END AS meal_serving,
       CASE WHEN hour(ts) >= 6 AND hour(ts) < 11 THEN 'breakfast' WHEN hour(ts) >= 11 AND hour(ts) < 15 THEN 'lunch'
            WHEN hour(ts) >= 15 AND hour(ts) < 18 THEN 'afternoon' WHEN hour(ts) >= 18 AND hour(ts) < 23 THEN 'dinner'
            ELSE 'late_night' END AS meal_training,
       CASE WHEN isodow(ts) IN (6, 7) THEN 1 ELSE 0 END AS is_weekend,
       CASE WHEN hour(ts) < 6 OR hour(ts) >= 23 THEN 1 ELSE 0 END AS is_odd_hour,
       CASE WHEN hour(ts) BETWEEN 6 AND 10 THEN 1 ELSE 0 END AS is_morning,
       CASE WHEN hour(ts) BETWEEN 11 AND 15 THEN 1 ELSE 0 END AS is_lunch,
       CASE WHEN hour(ts) BETWEEN 18 AND 22 THEN 1 ELSE 0 END AS is_dinner,
       TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS prop_k
FROM hourly_v""")
def event_time_features(t):
    """SF12 three meal-period schemes, SF13 time flags, SF28 JSON field."""
    e = t.hourly_v
    flags = X.time_flags("hour", X.weekday0("ts"))
    return e.select("event_id", "hour",
                    X.meal_period("hour", "segmentation").alias("meal_segmentation"),
                    X.meal_period("hour", "serving").alias("meal_serving"),
                    X.meal_period("hour", "training").alias("meal_training"),
                    *[v.alias(k) for k, v in flags.items()],
                    X.json_field("props", "k").alias("prop_k"))


@register("parsed_event_times", sql="""
SELECT event_id, date_trunc('minute', ts) AS parsed_ts FROM events""")
def parsed_event_times(t):
    """SF9: date text + 12-hour time text ('08:30 PM') parsed back to a timestamp."""
    e = t.raw("events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("d"),
                               F.date_format("ts", "hh:mm a").alias("tm"))
    return e.select("event_id", X.parse_order_ts("d", "tm").cast("timestamp_ntz").alias("parsed_ts"))


@register("text_cleaning", sql="""
SELECT customer_id, lower(trim(archetype)) AS archetype_key,
       contains(lower(customer_name), '00000001') AS has_token,
       starts_with(lower(trim(archetype)), 'auto') AS is_auto,
       CASE WHEN trim(coalesce(CASE WHEN archetype = 'BUILDING' THEN 'None' ELSE archetype END, '')) IN ('nan', 'None', 'NaN') THEN ''
            ELSE trim(coalesce(CASE WHEN archetype = 'BUILDING' THEN 'None' ELSE archetype END, '')) END AS archetype_clean,
       lower(trim(CASE WHEN account_balance > 0 THEN 'Yes' ELSE 'no' END)) IN ('true', '1', 'yes', 'y', 't') AS positive_balance,
       price_tier || ' | ' || archetype AS tier_archetype,
       array_to_string(list_sort(string_split(archetype || ',' || price_tier, ',')), ', ') AS tags_text
FROM customers_v""")
def text_cleaning(t):
    """SF1 lower/trim/contains/prefix, SF2 null tokens, SRC8 text → boolean,
    SF5 concatenated labels, SF4 + SF29 comma list → sorted text."""
    c = t.customers_v
    raw_arche = F.when(F.col("archetype") == "BUILDING", "None").otherwise(F.col("archetype"))
    yes = F.when(F.col("account_balance") > 0, "Yes").otherwise("no")
    return c.select("customer_id", X.norm_key("archetype").alias("archetype_key"),
                    X.contains_ci("customer_name", "00000001").alias("has_token"),
                    X.starts_ci("archetype", "auto").alias("is_auto"),
                    X.clean_token(raw_arche).alias("archetype_clean"),
                    X.to_bool(yes).alias("positive_balance"),
                    F.concat_ws(" | ", "price_tier", "archetype").alias("tier_archetype"),
                    X.set_text(X.split_list(F.concat_ws(",", "archetype", "price_tier"))).alias("tags_text"))
