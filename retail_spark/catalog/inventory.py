"""Inventory queries: forecast-driven stock status, ingredient needs and
shortages, clamped ledgers, refunds, state transitions, forecast summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from retail_spark.catalog import register
from retail_spark.catalog.segments import cte
from retail_spark.operators.ordered import keyed_clamped_summary, keyed_state_machine
from retail_spark.plans import inventory as INV
from retail_spark.sources.tables import has_status

# Fixed fixture parameter: allowed next event per event type (the state
# machine the transition check runs on for the events table).
EVENT_TRANSITIONS = {
    "signup": ["view", "click"],
    "view": ["view", "click", "purchase"],
    "click": ["view", "click", "purchase", "error"],
    "purchase": ["view", "click"],
    "error": ["view", "click", "error"],
}
ING_ORDER = ("ts", "order_id", "line_number", "product_id", "delta")


def _fc(t):
    return INV.weekly_forecast(t.valid_lines)


def _recipe(t):
    return t.recipe_v


FC = """
span AS (SELECT (date_diff('day', min(order_date), max(order_date)) + 1) / 7.0 AS w FROM valid_lines),
fc AS (SELECT item_id AS product_id, avg(price) AS avg_price, sum(quantity) / (SELECT w FROM span) AS forecast
       FROM valid_lines GROUP BY item_id)"""

NEED = """
need AS (SELECT r.ingredient_id, sum(greatest(0, round_even(fc.forecast, 0)) * r.quantity_needed) AS need FROM fc JOIN recipe_v r USING (product_id)
         GROUP BY r.ingredient_id),
sh AS (SELECT i.ingredient_id, i.ingredient_name, i.unit, i.current_stock, i.cost_per_unit, round(need, 1) AS need,
              greatest(0.0, round(round(need, 1) - i.current_stock, 1)) AS shortage,
              CASE WHEN greatest(0.0, round(round(need, 1) - i.current_stock, 1)) > 0.3 * round(need, 1) THEN 'CRITICAL'
                   WHEN greatest(0.0, round(round(need, 1) - i.current_stock, 1)) > 0 THEN 'LOW'
                   WHEN i.current_stock < 1.2 * round(need, 1) THEN 'WARNING' ELSE 'OK' END AS status,
              round(greatest(0.0, round(round(need, 1) - i.current_stock, 1)) * i.cost_per_unit, 2) AS cost_impact
       FROM need JOIN ingredients_v i USING (ingredient_id))"""


@register("weekly_forecast", sql=cte(FC) + "SELECT * FROM fc")
def weekly_forecast(t):
    """Stand-in forecast: mean weekly quantity per product."""
    return _fc(t)


@register("stock_status", sql=cte(FC) + """
SELECT fc.product_id, p.product_name, fc.forecast, CAST(coalesce(p.stock_quantity, 0) AS DOUBLE) AS current_stock,
       CASE WHEN coalesce(p.stock_quantity, 0) < forecast THEN 'Understocked'
            WHEN coalesce(p.stock_quantity, 0) > forecast * 2 THEN 'Overstocked' ELSE 'Optimal' END AS stock_status,
       CASE WHEN coalesce(p.stock_quantity, 0) < forecast THEN forecast - coalesce(p.stock_quantity, 0) ELSE 0.0 END AS shortage,
       forecast * avg_price AS predicted_revenue
FROM fc LEFT JOIN products_v p USING (product_id)""")
def stock_status(t):
    """SF22: stock status, shortage and predicted revenue per product."""
    return INV.stock_status(_fc(t), t.products_v)


@register("ingredient_shortages", sql=cte(FC, NEED) + "SELECT * FROM sh")
def ingredient_shortages(t):
    """JN13 recipe explosion + SF23 shortage status and cost impact."""
    return INV.ingredient_shortages(_fc(t), _recipe(t), t.ingredients_v)


@register("shortage_priority", sql=cte(FC, NEED) + """
SELECT * FROM sh ORDER BY CASE status WHEN 'CRITICAL' THEN 0 WHEN 'LOW' THEN 1 WHEN 'WARNING' THEN 2 ELSE 3 END,
                          shortage DESC, ingredient_id""")
def shortage_priority(t):
    """TK5: custom severity order, then shortage."""
    return INV.severity_sorted(INV.ingredient_shortages(_fc(t), _recipe(t), t.ingredients_v))


@register("top_ingredient_consumers", sql=cte(FC) + """
, u AS (SELECT r.ingredient_id, r.product_id, round(greatest(0, round_even(fc.forecast, 0)) * r.quantity_needed, 1) AS use, p.product_name
        FROM fc JOIN recipe_v r USING (product_id) JOIN products_v p ON p.product_id = r.product_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY ingredient_id ORDER BY use DESC, product_id) AS r FROM u)
SELECT ingredient_id, string_agg(format('{} ({:.1f}{})', product_name, use, i.unit), ', ' ORDER BY r) AS top_consumers
FROM rk JOIN ingredients_v i USING (ingredient_id) WHERE r <= 3 GROUP BY ingredient_id""")
def top_ingredient_consumers(t):
    """TK4: top-3 consuming products per ingredient as text with amount and unit."""
    return INV.top_consumers(_fc(t), _recipe(t), t.products_v, t.ingredients_v)


@register("ingredient_usage_text", sql="""
WITH r AS (SELECT r.ingredient_id, p.product_name,
                  row_number() OVER (PARTITION BY r.ingredient_id ORDER BY p.product_name, p.product_id) AS rn
           FROM recipe_v r JOIN products_v p USING (product_id))
SELECT ingredient_id, count(*) AS n_products,
       CASE WHEN count(*) > 3 THEN string_agg(product_name, ', ' ORDER BY rn) FILTER (WHERE rn <= 3)
                                   || ' and ' || CAST(count(*) - 3 AS VARCHAR) || ' others'
            ELSE string_agg(product_name, ', ' ORDER BY rn) FILTER (WHERE rn <= 3) END AS used_in
FROM r GROUP BY ingredient_id""")
def ingredient_usage_text(t):
    """AG47: 'first three products and n others' per ingredient."""
    return INV.used_in(_recipe(t), t.products_v)


LEDGER = """
led AS (SELECT m.*, CAST(p.stock_quantity AS DOUBLE) AS start_stock FROM movements_v m LEFT JOIN products_v p USING (product_id)),
c AS (SELECT *, coalesce(start_stock, 0.0) + sum(delta) OVER (PARTITION BY product_id
        ORDER BY ts, order_id, line_number, supplier_id, delta, amount, flag ROWS UNBOUNDED PRECEDING) AS running_unclamped FROM led),
lv AS (SELECT *, greatest(0.0, running_unclamped - least(0.0, min(running_unclamped) OVER (PARTITION BY product_id
        ORDER BY ts, order_id, line_number, supplier_id, delta, amount, flag ROWS UNBOUNDED PRECEDING))) AS stock_level FROM c)"""


@register("product_stock_ledger", sql=cte(LEDGER) + "SELECT * FROM lv")
def product_stock_ledger(t):
    """WN24: clamped running product stock over every movement (never < 0)."""
    start = t.products_v.select("product_id", F.col("stock_quantity").cast("double").alias("start_stock"))
    return INV.stock_ledger(t.movements_v, start)


def _ledger_summary(df, key):
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("movements"), F.sum("delta").alias("net_change"),
        # final level without picking a "last" row: C_T − min(0, min C)
        F.greatest(F.lit(0.0), F.max(F.coalesce("start_stock", F.lit(0.0))) + F.sum("delta")
                   - F.least(F.lit(0.0), F.min("running_unclamped"))).alias("final_stock"),
        F.min("stock_level").alias("min_level"), F.count_if(F.col("stock_level") <= 1e-6).alias("zero_hits"))


def _ingredient_summary(mv, t):
    start = t.ingredients_v.select("ingredient_id", F.col("current_stock").alias("start_stock"))
    if not start.groupBy("ingredient_id").count().filter("count > 1").isEmpty():     # a movement for each of an ingredient's rows
        return _ledger_summary(INV.stock_ledger(mv, start, "ingredient_id", ING_ORDER), "ingredient_id")
    # the change comes last in the order, and is sorted by anyway
    return keyed_clamped_summary(mv, "ingredient_id", [F.col(c) for c in ING_ORDER[:-1]], F.col("delta").cast("double"), start, "start_stock")


@register("ingredient_stock_after_sales", sql="""WITH
mv AS (SELECT r.ingredient_id, l.order_ts AS ts, l.order_id, l.line_number, l.item_id AS product_id,
              -1.0 * l.quantity * r.quantity_needed AS delta
       FROM valid_lines l JOIN recipe_v r ON r.product_id = l.item_id WHERE l.status = 'paid'),
led AS (SELECT mv.*, i.current_stock AS start_stock FROM mv LEFT JOIN ingredients_v i USING (ingredient_id)),
c AS (SELECT *, coalesce(start_stock, 0.0) + sum(delta) OVER (PARTITION BY ingredient_id
        ORDER BY ts, order_id, line_number, product_id, delta ROWS UNBOUNDED PRECEDING) AS running_unclamped FROM led),
lv AS (SELECT *, greatest(0.0, running_unclamped - least(0.0, min(running_unclamped) OVER (PARTITION BY ingredient_id
        ORDER BY ts, order_id, line_number, product_id, delta ROWS UNBOUNDED PRECEDING))) AS stock_level FROM c)
SELECT ingredient_id, count(*) AS movements, sum(delta) AS net_change,
       greatest(0.0, max(coalesce(start_stock, 0.0)) + sum(delta) - least(0.0, min(running_unclamped))) AS final_stock,
       min(stock_level) AS min_level, count(*) FILTER (WHERE stock_level <= 1e-6) AS zero_hits
FROM lv GROUP BY ingredient_id""")
def ingredient_stock_after_sales(t):
    """DP14 + WN24: ingredient ledger of paid sales (−qty × recipe), floored at 0."""
    paid = t.valid_lines.filter(F.col("status") == "paid")
    mv = INV.ingredient_movements(paid, _recipe(t))
    return _ingredient_summary(mv, t)


@register("product_stock_with_refunds", sql="""
WITH mv AS (SELECT item_id AS product_id, order_ts AS ts, order_id, line_number, -1.0 * quantity AS delta, 'sale' AS reason
            FROM sale_lines WHERE NOT is_voided
            UNION ALL
            SELECT item_id, order_ts, order_id, line_number, 1.0 * quantity, 'refund' FROM sale_lines WHERE is_voided),
led AS (SELECT mv.*, CAST(p.stock_quantity AS DOUBLE) AS start_stock FROM mv LEFT JOIN products_v p USING (product_id)),
c AS (SELECT *, coalesce(start_stock, 0.0) + sum(delta) OVER (PARTITION BY product_id
        ORDER BY ts, order_id, line_number, product_id, delta ROWS UNBOUNDED PRECEDING) AS running_unclamped FROM led),
lv AS (SELECT *, greatest(0.0, running_unclamped - least(0.0, min(running_unclamped) OVER (PARTITION BY product_id
        ORDER BY ts, order_id, line_number, product_id, delta ROWS UNBOUNDED PRECEDING))) AS stock_level FROM c)
SELECT product_id, count(*) AS movements, sum(delta) AS net_change,
       greatest(0.0, max(coalesce(start_stock, 0.0)) + sum(delta) - least(0.0, min(running_unclamped))) AS final_stock,
       min(stock_level) AS min_level, count(*) FILTER (WHERE stock_level <= 1e-6) AS zero_hits
FROM lv GROUP BY product_id""")
def product_stock_with_refunds(t):
    """DP14 sales (−qty) and DP15 refunds (+qty, voided lines) on the product ledger."""
    s = t.sale_lines
    mv = INV.product_movements(s.filter(~F.col("is_voided"))).unionByName(
        INV.product_movements(s.filter(F.col("is_voided")), "refund", 1.0))
    start = t.products_v.select("product_id", F.col("stock_quantity").cast("double").alias("start_stock"))
    led = INV.stock_ledger(mv, start, "product_id", ING_ORDER)
    return _ledger_summary(led, "product_id")


@register("ingredient_stock_with_refunds", sql="""WITH
mv AS (SELECT r.ingredient_id, l.order_ts AS ts, l.order_id, l.line_number, l.item_id AS product_id,
              (CASE WHEN l.is_voided THEN 1.0 ELSE -1.0 END) * l.quantity * r.quantity_needed AS delta
       FROM sale_lines l JOIN recipe_v r ON r.product_id = l.item_id WHERE l.status = 'paid'),
led AS (SELECT mv.*, i.current_stock AS start_stock FROM mv LEFT JOIN ingredients_v i USING (ingredient_id)),
c AS (SELECT *, coalesce(start_stock, 0.0) + sum(delta) OVER (PARTITION BY ingredient_id
        ORDER BY ts, order_id, line_number, product_id, delta ROWS UNBOUNDED PRECEDING) AS running_unclamped FROM led),
lv AS (SELECT *, greatest(0.0, running_unclamped - least(0.0, min(running_unclamped) OVER (PARTITION BY ingredient_id
        ORDER BY ts, order_id, line_number, product_id, delta ROWS UNBOUNDED PRECEDING))) AS stock_level FROM c)
SELECT ingredient_id, count(*) AS movements, sum(delta) AS net_change,
       greatest(0.0, max(coalesce(start_stock, 0.0)) + sum(delta) - least(0.0, min(running_unclamped))) AS final_stock,
       min(stock_level) AS min_level, count(*) FILTER (WHERE stock_level <= 1e-6) AS zero_hits
FROM lv GROUP BY ingredient_id""")
def ingredient_stock_with_refunds(t):
    """DP15: refunded (voided) lines of paid orders put their ingredients back on the ledger."""
    paid = t.sale_lines.filter(has_status("paid")).filter(F.col("is_voided").isNotNull())
    signed = paid.withColumn("quantity", F.when(F.col("is_voided"), F.col("quantity")).otherwise(-F.col("quantity")))
    mv = INV.ingredient_movements(signed, _recipe(t), "sale or refund", 1.0)       # one pass over the lines for both
    return _ingredient_summary(mv, t)


@register("applied_event_transitions", sql="""
WITH RECURSIVE allowed AS (SELECT * FROM (VALUES """ + ", ".join(
    f"('{a}', '{b}')" for a, bs in EVENT_TRANSITIONS.items() for b in bs) + """) v(from_state, to_state)),
r AS (SELECT user_id, ts, event_id, state, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM transitions_v),
w AS (SELECT user_id, ts, event_id, state, n, CAST(NULL AS VARCHAR) AS state_before, true AS accepted, state AS state_after FROM r WHERE n = 1
      UNION ALL
      SELECT r.user_id, r.ts, r.event_id, r.state, r.n, w.state_after, a.to_state IS NOT NULL,
             CASE WHEN a.to_state IS NOT NULL THEN r.state ELSE w.state_after END
      FROM w JOIN r ON r.user_id = w.user_id AND r.n = w.n + 1
      LEFT JOIN allowed a ON a.from_state = w.state_after AND a.to_state = r.state)
SELECT user_id, ts, event_id, state, state_before, accepted, state_after FROM w""")
def applied_event_transitions(t):
    """DP16: each user's requests taken in order; a disallowed one is rejected and leaves the state."""
    log = t.transitions_v.select("user_id", "ts", "event_id", "state")
    return keyed_state_machine(log, "user_id", [F.asc("ts"), F.asc("event_id")], "state", EVENT_TRANSITIONS, None)


@register("invalid_event_transitions", sql="""
WITH allowed AS (SELECT * FROM (VALUES """ + ", ".join(
    f"('{a}', '{b}')" for a, bs in EVENT_TRANSITIONS.items() for b in bs) + """) v(from_state, to_state)),
p AS (SELECT user_id, ts, event_id, state, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_state
      FROM transitions_v)
SELECT p.* FROM p WHERE prev_state IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM allowed a WHERE a.from_state = p.prev_state AND a.to_state = p.state)""")
def invalid_event_transitions(t):
    """DP16: consecutive state pairs per user outside the allowed table."""
    allowed = t.spark.createDataFrame([(a, b) for a, bs in EVENT_TRANSITIONS.items() for b in bs],
                                      "from_state string, to_state string")
    return INV.invalid_transitions(t.transitions_v, allowed).select("user_id", "ts", "event_id", "state", "prev_state")


@register("section_forecast_summary", sql=cte(FC) + """
, pr AS (SELECT fc.product_id, fc.forecast AS predicted FROM fc JOIN products_v p USING (product_id) WHERE p.section = 'Brand#1'),
mx AS (SELECT max(order_date) AS d FROM valid_lines),
rc AS (SELECT item_id AS product_id, sum(quantity) / 4.0 AS recent_mean FROM valid_lines, mx
       WHERE order_date > d - 28 GROUP BY item_id),
g AS (SELECT greatest(0, CAST(round(sum(predicted)) AS BIGINT)) AS predicted_sales_next_week,
             CAST(round(sum(recent_mean)) AS BIGINT) AS recent_avg_demand FROM pr LEFT JOIN rc USING (product_id)),
g2 AS (SELECT *, CASE WHEN recent_avg_demand > 0 THEN round((predicted_sales_next_week - recent_avg_demand) / recent_avg_demand * 100, 1)
                      ELSE 0.0 END AS trend FROM g)
SELECT predicted_sales_next_week, recent_avg_demand, trend,
       CASE WHEN trend > 0 THEN 'up' WHEN trend < 0 THEN 'down' ELSE 'stable' END AS trend_direction,
       w AS week_offset, greatest(1, predicted_sales_next_week) AS predicted_demand,
       CAST(round(greatest(1, predicted_sales_next_week) * 1.2) AS BIGINT) AS confidence_upper,
       greatest(0, CAST(round(greatest(1, predicted_sales_next_week) * 0.8) AS BIGINT)) AS confidence_lower
FROM g2, range(1, 9) r(w)""")
def section_forecast_summary(t):
    """DP40 + SF24 + SF25: one section's next-week forecast, trend versus the
    recent 4-week mean, and an 8-week flat horizon with a ±20 % band."""
    fc = _fc(t).join(t.products_v.select("product_id", "section"), "product_id") \
        .filter(F.col("section") == "Brand#1").select("product_id", F.col("forecast").alias("predicted"))
    v = t.valid_lines
    mx = v.agg(F.max("order_date").alias("_d"))
    recent = (v.crossJoin(F.broadcast(mx)).filter(F.col("order_date") > F.date_sub("_d", 28))
              .groupBy(F.col("item_id").alias("product_id")).agg((F.sum("quantity") / 4.0).alias("recent_mean")))
    return INV.item_forecast(fc, recent, "product_id", 8)
