"""Inventory: forecast-driven stock status, recipe explosion, ingredient
shortages, clamped stock ledgers, sales / refund movements, order state
transitions and the per-item forecast summary (JN13, SF22–SF25, DP14–DP16,
DP40, WN24, TK4, TK5, AG47).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retail_spark.functions import exprs as X
from retail_spark.operators.ordered import global_row_number, keyed_clamped_running
from retail_spark.operators.relational import ingredient_need


def weekly_forecast(lines: DataFrame, key: str = "item_id") -> DataFrame:
    """Mean weekly quantity per product over the whole sales calendar (the
    fixture's stand-in forecast): Σ quantity ÷ (days spanned / 7)."""
    span = lines.agg(((F.datediff(F.max("order_date"), F.min("order_date")) + 1) / 7.0).alias("_weeks"))
    q = lines.groupBy(F.col(key).alias("product_id")).agg(F.sum("quantity").alias("_q"),
                                                          F.avg("price").alias("avg_price"))
    return (q.crossJoin(F.broadcast(span))
            .select("product_id", "avg_price", (F.col("_q") / F.col("_weeks")).alias("forecast")))


def stock_status(forecast: DataFrame, products: DataFrame) -> DataFrame:
    """Understocked / Overstocked / Optimal, shortage, predicted revenue (SF22)."""
    j = forecast.join(products.select("product_id", "product_name", "stock_quantity"), "product_id", "left")
    stock = F.coalesce(F.col("stock_quantity"), F.lit(0)).cast("double")
    return j.select("product_id", "product_name", "forecast", stock.alias("current_stock"),
                    X.stock_status(stock, F.col("forecast")).alias("stock_status"),
                    F.when(stock < F.col("forecast"), F.col("forecast") - stock).otherwise(0.0).alias("shortage"),
                    (F.col("forecast") * F.col("avg_price")).alias("predicted_revenue"))


def ingredient_shortages(forecast: DataFrame, recipe: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Recipe explosion (JN13) with need and shortage rounded to 0.1, status and
    cost impact rounded to 0.01 (SF23)."""
    need = ingredient_need(forecast, recipe, ingredients)
    n = F.round("need", 1)
    short = F.greatest(F.lit(0.0), F.round(n - F.col("current_stock"), 1))
    return need.select("ingredient_id", "ingredient_name", "unit", "current_stock", "cost_per_unit",
                       n.alias("need"), short.alias("shortage"),
                       X.shortage_status(n, F.col("current_stock")).alias("status"),
                       F.round(short * F.col("cost_per_unit"), 2).alias("cost_impact"))


def severity_sorted(shortages: DataFrame) -> DataFrame:
    """CRITICAL < LOW < WARNING < OK, then shortage descending (TK5)."""
    return shortages.orderBy(X.severity_rank("status"), F.desc("shortage"), F.asc("ingredient_id"))


def _first_k(df: DataFrame, key: str, order: dict[str, bool], k: int, salts: int = 32) -> DataFrame:
    """The first k rows of each key in ``order`` (column → descending): k of each of ``salts`` parts of a key, then k of those."""
    by = [F.desc(c) if down else F.asc(c) for c, down in order.items()]
    part = F.pmod(F.xxhash64(*order), F.lit(salts))
    some = df.withColumn("_s", part).withColumn("_r", F.row_number().over(Window.partitionBy(key, "_s").orderBy(*by))).filter(F.col("_r") <= k)
    return some.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*by))).filter(F.col("_r") <= k).drop("_s")


def top_consumers(forecast: DataFrame, recipe: DataFrame, products: DataFrame, ingredients: DataFrame, k: int = 3) -> DataFrame:
    """Top-k products by forecast use of each ingredient, as text with amount and unit (TK4)."""
    use = (forecast.join(recipe, "product_id")
           .select("ingredient_id", "product_id", F.round(F.greatest(F.lit(0.0), F.rint("forecast")) * F.col("quantity_needed"), 1).alias("use"))
           .join(products.select("product_id", "product_name"), "product_id"))
    top = _first_k(use, "ingredient_id", {"use": True, "product_id": False}, k).join(ingredients.select("ingredient_id", "unit"), "ingredient_id")
    text = F.format_string("%s (%.1f%s)", "product_name", "use", "unit")
    return top.groupBy("ingredient_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", text.alias("t")))), lambda s: s["t"]), ", ").alias("top_consumers"))


def used_in(recipe: DataFrame, products: DataFrame, k: int = 3) -> DataFrame:
    """'a, b, c and n others' usage text per ingredient (AG47)."""
    r = recipe.join(products.select("product_id", "product_name"), "product_id")
    first = _first_k(r, "ingredient_id", {"product_name": False, "product_id": False}, k)
    g = (r.groupBy("ingredient_id").agg(F.count(F.lit(1)).alias("n_products"))
         .join(first.groupBy("ingredient_id").agg(F.sort_array(F.collect_list(F.struct("_r", "product_name"))).alias("_first")), "ingredient_id"))
    names = F.array_join(F.transform("_first", lambda s: s["product_name"]), ", ")
    return g.select("ingredient_id", "n_products",
                    F.when(F.col("n_products") > k,
                           F.concat(names, F.lit(" and "), (F.col("n_products") - k).cast("string"), F.lit(" others")))
                    .otherwise(names).alias("used_in"))


def stock_ledger(moves: DataFrame, start: DataFrame, key: str = "product_id",
                 order=("ts", "order_id", "line_number", "supplier_id", "delta", "amount", "flag")) -> DataFrame:
    """Clamped running stock per product from signed movements (WN24)."""
    m = moves.join(start, key, "left")
    return keyed_clamped_running(m, key, [F.asc(c) for c in order], F.col("delta").cast("double"),
                                 F.coalesce(F.col("start_stock"), F.lit(0.0)).cast("double"), "stock_level")


def ingredient_movements(lines: DataFrame, recipe: DataFrame, reason: str = "sale", sign: float = -1.0) -> DataFrame:
    """Ingredient ledger rows for sold (or refunded) lines: ±quantity ×
    quantity needed per recipe line (DP14, DP15)."""
    r = recipe.withColumnRenamed("product_id", "item_id")
    return (lines.join(r, "item_id")
            .select(F.col("ingredient_id"), F.col("order_ts").alias("ts"), "order_id", "line_number",
                    F.col("item_id").alias("product_id"),
                    (F.lit(sign) * F.col("quantity") * F.col("quantity_needed")).alias("delta"),
                    F.lit(reason).alias("reason")))


def product_movements(lines: DataFrame, reason: str = "sale", sign: float = -1.0) -> DataFrame:
    """Product ledger rows: ±quantity per line (DP14, DP15)."""
    return lines.select(F.col("item_id").alias("product_id"), F.col("order_ts").alias("ts"), "order_id",
                        "line_number", (F.lit(sign) * F.col("quantity")).alias("delta"), F.lit(reason).alias("reason"))


def invalid_transitions(log: DataFrame, allowed: DataFrame, key: str = "user_id",
                        order=("ts", "event_id"), state: str = "state") -> DataFrame:
    """Consecutive state pairs per key that the allowed-pairs table does not
    contain (DP16).  ``allowed`` is a small rule table: broadcast."""
    # neighbours by position in a range sort on (key, order): a busy key spreads over many ranges
    ranked = global_row_number(log, [F.asc(key), *[F.asc(c) for c in order]], "_rn")
    before = ranked.select((F.col("_rn") + 1).alias("_rn"), F.col(key).alias("_key"), F.col(state).alias("prev_state"))
    pairs = (ranked.join(before, "_rn").filter((F.col(key) == F.col("_key")) & F.col("prev_state").isNotNull())
             .drop("_rn", "_key"))
    ok = allowed.select(F.col("from_state").alias("prev_state"), F.col("to_state").alias(state))
    return pairs.join(F.broadcast(ok), ["prev_state", state], "left_anti")


def item_forecast(pred: DataFrame, recent: DataFrame, key: str, weeks: int = 8) -> DataFrame:
    """Forecast summary for one item / section / all (DP40): predicted sum
    (rounded, ≥ 0), recent 4-week mean, trend % and direction (SF24), and a
    flat horizon with a ±20 % band (SF25)."""
    j = pred.join(recent, key, "left")
    g = j.agg(F.greatest(F.lit(0), F.round(F.sum("predicted")).cast("bigint")).alias("predicted_sales_next_week"),
              F.round(F.sum("recent_mean")).cast("bigint").alias("recent_avg_demand"))
    t = X.trend_pct("predicted_sales_next_week", "recent_avg_demand")
    g = g.withColumn("trend", t).withColumn("trend_direction", X.trend_direction(t))
    h = g.select("*", F.explode(F.sequence(F.lit(1), F.lit(weeks))).alias("week_offset"))
    base = F.greatest(F.lit(1), F.col("predicted_sales_next_week"))
    return h.select("predicted_sales_next_week", "recent_avg_demand", "trend", "trend_direction", "week_offset",
                    base.alias("predicted_demand"),
                    F.round(base * 1.2).cast("bigint").alias("confidence_upper"),
                    F.greatest(F.lit(0), F.round(base * 0.8).cast("bigint")).alias("confidence_lower"))
