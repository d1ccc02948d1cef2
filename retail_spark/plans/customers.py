"""Order-level and customer-level features, RFM scores and segments
(AG7, AG8, AG14, AG16–AG19, AG37, AG38, AG40, AG43, AG44, WN12, WN13, WN15,
WN16, SF5, SF18–SF20, DP27–DP30).

Data flow: lines → one row per order (groupBy order) → one row per customer
(groupBy customer) → segment rules.  Each step is a partial-aggregating
groupBy, so a customer holding a third of all orders is pre-reduced on the
map side before the shuffle.  Quintile scores need a global order over all
customers; they use the distributed row number of ``operators.ordered``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retail_spark.functions import exprs as X
from retail_spark.operators.ordered import exact_quantiles, global_row_number, global_running_sum
from retail_spark.operators.windows import preferred
from retail_spark.session import cut_lineage

SECONDS_PER_DAY = 86400

# Actions and audiences of the reference rules.
ACTIONS = {
    "vip": "VIP loyalty program and premium personalization",
    "winback": "Win-back campaign for valuable customers",
    "promo": "Targeted promotions and coupon campaigns",
    "reactivate": "Reactivation campaign based on visit gap",
    "bundle": "Bundle and cross-sell offers",
    "lowcost": "Low-cost engagement campaign",
    "standard": "Standard personalized communication",
    "nurture": "Standard nurturing and personalized recommendations",
}
CHURN_SEGMENTS = ("At Risk", "Lost / Hibernating", "Cannot Lose Them")


def order_level(lines: DataFrame) -> DataFrame:
    """One row per order (AG7): totals, basket size, discount, time of day."""
    ts = F.col("order_ts")
    per_order = (lines.groupBy("order_id", "customer_id", "order_ts", "payment_method")
                 .agg(F.sum("line_total").alias("order_total"),
                      F.avg("price").alias("order_avg_item_price"),
                      F.avg(F.col("discount_rate") * 100).alias("order_discount_pct_mean"),
                      F.count(F.lit(1)).alias("n_lines"),
                      F.countDistinct("item_id").alias("n_unique_items")))
    return per_order.select(
        "*", F.hour(ts).alias("order_hour"), F.date_format(ts, "EEEE").alias("day_of_week"),
        X.weekday0(ts).alias("day_of_week_num"), (X.weekday0(ts) >= 5).cast("int").alias("is_weekend"),
        X.meal_period(F.hour(ts), "segmentation").alias("meal_period"),
        (F.col("order_discount_pct_mean") > 0).cast("int").alias("has_discount"),
        F.col("n_lines").alias("basket_size"))


def rfm_base(orders: DataFrame) -> DataFrame:
    """Recency (whole days to the last order day + 1), frequency, monetary,
    tenure, spend per order (AG8)."""
    ref = orders.agg((F.max("order_ts") + F.expr("INTERVAL 1 DAY")).alias("_ref"))
    g = (orders.groupBy("customer_id")
         .agg(F.max("order_ts").alias("last_order_date"), F.min("order_ts").alias("first_order_date"),
              F.countDistinct("order_id").alias("frequency"), F.sum("order_total").alias("monetary")))
    days = lambda a, b: F.floor(F.timestamp_diff("SECOND", a, b) / SECONDS_PER_DAY)
    return (g.crossJoin(F.broadcast(ref))   # one-row reference date
            .select("customer_id", "last_order_date", "first_order_date", "frequency", "monetary",
                    days(F.col("last_order_date"), F.col("_ref")).cast("bigint").alias("recency"),
                    F.greatest(F.lit(0), days(F.col("first_order_date"), F.col("last_order_date")))
                    .cast("bigint").alias("customer_tenure_days"),
                    X.safe_div("monetary", "frequency").alias("monetary_per_order")))


def quintile(df: DataFrame, value: str, key: str, name: str, reverse: bool = False) -> DataFrame:
    """pandas ``qcut(rank(method='first'), 5)`` score 1..5 (WN13).

    Rank k of n (ties by ``key``) scores ``max(1, ceil((k−1)·5/(n−1)))``;
    ``reverse`` ranks the largest value first.  Fewer than 5 rows → all 3.
    """
    order = [F.desc(value) if reverse else F.asc(value), F.asc(key)]
    # a range sort on (value, key): customers who share a value spread over several ranges
    ranked = global_row_number(df, order, "_k")
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    score = F.when(F.col("_n") < 5, F.lit(3)).otherwise(
        F.greatest(F.lit(1), F.ceil((F.col("_k") - 1) * 5.0 / (F.col("_n") - 1))))
    return (ranked.crossJoin(F.broadcast(n)).withColumn(name, score.cast("int")).drop("_k", "_n"))


def rfm_scores(rfm: DataFrame) -> DataFrame:
    """R (reversed recency), F and M quintiles, code, score, segment, tier
    (WN13, SF5, SF19, SF20)."""
    rfm = cut_lineage(rfm)   # one row per customer, read by all three rankings
    s = quintile(rfm, "recency", "customer_id", "R_score", reverse=True)
    s = quintile(s, "frequency", "customer_id", "F_score")
    s = quintile(s, "monetary", "customer_id", "M_score")
    score = F.col("R_score") + F.col("F_score") + F.col("M_score")
    return (s.withColumn("rfm_score", score)
            .withColumn("rfm_code", F.concat(F.col("R_score").cast("string"), F.col("F_score").cast("string"),
                                             F.col("M_score").cast("string")))
            .withColumn("rfm_segment", X.rfm_segment("R_score", "F_score", "M_score", "rfm_score"))
            .withColumn("rfm_value_tier", X.value_tier("rfm_score")))


def customer_features(orders: DataFrame, rfm: DataFrame, profile: DataFrame) -> DataFrame:
    """RFM plus basket, discount, time and preference features, profile merged,
    missing values filled (AG17, WN15, JN5, PRJ3)."""
    g = orders.groupBy("customer_id").agg(
        F.avg("order_total").alias("avg_order_value"), F.avg("basket_size").alias("avg_basket_size"),
        F.avg("order_avg_item_price").alias("avg_item_price"),
        F.avg("order_discount_pct_mean").alias("avg_discount_pct"),
        F.avg("has_discount").alias("discount_order_rate"),
        F.avg("order_hour").alias("avg_order_hour"), F.avg("is_weekend").alias("weekend_order_rate"))
    pay = preferred(orders, "customer_id", "payment_method", name="preferred_payment_method")
    meal = preferred(orders, "customer_id", "meal_period", name="dominant_meal_period")
    out = (rfm.join(g, "customer_id", "left").join(pay, "customer_id", "left")
           .join(meal, "customer_id", "left")
           .join(profile.select("customer_id", "archetype", "price_tier"), "customer_id", "left"))
    zero = ["avg_order_value", "avg_basket_size", "avg_item_price", "avg_discount_pct",
            "discount_order_rate", "weekend_order_rate", "avg_order_hour"]
    cats = ["preferred_payment_method", "dominant_meal_period", "archetype", "price_tier"]
    return out.fillna(0.0, subset=zero).fillna("unknown", subset=cats)


PROFILE_AGGS = {
    "customers": lambda: F.count(F.lit(1)),
    "total_revenue": lambda: F.sum("monetary"),
    "avg_monetary": lambda: F.avg("monetary"),
    "avg_frequency": lambda: F.avg("frequency"),
    "avg_recency": lambda: F.avg("recency"),
    "avg_order_value": lambda: F.avg("avg_order_value"),
    "avg_basket_size": lambda: F.avg("avg_basket_size"),
    "avg_discount_pct": lambda: F.avg("avg_discount_pct"),
    "weekend_order_rate": lambda: F.avg("weekend_order_rate"),
}


def segment_profile(features: DataFrame, seg: str, measures=None) -> DataFrame:
    """Per-segment count, revenue and means (AG18)."""
    measures = measures or list(PROFILE_AGGS)
    return features.groupBy(seg).agg(*[PROFILE_AGGS[m]().alias(m) for m in measures])


def name_clusters(profiles: DataFrame, seg: str, name: str = "segment_name") -> DataFrame:
    """Value + activity + style name from 30/70 % quantiles over the profile
    rows (DP27).  One profile row → 'General Cluster'."""
    q = profiles.agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile("avg_monetary", 0.7).alias("_m70"), F.percentile("avg_monetary", 0.3).alias("_m30"),
        F.percentile("avg_frequency", 0.7).alias("_f70"), F.percentile("avg_recency", 0.7).alias("_r70"),
        F.percentile("avg_discount_pct", 0.7).alias("_d70"), F.percentile("avg_basket_size", 0.7).alias("_b70"),
        F.percentile("weekend_order_rate", 0.7).alias("_w70"))
    c = F.col
    value = (F.when(c("avg_monetary") >= c("_m70"), "High-Value")
             .when(c("avg_monetary") <= c("_m30"), "Low-Value").otherwise("Mid-Value"))
    activity = (F.when(c("avg_frequency") >= c("_f70"), "Frequent")
                .when(c("avg_recency") >= c("_r70"), "Inactive").otherwise("Occasional"))
    style = (F.when(c("avg_discount_pct") >= c("_d70"), "Discount-Sensitive")
             .when(c("avg_basket_size") >= c("_b70"), "Large-Basket")
             .when(c("weekend_order_rate") >= c("_w70"), "Weekend-Oriented").otherwise("Standard"))
    label = F.when(c("_n") < 2, "General Cluster").otherwise(F.concat_ws(" ", value, activity, style))
    return (profiles.crossJoin(F.broadcast(q))    # one row of quantiles
            .withColumn(name, label).drop(*[x for x in q.columns]))


def hybrid_segments(features: DataFrame, names: DataFrame, seg: str, name: str = "segment_name") -> DataFrame:
    """Attach segment names and the hybrid 'tier | name' label (SF5)."""
    return (features.join(names.select(seg, name), seg, "left")
            .withColumn("hybrid_segment", F.concat_ws(" | ", "rfm_value_tier", name)))


def recommend_actions(features: DataFrame) -> DataFrame:
    """Hybrid segment profiles with the service's recommended action (DP28):
    thresholds are the customer-level median recency and q75 basket size."""
    prof = (features.groupBy("hybrid_segment")
            .agg(*[PROFILE_AGGS[m]().alias(m) for m in
                   ["customers", "total_revenue", "avg_monetary", "avg_frequency", "avg_recency",
                    "avg_order_value", "avg_basket_size", "avg_discount_pct"]]))
    th = exact_quantiles(features, {"_med_rec": ("recency", 0.5), "_q75_basket": ("avg_basket_size", 0.75)})
    s = F.lower("hybrid_segment")
    c = F.col
    action = (F.when(s.contains("high-value") & (c("avg_recency") <= c("_med_rec")), ACTIONS["vip"])
              .when(s.contains("high-value") & (c("avg_recency") > c("_med_rec")), ACTIONS["winback"])
              .when(s.contains("discount"), ACTIONS["promo"])
              .when(c("avg_basket_size") > c("_q75_basket"), ACTIONS["bundle"])
              .when(s.contains("low-value"), ACTIONS["lowcost"])
              .otherwise(ACTIONS["standard"]))
    return prof.crossJoin(F.broadcast(th)).withColumn("recommended_action", action).drop("_med_rec", "_q75_basket")


def recommend_actions_with_gap(features: DataFrame) -> DataFrame:
    """The modelling variant of the action rules (DP28): as ``recommend_actions``
    with a reactivation rule on the mean visit gap before the bundle rule."""
    f = cut_lineage(features.withColumn("visit_gap", expected_visits() - F.col("frequency")))
    prof = f.groupBy("hybrid_segment").agg(F.count(F.lit(1)).alias("customers"), F.avg("recency").alias("avg_recency"),
                                           F.avg("visit_gap").alias("avg_visit_gap"), F.avg("avg_basket_size").alias("avg_basket_size"))
    th = exact_quantiles(f, {"_med_rec": ("recency", 0.5), "_q75_gap": ("visit_gap", 0.75), "_q75_basket": ("avg_basket_size", 0.75)})
    s, c = F.lower("hybrid_segment"), F.col
    action = (F.when(s.contains("high-value") & (c("avg_recency") <= c("_med_rec")), ACTIONS["vip"])
              .when(s.contains("high-value") & (c("avg_recency") > c("_med_rec")), ACTIONS["winback"])
              .when(s.contains("discount"), ACTIONS["promo"])
              .when(c("avg_visit_gap") > c("_q75_gap"), ACTIONS["reactivate"])
              .when(c("avg_basket_size") > c("_q75_basket"), ACTIONS["bundle"])
              .when(s.contains("low-value"), ACTIONS["lowcost"])
              .otherwise(ACTIONS["standard"]))
    return prof.crossJoin(F.broadcast(th)).withColumn("recommended_action", action).drop("_med_rec", "_q75_gap", "_q75_basket")


def overview_actions(features: DataFrame) -> DataFrame:
    """The overview variant of the action rules (DP28): thresholds are 70 % quantiles
    and the median over the segment profiles themselves."""
    f = features.withColumn("visit_gap", expected_visits() - F.col("frequency"))
    prof = cut_lineage(f.groupBy("hybrid_segment").agg(
        F.count(F.lit(1)).alias("customers"), F.avg("recency").alias("avg_recency"), F.avg("frequency").alias("avg_frequency"),
        F.avg("monetary").alias("avg_monetary"), F.avg("avg_discount_pct").alias("avg_discount_pct"), F.avg("visit_gap").alias("avg_visit_gap")))
    th = prof.agg(F.percentile("avg_frequency", 0.7).alias("_f"), F.percentile("avg_recency", 0.7).alias("_r"), F.median("avg_monetary").alias("_m"),
                  F.percentile("avg_discount_pct", 0.7).alias("_d"), F.percentile("avg_visit_gap", 0.7).alias("_g"))     # one row per segment
    s, c = F.col("hybrid_segment"), F.col
    action = (F.when(s.startswith("High-Value") & (s.contains("Frequent") | (c("avg_frequency") >= c("_f"))), ACTIONS["vip"])
              .when(s.contains("High-Value Inactive") | ((c("avg_recency") >= c("_r")) & (c("avg_monetary") >= c("_m"))), ACTIONS["winback"])
              .when(s.contains("Discount") | (c("avg_discount_pct") >= c("_d")), ACTIONS["promo"])
              .when((c("avg_visit_gap") >= c("_g")) | s.contains("Inactive"), ACTIONS["reactivate"])
              .otherwise(ACTIONS["nurture"]))
    return prof.crossJoin(F.broadcast(th)).withColumn("recommended_action", action).drop("_f", "_r", "_m", "_d", "_g")


def basket_features(orders: DataFrame) -> DataFrame:
    """Mean, median and largest order value, basket and discount measures per customer (AG17)."""
    g = orders.groupBy("customer_id").agg(
        F.countDistinct("order_id").alias("total_orders"), F.avg("order_total").alias("avg_order_value"), F.max("order_total").alias("max_order_value"),
        F.avg("basket_size").alias("avg_basket_size"), F.avg("n_unique_items").alias("avg_unique_items_per_order"),
        F.sum(F.col("order_total") * F.col("order_discount_pct_mean") / 100).alias("total_discount_amount_est"))
    q = exact_quantiles(orders, {"median_order_value": ("order_total", 0.5), "median_basket_size": ("basket_size", 0.5)}, ["customer_id"])
    return g.join(q, "customer_id")


def scaled_profile(profiles: DataFrame, seg: str, cols: list[str]) -> DataFrame:
    """(x − mean) / population std across profile rows (DP29)."""
    st = profiles.agg(*[F.avg(x).alias(f"_m_{x}") for x in cols],
                      *[F.stddev_pop(x).alias(f"_s_{x}") for x in cols])
    out = profiles.crossJoin(F.broadcast(st))
    return out.select(seg, *[X.safe_div(F.col(x) - F.col(f"_m_{x}"), f"_s_{x}").alias(f"z_{x}") for x in cols])


def diversity(lines: DataFrame) -> DataFrame:
    """Distinct items, categories and sections per customer (AG16)."""
    return lines.groupBy("customer_id").agg(
        F.countDistinct("item_id").alias("n_unique_items"),
        F.countDistinct("category").alias("n_unique_categories"),
        F.countDistinct("section").alias("n_unique_sections"))


def dominant(lines: DataFrame, c: str, name: str) -> DataFrame:
    """Value of ``c`` with the highest spend per customer; ties alphabetical (WN16)."""
    return preferred(lines, "customer_id", c, weight=F.col("line_total"), name=name)


def pareto(customers: DataFrame, value: str = "monetary", key: str = "customer_id") -> DataFrame:
    """Cumulative revenue share in descending spend order with rank (WN12)."""
    tot = customers.agg(F.sum(value).alias("_tot"))
    run = global_running_sum(customers.select(key, value), [F.desc(value), F.asc(key)],
                             {"cum_value": F.col(value)}, row_number="spend_rank")
    return (run.crossJoin(F.broadcast(tot))
            .withColumn("cum_share", F.col("cum_value") / F.col("_tot")).drop("_tot"))


def segment_kpis(features: DataFrame) -> DataFrame:
    """Executive KPI row (AG40): customers, revenue, mean spend / frequency /
    recency, high- and low-value counts."""
    return features.agg(
        F.count(F.lit(1)).alias("customers"), F.sum("monetary").alias("total_revenue"),
        F.avg("monetary").alias("avg_spend"), F.avg("frequency").alias("avg_frequency"),
        F.avg("recency").alias("avg_recency"),
        F.count_if(F.col("rfm_value_tier") == "High-Value").alias("high_value_customers"),
        F.count_if(F.col("rfm_value_tier") == "Low-Value").alias("low_value_customers"))


def expected_visits() -> Column:
    """One visit for each started 30 days of tenure, plus the first (stands for the profile's expectation)."""
    return F.ceil(F.col("customer_tenure_days") / 30.0) + 1


def target_audiences(features: DataFrame) -> DataFrame:
    """(customer_id, monetary, target_group) of the six audiences (AG38, SNK4); a customer may be in several."""
    c = F.col
    f = cut_lineage(features.withColumn("visit_gap", expected_visits() - c("frequency")))
    q = exact_quantiles(f, {"_m75": ("monetary", 0.75), "_f75": ("frequency", 0.75), "_r75": ("recency", 0.75),
                            "_m50": ("monetary", 0.5), "_d75": ("avg_discount_pct", 0.75), "_b75": ("avg_basket_size", 0.75),
                            "_w75": ("weekend_order_rate", 0.75), "_g75": ("visit_gap", 0.75)})
    f = f.crossJoin(F.broadcast(q))       # one row
    flags = {
        "VIP": (c("rfm_value_tier") == "High-Value") | ((c("monetary") >= c("_m75")) & (c("frequency") >= c("_f75"))),
        "Churn Risk": c("rfm_segment").isin(*CHURN_SEGMENTS) | ((c("recency") >= c("_r75")) & (c("visit_gap") >= c("_g75"))),
        "Win-Back": (c("recency") >= c("_r75")) & (c("monetary") >= c("_m50")),
        "Discount-Sensitive": (c("avg_discount_pct") >= c("_d75")) | c("segment_name").contains("Discount"),
        "Large Basket": c("avg_basket_size") >= c("_b75"),
        "Weekend": c("weekend_order_rate") >= c("_w75"),
    }
    arr = F.array(*[F.when(cond, F.lit(k)) for k, cond in flags.items()])
    return f.select("customer_id", "monetary", F.explode(F.array_compact(arr)).alias("target_group"))


def targeting_summary(features: DataFrame) -> DataFrame:
    """Size, revenue and revenue per head of the six target audiences (AG38)."""
    return (target_audiences(features).groupBy("target_group")
            .agg(F.count(F.lit(1)).alias("customers"), F.sum("monetary").alias("revenue"))
            .withColumn("revenue_per_customer", F.col("revenue") / F.col("customers")))


def action_summary(profiles_with_action: DataFrame) -> DataFrame:
    """Segments, customers and revenue by recommended action (AG37)."""
    return (profiles_with_action.groupBy("recommended_action")
            .agg(F.count(F.lit(1)).alias("segments"), F.sum("customers").alias("customers"),
                 F.sum("total_revenue").alias("revenue")))


def fill_missing(f: DataFrame) -> DataFrame:
    """Customers without orders (PRJ3): nothing bought, a recency above the highest, the median price, the lowest scores."""
    f = cut_lineage(f)
    known = f.agg((F.max("recency") + 30).alias("_late")).crossJoin(exact_quantiles(f, {"_price": ("avg_item_price", 0.5)}))      # one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return f.crossJoin(F.broadcast(known)).select(
        "customer_id", zero("frequency"), F.coalesce("monetary", F.lit(0.0)).alias("monetary"), F.coalesce("recency", "_late").alias("recency"),
        F.coalesce("avg_item_price", "_price").alias("avg_item_price"), *[F.coalesce(F.col(c), F.lit(1)).alias(c) for c in ("r_score", "f_score", "m_score")],
        F.coalesce("rfm_code", F.lit("111")).alias("rfm_code"), F.coalesce("preferred_payment_method", F.lit("unknown")).alias("preferred_payment_method"))


def rfm_by_profile(features: DataFrame, by: str) -> DataFrame:
    """RFM means and basket by a profile attribute (AG44)."""
    return features.groupBy(by).agg(
        F.count(F.lit(1)).alias("customers"), F.avg("recency").alias("avg_recency"),
        F.avg("frequency").alias("avg_frequency"), F.avg("monetary").alias("avg_monetary"),
        F.avg("avg_basket_size").alias("avg_basket_size"))


def segment_lookup(features: DataFrame, customer_id: int) -> DataFrame:
    """One customer's segment row with the size of their segment (DP30)."""
    sizes = features.groupBy("rfm_segment").agg(F.count(F.lit(1)).alias("segment_customers"))
    return (features.filter(F.col("customer_id") == customer_id)
            .join(sizes, "rfm_segment")
            .select("customer_id", "rfm_segment", "rfm_value_tier", "rfm_code", "recency", "frequency",
                    "monetary", "segment_customers"))
