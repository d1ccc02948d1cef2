"""Customer features, RFM and segment queries (AG7–AG8, AG14, AG16–AG19,
AG37–AG38, AG40, AG43–AG44, WN12–WN13, WN15–WN16, SF5, SF18–SF20, DP27–DP30)."""

from __future__ import annotations

from pyspark.sql import functions as F

from retail_spark.catalog import register
from retail_spark.functions import exprs as X
from retail_spark.operators import relational as O
from retail_spark.plans import customers as C
from retail_spark.session import cut_lineage

CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def features(t):
    # one row per order, read by RFM, basket, preference and profile steps:
    # written once to the shared checkpoint folder instead of recomputed
    orders = cut_lineage(C.order_level(t.valid_lines))
    scores = C.rfm_scores(C.rfm_base(orders))
    return orders, C.customer_features(orders, scores, t.customers_v)


def named_features(t):
    """Features with archetype-group names (DP27 applied to archetype groups)."""
    _, f = features(t)
    names = C.name_clusters(C.segment_profile(f, "archetype"), "archetype")
    return C.hybrid_segments(f, names, "archetype")


# ---------------------------------------------------------------------------
# SQL twins (DuckDB), built up as named CTE blocks.

MEAL_SQL = """CASE WHEN hour(order_ts) >= 6 AND hour(order_ts) < 11 THEN 'morning'
            WHEN hour(order_ts) >= 11 AND hour(order_ts) < 16 THEN 'lunch'
            WHEN hour(order_ts) >= 16 AND hour(order_ts) < 23 THEN 'dinner' ELSE 'late_night' END"""

ORDER_LEVEL = f"""
order_level AS (
  SELECT order_id, customer_id, order_ts, payment_method,
         sum(line_total) AS order_total, avg(price) AS order_avg_item_price,
         avg(discount_rate * 100) AS order_discount_pct_mean, count(*) AS n_lines,
         count(DISTINCT item_id) AS n_unique_items, hour(order_ts) AS order_hour,
         dayname(order_ts) AS day_of_week, isodow(order_ts) - 1 AS day_of_week_num,
         CASE WHEN isodow(order_ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
         {MEAL_SQL} AS meal_period,
         CASE WHEN avg(discount_rate * 100) > 0 THEN 1 ELSE 0 END AS has_discount,
         count(*) AS basket_size
  FROM valid_lines GROUP BY order_id, customer_id, order_ts, payment_method)"""

RFM = """
rfm AS (
  SELECT customer_id, max(order_ts) AS last_order_date, min(order_ts) AS first_order_date,
         count(DISTINCT order_id) AS frequency, sum(order_total) AS monetary,
         CAST(floor(date_diff('second', max(order_ts), (SELECT max(order_ts) + INTERVAL 1 DAY FROM order_level)) / 86400) AS BIGINT) AS recency,
         CAST(greatest(0, floor(date_diff('second', min(order_ts), max(order_ts)) / 86400)) AS BIGINT) AS customer_tenure_days,
         sum(order_total) / nullif(count(DISTINCT order_id), 0) AS monetary_per_order
  FROM order_level GROUP BY customer_id)"""


def _q(k):
    return f"CAST(CASE WHEN n < 5 THEN 3 ELSE greatest(1, ceil(({k} - 1) * 5.0 / (n - 1))) END AS INTEGER)"


SCORES = f"""
ranked AS (
  SELECT *, row_number() OVER (ORDER BY recency DESC, customer_id) AS kr,
         row_number() OVER (ORDER BY frequency, customer_id) AS kf,
         row_number() OVER (ORDER BY monetary, customer_id) AS km, count(*) OVER () AS n
  FROM rfm),
s3 AS (SELECT * EXCLUDE (kr, kf, km, n), {_q('kr')} AS R_score, {_q('kf')} AS F_score,
              {_q('km')} AS M_score FROM ranked),
scores AS (
  SELECT *, R_score + F_score + M_score AS rfm_score,
         CAST(R_score AS VARCHAR) || CAST(F_score AS VARCHAR) || CAST(M_score AS VARCHAR) AS rfm_code,
         CASE WHEN R_score + F_score + M_score = 0 THEN 'No Transaction History'
              WHEN R_score >= 4 AND F_score >= 4 AND M_score >= 4 THEN 'Champions'
              WHEN R_score >= 3 AND F_score >= 4 THEN 'Loyal Customers'
              WHEN R_score >= 4 AND F_score <= 2 THEN 'New / Promising'
              WHEN R_score >= 3 AND F_score >= 2 AND M_score >= 3 THEN 'Potential Loyalists'
              WHEN R_score = 3 AND F_score <= 2 THEN 'Need Attention'
              WHEN R_score = 2 AND F_score >= 3 THEN 'At Risk'
              WHEN R_score <= 2 AND F_score >= 4 AND M_score >= 4 THEN 'Cannot Lose Them'
              WHEN R_score <= 2 AND F_score <= 2 AND M_score <= 2 THEN 'Lost / Hibernating'
              ELSE 'Others' END AS rfm_segment,
         CASE WHEN R_score + F_score + M_score >= 12 THEN 'High-Value'
              WHEN R_score + F_score + M_score >= 8 THEN 'Mid-Value'
              WHEN R_score + F_score + M_score > 0 THEN 'Low-Value' ELSE 'No-History' END AS rfm_value_tier
  FROM s3)"""


def _pref(col, name):
    return f"""
{name} AS (SELECT customer_id, {col} AS {name} FROM (
  SELECT customer_id, {col}, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, {col}) AS rn
  FROM order_level WHERE {col} IS NOT NULL GROUP BY customer_id, {col}) WHERE rn = 1)"""


FEATURES = f"""
g AS (SELECT customer_id, avg(order_total) AS avg_order_value, avg(basket_size) AS avg_basket_size,
             avg(order_avg_item_price) AS avg_item_price, avg(order_discount_pct_mean) AS avg_discount_pct,
             avg(has_discount) AS discount_order_rate, avg(order_hour) AS avg_order_hour,
             avg(is_weekend) AS weekend_order_rate
      FROM order_level GROUP BY customer_id),
{_pref('payment_method', 'preferred_payment_method')},
{_pref('meal_period', 'dominant_meal_period')},
features AS (
  SELECT s.*, coalesce(g.avg_order_value, 0.0) AS avg_order_value,
         coalesce(g.avg_basket_size, 0.0) AS avg_basket_size, coalesce(g.avg_item_price, 0.0) AS avg_item_price,
         coalesce(g.avg_discount_pct, 0.0) AS avg_discount_pct,
         coalesce(g.discount_order_rate, 0.0) AS discount_order_rate,
         coalesce(g.avg_order_hour, 0.0) AS avg_order_hour,
         coalesce(g.weekend_order_rate, 0.0) AS weekend_order_rate,
         coalesce(p.preferred_payment_method, 'unknown') AS preferred_payment_method,
         coalesce(m.dominant_meal_period, 'unknown') AS dominant_meal_period,
         coalesce(c.archetype, 'unknown') AS archetype, coalesce(c.price_tier, 'unknown') AS price_tier
  FROM scores s LEFT JOIN g ON s.customer_id = g.customer_id
  LEFT JOIN preferred_payment_method p ON s.customer_id = p.customer_id
  LEFT JOIN dominant_meal_period m ON s.customer_id = m.customer_id
  LEFT JOIN customers_v c ON s.customer_id = c.customer_id)"""

PROFILE_COLS = """count(*) AS customers, sum(monetary) AS total_revenue, avg(monetary) AS avg_monetary,
       avg(frequency) AS avg_frequency, avg(recency) AS avg_recency, avg(avg_order_value) AS avg_order_value,
       avg(avg_basket_size) AS avg_basket_size, avg(avg_discount_pct) AS avg_discount_pct,
       avg(weekend_order_rate) AS weekend_order_rate"""

NAMED = f"""
prof AS (SELECT archetype, {PROFILE_COLS} FROM features GROUP BY archetype),
q AS (SELECT count(*) AS n, quantile_cont(avg_monetary, 0.7) AS m70, quantile_cont(avg_monetary, 0.3) AS m30,
             quantile_cont(avg_frequency, 0.7) AS f70, quantile_cont(avg_recency, 0.7) AS r70,
             quantile_cont(avg_discount_pct, 0.7) AS d70, quantile_cont(avg_basket_size, 0.7) AS b70,
             quantile_cont(weekend_order_rate, 0.7) AS w70 FROM prof),
names AS (
  SELECT prof.*, CASE WHEN n < 2 THEN 'General Cluster' ELSE
    (CASE WHEN avg_monetary >= m70 THEN 'High-Value' WHEN avg_monetary <= m30 THEN 'Low-Value' ELSE 'Mid-Value' END)
    || ' ' || (CASE WHEN avg_frequency >= f70 THEN 'Frequent' WHEN avg_recency >= r70 THEN 'Inactive' ELSE 'Occasional' END)
    || ' ' || (CASE WHEN avg_discount_pct >= d70 THEN 'Discount-Sensitive' WHEN avg_basket_size >= b70 THEN 'Large-Basket'
                    WHEN weekend_order_rate >= w70 THEN 'Weekend-Oriented' ELSE 'Standard' END) END AS segment_name
  FROM prof, q),
named AS (SELECT f.*, n.segment_name, f.rfm_value_tier || ' | ' || n.segment_name AS hybrid_segment
          FROM features f LEFT JOIN names n ON f.archetype = n.archetype)"""


def cte(*blocks: str) -> str:
    return "WITH " + ",".join(b.strip("\n") for b in blocks) + "\n"


BASE = (ORDER_LEVEL, RFM, SCORES, FEATURES)


# ---------------------------------------------------------------------------

@register("order_level", sql=cte(ORDER_LEVEL) + "SELECT * FROM order_level")
def order_level(t):
    """AG7: lines → one row per order with totals, basket and time features."""
    return C.order_level(t.valid_lines)


@register("rfm_base", sql=cte(ORDER_LEVEL, RFM) + "SELECT * FROM rfm")
def rfm_base(t):
    """AG8: recency / frequency / monetary / tenure per customer."""
    return C.rfm_base(C.order_level(t.valid_lines))


@register("rfm_scores", sql=cte(ORDER_LEVEL, RFM, SCORES) + "SELECT * FROM scores")
def rfm_scores(t):
    """WN13 quintiles (first-come ranks), SF5 code, SF19 segment, SF20 tier."""
    return C.rfm_scores(C.rfm_base(C.order_level(t.valid_lines)))


@register("customer_features", sql=cte(*BASE) + "SELECT * FROM features")
def customer_features(t):
    """AG17 + WN15 + JN5 + PRJ3: the customer feature table."""
    return features(t)[1]


@register("rfm_segment_summary", sql=cte(*BASE) + """
SELECT rfm_segment, count(*) AS customers, avg(recency) AS avg_recency, avg(frequency) AS avg_frequency,
       sum(monetary) AS total_revenue, avg(monetary) AS avg_monetary, avg(rfm_score) AS avg_rfm_score
FROM features GROUP BY rfm_segment""")
def rfm_segment_summary(t):
    """AG18: RFM segment profile table."""
    f = features(t)[1]
    return (f.groupBy("rfm_segment").agg(
        F.count(F.lit(1)).alias("customers"), F.avg("recency").alias("avg_recency"),
        F.avg("frequency").alias("avg_frequency"), F.sum("monetary").alias("total_revenue"),
        F.avg("monetary").alias("avg_monetary"), F.avg("rfm_score").alias("avg_rfm_score"))
        .orderBy(F.desc("customers")))


@register("segment_shares", sql=cte(*BASE) + """
, seg AS (SELECT rfm_segment, count(*) AS customers, sum(monetary) AS revenue FROM features GROUP BY rfm_segment)
SELECT *, customers * 100.0 / (SELECT sum(customers) FROM seg) AS customer_pct,
       revenue * 100.0 / (SELECT sum(revenue) FROM seg) AS revenue_pct, revenue / customers AS revenue_per_customer
FROM seg""")
def segment_shares(t):
    """AG19: share of customers and revenue per RFM segment."""
    f = features(t)[1]
    seg = f.groupBy("rfm_segment").agg(F.count(F.lit(1)).alias("customers"), F.sum("monetary").alias("revenue"))
    return (O.with_shares(seg, {"customers": "customer_pct", "revenue": "revenue_pct"})
            .withColumn("revenue_per_customer", F.col("revenue") / F.col("customers")))


@register("archetype_segment_names", sql=cte(*BASE, NAMED) + "SELECT * FROM names")
def archetype_segment_names(t):
    """DP27: profile-quantile naming applied to archetype groups."""
    f = features(t)[1]
    return C.name_clusters(C.segment_profile(f, "archetype"), "archetype")


@register("hybrid_segment_actions", sql=cte(*BASE, NAMED) + """
, prof2 AS (SELECT hybrid_segment, count(*) AS customers, sum(monetary) AS total_revenue, avg(monetary) AS avg_monetary,
            avg(frequency) AS avg_frequency, avg(recency) AS avg_recency, avg(avg_order_value) AS avg_order_value,
            avg(avg_basket_size) AS avg_basket_size, avg(avg_discount_pct) AS avg_discount_pct
            FROM named GROUP BY hybrid_segment),
th AS (SELECT median(recency) AS med_rec, quantile_cont(avg_basket_size, 0.75) AS q75b FROM named)
SELECT prof2.*, CASE
   WHEN lower(hybrid_segment) LIKE '%high-value%' AND avg_recency <= med_rec THEN 'VIP loyalty program and premium personalization'
   WHEN lower(hybrid_segment) LIKE '%high-value%' AND avg_recency > med_rec THEN 'Win-back campaign for valuable customers'
   WHEN lower(hybrid_segment) LIKE '%discount%' THEN 'Targeted promotions and coupon campaigns'
   WHEN avg_basket_size > q75b THEN 'Bundle and cross-sell offers'
   WHEN lower(hybrid_segment) LIKE '%low-value%' THEN 'Low-cost engagement campaign'
   ELSE 'Standard personalized communication' END AS recommended_action
FROM prof2, th""")
def hybrid_segment_actions(t):
    """DP28 + SF5: hybrid 'tier | name' profiles with recommended actions."""
    return C.recommend_actions(named_features(t))


@register("action_summary", sql=cte(*BASE, NAMED) + """
, prof2 AS (SELECT hybrid_segment, count(*) AS customers, sum(monetary) AS total_revenue,
            avg(recency) AS avg_recency, avg(avg_basket_size) AS avg_basket_size FROM named GROUP BY hybrid_segment),
th AS (SELECT median(recency) AS med_rec, quantile_cont(avg_basket_size, 0.75) AS q75b FROM named),
act AS (SELECT prof2.*, CASE
   WHEN lower(hybrid_segment) LIKE '%high-value%' AND avg_recency <= med_rec THEN 'VIP loyalty program and premium personalization'
   WHEN lower(hybrid_segment) LIKE '%high-value%' AND avg_recency > med_rec THEN 'Win-back campaign for valuable customers'
   WHEN lower(hybrid_segment) LIKE '%discount%' THEN 'Targeted promotions and coupon campaigns'
   WHEN avg_basket_size > q75b THEN 'Bundle and cross-sell offers'
   WHEN lower(hybrid_segment) LIKE '%low-value%' THEN 'Low-cost engagement campaign'
   ELSE 'Standard personalized communication' END AS recommended_action FROM prof2, th)
SELECT recommended_action, count(*) AS segments, CAST(sum(customers) AS BIGINT) AS customers, sum(total_revenue) AS revenue
FROM act GROUP BY recommended_action""")
def action_summary(t):
    """AG37: segments, customers and revenue by recommended action."""
    return C.action_summary(C.recommend_actions(named_features(t)))


@register("scaled_segment_profile", sql=cte(*BASE, NAMED) + """
, st AS (SELECT avg(avg_monetary) AS mm, stddev_pop(avg_monetary) AS sm, avg(avg_frequency) AS mf,
                stddev_pop(avg_frequency) AS sf, avg(avg_recency) AS mr, stddev_pop(avg_recency) AS sr FROM names)
SELECT archetype, (avg_monetary - mm) / nullif(sm, 0) AS z_avg_monetary,
       (avg_frequency - mf) / nullif(sf, 0) AS z_avg_frequency, (avg_recency - mr) / nullif(sr, 0) AS z_avg_recency
FROM names, st""")
def scaled_segment_profile(t):
    """DP29: standardised segment profile heat map."""
    f = features(t)[1]
    prof = C.segment_profile(f, "archetype")
    return C.scaled_profile(prof, "archetype", ["avg_monetary", "avg_frequency", "avg_recency"])


@register("customer_diversity", sql="""
SELECT customer_id, count(DISTINCT item_id) AS n_unique_items, count(DISTINCT category) AS n_unique_categories,
       count(DISTINCT section) AS n_unique_sections FROM valid_lines GROUP BY customer_id""")
def customer_diversity(t):
    """AG16: preference diversity."""
    return C.diversity(t.valid_lines)


@register("dominant_section", sql="""
SELECT customer_id, section AS dominant_section FROM (
  SELECT customer_id, section, row_number() OVER (PARTITION BY customer_id ORDER BY sum(line_total) DESC, section) AS rn
  FROM valid_lines GROUP BY customer_id, section) WHERE rn = 1""")
def dominant_section(t):
    """WN16: highest-spend section per customer."""
    return C.dominant(t.valid_lines, "section", "dominant_section")


@register("category_spend_shares", sql="""
WITH p AS (SELECT customer_id, """ + ", ".join(
    f"sum(line_total) FILTER (WHERE category = '{c}') AS \"{c}\"" for c in CATEGORIES) + """
  FROM valid_lines GROUP BY customer_id)
SELECT customer_id, """ + ", ".join(
    f"coalesce(\"{c}\", 0) / (" + " + ".join(f"coalesce(\"{d}\", 0)" for d in CATEGORIES) + f") AS share_{c}"
    for c in CATEGORIES) + " FROM p")
def category_spend_shares(t):
    """AG14: row-normalised spend share per category (explicit pivot values)."""
    return O.share_pivot(t.valid_lines, "customer_id", "category", F.col("line_total"), CATEGORIES)


@register("weekday_order_shares", sql=cte(ORDER_LEVEL) + """
, p AS (SELECT customer_id, """ + ", ".join(
    f"count(*) FILTER (WHERE day_of_week_num = {d}) AS d{d}" for d in range(7)) + """ FROM order_level GROUP BY customer_id)
SELECT customer_id, """ + ", ".join(f"CAST(d{d} AS DOUBLE) / (" + " + ".join(f"d{e}" for e in range(7)) +
                                    f") AS share_{d}" for d in range(7)) + " FROM p")
def weekday_order_shares(t):
    """AG14: share of each customer's orders by weekday (Mon=0)."""
    return O.share_pivot(C.order_level(t.valid_lines), "customer_id", "day_of_week_num", None, list(range(7)))


@register("revenue_pareto", sql=cte(ORDER_LEVEL, RFM) + """
SELECT customer_id, monetary,
       sum(monetary) OVER (ORDER BY monetary DESC, customer_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_value,
       row_number() OVER (ORDER BY monetary DESC, customer_id) AS spend_rank,
       sum(monetary) OVER (ORDER BY monetary DESC, customer_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         / sum(monetary) OVER () AS cum_share
FROM rfm""")
def revenue_pareto(t):
    """WN12: cumulative revenue share in spend order (distributed running sum)."""
    return C.pareto(C.rfm_base(C.order_level(t.valid_lines)))


@register("revenue_concentration", sql=cte(ORDER_LEVEL, RFM) + """
, r AS (SELECT monetary, row_number() OVER (ORDER BY monetary DESC, customer_id) AS rk, count(*) OVER () AS n,
               sum(monetary) OVER () AS s FROM rfm)
SELECT sum(CASE WHEN rk <= floor(n * 0.05) THEN monetary ELSE 0 END) * 100.0 / max(s) AS top_5_pct_share,
       sum(CASE WHEN rk <= floor(n * 0.1) THEN monetary ELSE 0 END) * 100.0 / max(s) AS top_10_pct_share,
       sum(CASE WHEN rk <= floor(n * 0.2) THEN monetary ELSE 0 END) * 100.0 / max(s) AS top_20_pct_share
FROM r""")
def revenue_concentration(t):
    """AG43: share of spend held by the top 5 / 10 / 20 % of customers."""
    return O.concentration(C.rfm_base(C.order_level(t.valid_lines)), "monetary", "customer_id", [0.05, 0.1, 0.2])


@register("segment_kpis", sql=cte(*BASE) + """
SELECT count(*) AS customers, sum(monetary) AS total_revenue, avg(monetary) AS avg_spend,
       avg(frequency) AS avg_frequency, avg(recency) AS avg_recency,
       count(*) FILTER (WHERE rfm_value_tier = 'High-Value') AS high_value_customers,
       count(*) FILTER (WHERE rfm_value_tier = 'Low-Value') AS low_value_customers FROM features""")
def segment_kpis(t):
    """AG40: executive KPI row."""
    return C.segment_kpis(features(t)[1])


AUDIENCES = """
gapped AS (SELECT *, CAST(ceil(customer_tenure_days / 30.0) AS BIGINT) + 1 - frequency AS visit_gap FROM named),
q2 AS (SELECT quantile_cont(monetary, 0.75) AS m75, quantile_cont(frequency, 0.75) AS f75,
               quantile_cont(recency, 0.75) AS r75, median(monetary) AS m50, quantile_cont(visit_gap, 0.75) AS g75,
               quantile_cont(avg_discount_pct, 0.75) AS d75, quantile_cont(avg_basket_size, 0.75) AS b75,
               quantile_cont(weekend_order_rate, 0.75) AS w75 FROM gapped),
long AS (
  SELECT customer_id, 'VIP' AS target_group, monetary FROM gapped, q2 WHERE rfm_value_tier = 'High-Value' OR (monetary >= m75 AND frequency >= f75)
  UNION ALL SELECT customer_id, 'Churn Risk', monetary FROM gapped, q2
    WHERE rfm_segment IN ('At Risk', 'Lost / Hibernating', 'Cannot Lose Them') OR (recency >= r75 AND visit_gap >= g75)
  UNION ALL SELECT customer_id, 'Win-Back', monetary FROM gapped, q2 WHERE recency >= r75 AND monetary >= m50
  UNION ALL SELECT customer_id, 'Discount-Sensitive', monetary FROM gapped, q2 WHERE avg_discount_pct >= d75 OR segment_name LIKE '%Discount%'
  UNION ALL SELECT customer_id, 'Large Basket', monetary FROM gapped, q2 WHERE avg_basket_size >= b75
  UNION ALL SELECT customer_id, 'Weekend', monetary FROM gapped, q2 WHERE weekend_order_rate >= w75)"""


@register("targeting_summary", sql=cte(*BASE, NAMED, AUDIENCES) + """
SELECT target_group, count(*) AS customers, sum(monetary) AS revenue, sum(monetary) / count(*) AS revenue_per_customer
FROM long GROUP BY target_group""")
def targeting_summary(t):
    """AG38: six target audiences with size and revenue."""
    return C.targeting_summary(named_features(t))


@register("profile_by_archetype", sql=cte(*BASE) + """
SELECT archetype, count(*) AS customers, avg(recency) AS avg_recency, avg(frequency) AS avg_frequency,
       avg(monetary) AS avg_monetary, avg(avg_basket_size) AS avg_basket_size
FROM features GROUP BY archetype""")
def profile_by_archetype(t):
    """AG44: RFM and basket means by archetype."""
    return C.rfm_by_profile(features(t)[1], "archetype")


@register("filled_customers", sql=cte(*BASE) + """
, j AS (SELECT c.customer_id, f.* EXCLUDE (customer_id) FROM customers_v c LEFT JOIN features f USING (customer_id))
SELECT customer_id, coalesce(frequency, 0) AS frequency, coalesce(monetary, 0.0) AS monetary, coalesce(recency, (SELECT max(recency) + 30 FROM j)) AS recency,
       coalesce(avg_item_price, (SELECT median(avg_item_price) FROM j)) AS avg_item_price, coalesce(r_score, 1) AS r_score, coalesce(f_score, 1) AS f_score,
       coalesce(m_score, 1) AS m_score, coalesce(rfm_code, '111') AS rfm_code, coalesce(preferred_payment_method, 'unknown') AS preferred_payment_method FROM j""")
def filled_customers(t):
    """PRJ3: customers without orders: zeros, recency of the column's highest plus 30, plain median price, lowest scores, 'unknown'."""
    f = t.customers_v.select("customer_id").join(features(t)[1], "customer_id", "left")
    return C.fill_missing(f)


@register("profile_check", sql=cte(*BASE) + """
SELECT price_tier, count(*) AS customers, avg(recency) AS avg_recency, avg(frequency) AS avg_frequency,
       avg(monetary) AS avg_monetary, avg(avg_basket_size) AS avg_basket_size FROM features GROUP BY price_tier""")
def profile_check(t):
    """AG44: RFM and basket means by price tier."""
    return C.rfm_by_profile(features(t)[1], "price_tier")


@register("customer_segment_lookup", sql=cte(*BASE) + """
SELECT f.customer_id, f.rfm_segment, f.rfm_value_tier, f.rfm_code, f.recency, f.frequency, f.monetary,
       (SELECT count(*) FROM features g WHERE g.rfm_segment = f.rfm_segment) AS segment_customers
FROM features f WHERE f.customer_id = 7""")
def customer_segment_lookup(t):
    """DP30: one customer's segment and its size."""
    return C.segment_lookup(features(t)[1], 7)


@register("customer_engagement", sql=cte(ORDER_LEVEL, RFM) + """
SELECT customer_id, CAST(ceil(customer_tenure_days / 30.0) AS BIGINT) + 1 AS expected_visits, frequency AS actual_visits,
       CAST(ceil(customer_tenure_days / 30.0) AS BIGINT) + 1 - frequency AS visit_gap,
       frequency / nullif(CAST(ceil(customer_tenure_days / 30.0) AS BIGINT) + 1, 0) AS visit_ratio,
       CASE WHEN CAST(ceil(customer_tenure_days / 30.0) AS BIGINT) + 1 - frequency > 0 THEN 1 ELSE 0 END AS under_engaged_flag
FROM rfm""")
def customer_engagement(t):
    """SF18: visit gap / ratio / under-engaged flag; expected visits = one
    per started 30 days of tenure, plus the first."""
    r = C.rfm_base(C.order_level(t.valid_lines))
    expected = C.expected_visits().alias("expected_visits")
    r = r.select("customer_id", expected, F.col("frequency").alias("actual_visits"))
    e = X.engagement("expected_visits", "actual_visits")
    return r.select("*", *[v.alias(k) for k, v in e.items()])


@register("hybrid_segment_actions_with_gap", sql=cte(*BASE, NAMED) + """
, gap AS (SELECT *, CAST(ceil(customer_tenure_days / 30.0) AS BIGINT) + 1 - frequency AS visit_gap FROM named),
prof2 AS (SELECT hybrid_segment, count(*) AS customers, avg(recency) AS avg_recency, avg(visit_gap) AS avg_visit_gap,
          avg(avg_basket_size) AS avg_basket_size FROM gap GROUP BY hybrid_segment),
th AS (SELECT median(recency) AS med_rec, quantile_cont(visit_gap, 0.75) AS q75g, quantile_cont(avg_basket_size, 0.75) AS q75b FROM gap)
SELECT prof2.*, CASE
   WHEN lower(hybrid_segment) LIKE '%high-value%' AND avg_recency <= med_rec THEN 'VIP loyalty program and premium personalization'
   WHEN lower(hybrid_segment) LIKE '%high-value%' AND avg_recency > med_rec THEN 'Win-back campaign for valuable customers'
   WHEN lower(hybrid_segment) LIKE '%discount%' THEN 'Targeted promotions and coupon campaigns'
   WHEN avg_visit_gap > q75g THEN 'Reactivation campaign based on visit gap'
   WHEN avg_basket_size > q75b THEN 'Bundle and cross-sell offers'
   WHEN lower(hybrid_segment) LIKE '%low-value%' THEN 'Low-cost engagement campaign'
   ELSE 'Standard personalized communication' END AS recommended_action
FROM prof2, th""")
def hybrid_segment_actions_with_gap(t):
    """DP28, modelling variant: action rules with the visit-gap arm."""
    return C.recommend_actions_with_gap(named_features(t))


@register("hybrid_overview_actions", sql=cte(*BASE, NAMED) + """
, prof2 AS (SELECT hybrid_segment, count(*) AS customers, avg(recency) AS avg_recency, avg(frequency) AS avg_frequency,
            avg(monetary) AS avg_monetary, avg(avg_discount_pct) AS avg_discount_pct,
            avg(CAST(ceil(customer_tenure_days / 30.0) AS BIGINT) + 1 - frequency) AS avg_visit_gap FROM named GROUP BY hybrid_segment),
th AS (SELECT quantile_cont(avg_frequency, 0.7) AS f, quantile_cont(avg_recency, 0.7) AS r, median(avg_monetary) AS m,
              quantile_cont(avg_discount_pct, 0.7) AS d, quantile_cont(avg_visit_gap, 0.7) AS g FROM prof2)
SELECT prof2.*, CASE
   WHEN starts_with(hybrid_segment, 'High-Value') AND (hybrid_segment LIKE '%Frequent%' OR avg_frequency >= f) THEN 'VIP loyalty program and premium personalization'
   WHEN hybrid_segment LIKE '%High-Value Inactive%' OR (avg_recency >= r AND avg_monetary >= m) THEN 'Win-back campaign for valuable customers'
   WHEN hybrid_segment LIKE '%Discount%' OR avg_discount_pct >= d THEN 'Targeted promotions and coupon campaigns'
   WHEN avg_visit_gap >= g OR hybrid_segment LIKE '%Inactive%' THEN 'Reactivation campaign based on visit gap'
   ELSE 'Standard nurturing and personalized recommendations' END AS recommended_action
FROM prof2, th""")
def hybrid_overview_actions(t):
    """DP28, overview variant: thresholds over the segment profiles."""
    return C.overview_actions(named_features(t))


@register("customer_basket_features", sql=cte(ORDER_LEVEL) + """
SELECT customer_id, count(DISTINCT order_id) AS total_orders, avg(order_total) AS avg_order_value, max(order_total) AS max_order_value,
       avg(basket_size) AS avg_basket_size, avg(n_unique_items) AS avg_unique_items_per_order,
       sum(order_total * order_discount_pct_mean / 100) AS total_discount_amount_est,
       median(order_total) AS median_order_value, median(basket_size) AS median_basket_size
FROM order_level GROUP BY customer_id""")
def customer_basket_features(t):
    """AG17: basket and discount measures per customer with medians, maxima and sums."""
    return C.basket_features(cut_lineage(C.order_level(t.valid_lines)))
