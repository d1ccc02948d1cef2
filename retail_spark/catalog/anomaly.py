"""Anomaly queries: order features, profiles, scores, curves, thresholds,
evaluation, risk levels and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from retail_spark.catalog import register
from retail_spark.catalog.segments import cte
from retail_spark.plans import anomaly as A

FEATS = ["total_amount", "basket_size", "n_unique_items", "max_discount_rate", "mean_discount_rate",
         "max_abs_price_deviation_pct", "mean_demand_zscore", "void_line_rate", "amount_z_cashier",
         "amount_z_customer"]
DENSITY_FEATS = ["total_amount", "basket_size", "max_discount_rate", "mean_demand_zscore"]
FLAGGED_CASHIERS = ["5-LOW"]   # fixed: the cashier list flagged by the business


RULE_FEATS = ["basket_size", "max_discount_rate", "is_voided_order", "is_odd_hour", "max_abs_price_deviation_pct"]
# what the scores, their evaluation and the alerts read
SCORED_COLUMNS = ["order_id", "order_ts", "customer_id", "cashier_id", "amount_z_cashier", "is_anomaly", "anomaly_type", "split",
                  *RULE_FEATS, *DENSITY_FEATS]


def frame(t, columns=None):
    f = A.model_frame(t.sale_lines, t.labels_v, t.anomaly_lines_v, columns)
    # the frame is a projection of written rows: read by every score's fit aggregates as it is
    return f.withColumn("cashier_flagged", F.col("cashier_id").isin(*FLAGGED_CASHIERS).cast("int"))


def scored(t, with_robust_z=False):
    f = A.density_score(A.rule_score(frame(t, SCORED_COLUMNS + (FEATS if with_robust_z else []))), DENSITY_FEATS)
    f = A.minmax_ref(f, "density_score", "density_norm")
    if with_robust_z:       # no part of the ensemble
        f = A.minmax_ref(A.robust_z(f, FEATS), "robust_z_score", "robust_z_norm")
    # still a projection of the frame's written rows, with fits of one row each: bounds,
    # curve and evaluation read the columns they need, nothing is written again
    return A.ensemble(f, {"density": "density_norm", "rules": "rule_score"})


def chosen(t, score="ensemble_score", mode="balanced_f1", floor=0.6):
    s = scored(t)
    curve = A.threshold_curve(s.filter(F.col("split") == "val"), score)
    return s, A.choose_threshold(curve, mode, floor)


def alerts(t):
    s, th = chosen(t)
    test = s.filter(F.col("split") == "test").crossJoin(F.broadcast(th.select(F.col("threshold").alias("decision"))))
    lv = A.risk_levels(test, "ensemble_score", F.col("decision"))
    return A.alert_reasons(lv).withColumn("score", F.col("ensemble_score"))


# ---------------------------------------------------------------------------
# SQL twins

FEATURES_SQL = """
ips AS (SELECT item_id, median(price) AS item_median_price, avg(price) AS item_mean_price,
               coalesce(stddev_samp(price), 0.0) AS item_price_std FROM sale_lines GROUP BY item_id),
dd AS (SELECT order_date, item_id, sum(quantity) AS item_daily_quantity FROM sale_lines GROUP BY 1, 2),
ids AS (SELECT item_id, median(item_daily_quantity) AS item_median_daily_quantity,
               avg(item_daily_quantity) AS item_mean_daily_quantity,
               stddev_samp(item_daily_quantity) AS item_std_daily_quantity FROM dd GROUP BY item_id),
ll AS (SELECT l.*, (price - item_median_price) / nullif(item_median_price, 0) AS price_deviation_pct,
              coalesce(abs((price - item_median_price) / nullif(item_median_price, 0)), 0.0) AS abs_price_deviation_pct,
              dd.item_daily_quantity,
              coalesce((dd.item_daily_quantity - item_mean_daily_quantity) / nullif(item_std_daily_quantity, 0), 0.0) AS demand_zscore,
              price * discount_rate AS estimated_discount_amount
       FROM sale_lines l LEFT JOIN ips USING (item_id) LEFT JOIN dd USING (order_date, item_id) LEFT JOIN ids USING (item_id)),
of0 AS (SELECT order_id, order_ts, order_date, cashier_id, customer_id, payment_method,
               arg_min(category, CAST(line_number AS BIGINT) * 1000000000 + item_id) AS main_category,
               count(*) AS basket_size, count(DISTINCT item_id) AS n_unique_items,
               count(DISTINCT category) AS n_unique_categories, sum(line_total) AS total_amount,
               avg(line_total) AS avg_line_total, max(line_total) AS max_line_total, min(line_total) AS min_line_total,
               avg(price) AS avg_item_price, max(price) AS max_item_price, min(price) AS min_item_price,
               avg(discount_rate) AS mean_discount_rate, max(discount_rate) AS max_discount_rate,
               CAST(sum(CASE WHEN discount_rate > 0 THEN 1 ELSE 0 END) AS BIGINT) AS discount_line_count,
               sum(estimated_discount_amount) AS estimated_discount_amount,
               max(CASE WHEN is_voided THEN 1 ELSE 0 END) AS is_voided_order,
               CAST(sum(CASE WHEN is_voided THEN 1 ELSE 0 END) AS BIGINT) AS void_line_count,
               avg(price_deviation_pct) AS mean_price_deviation_pct,
               max(abs_price_deviation_pct) AS max_abs_price_deviation_pct,
               avg(abs_price_deviation_pct) AS mean_abs_price_deviation_pct,
               avg(item_daily_quantity) AS mean_daily_item_quantity, max(item_daily_quantity) AS max_daily_item_quantity,
               avg(demand_zscore) AS mean_demand_zscore, max(abs(demand_zscore)) AS max_abs_demand_zscore
        FROM ll GROUP BY order_id, order_ts, order_date, cashier_id, customer_id, payment_method),
ofeat AS (SELECT *, CASE WHEN discount_line_count > 0 THEN 1 ELSE 0 END AS has_discount_order,
                 discount_line_count / nullif(basket_size, 0) AS discount_line_rate,
                 void_line_count / nullif(basket_size, 0) AS void_line_rate,
                 total_amount / nullif(basket_size, 0) AS avg_amount_per_item,
                 n_unique_items / nullif(basket_size, 0) AS unique_item_ratio FROM of0)"""

PROFILES_SQL = """
cp AS (SELECT cashier_id, count(*) AS cashier_orders, avg(total_amount) AS cashier_mean_amount,
              coalesce(stddev_samp(total_amount), 0.0) AS cashier_std_amount,
              avg(is_voided_order) AS cashier_void_rate, avg(has_discount_order) AS cashier_discount_rate
       FROM ofeat GROUP BY cashier_id),
up AS (SELECT customer_id, count(*) AS customer_orders, avg(total_amount) AS customer_mean_amount,
              coalesce(stddev_samp(total_amount), 0.0) AS customer_std_amount, avg(basket_size) AS customer_mean_basket
       FROM ofeat GROUP BY customer_id),
lr AS (SELECT order_id, mode() WITHIN GROUP (ORDER BY anomaly_type) AS anomaly_type,
              array_to_string(list_sort(list(DISTINCT description)), ' | ') AS anomaly_description
       FROM anomaly_lines_v GROUP BY order_id)"""

FRAME_SQL = """
fr0 AS (SELECT o.*, cp.* EXCLUDE (cashier_id), up.* EXCLUDE (customer_id),
               coalesce((total_amount - cashier_mean_amount) / nullif(cashier_std_amount, 0), 0.0) AS amount_z_cashier,
               coalesce((total_amount - customer_mean_amount) / nullif(customer_std_amount, 0), 0.0) AS amount_z_customer,
               basket_size - customer_mean_basket AS basket_vs_customer,
               basket_size / nullif(customer_mean_basket, 0) AS basket_ratio_customer,
               hour(order_ts) AS order_hour, isodow(order_ts) - 1 AS order_dayofweek, month(order_ts) AS order_month
        FROM ofeat o LEFT JOIN cp ON o.cashier_id = cp.cashier_id LEFT JOIN up ON o.customer_id = up.customer_id),
fr1 AS (SELECT fr0.*, CASE WHEN order_dayofweek IN (5, 6) THEN 1 ELSE 0 END AS is_weekend,
               CASE WHEN order_hour < 6 OR order_hour >= 23 THEN 1 ELSE 0 END AS is_odd_hour,
               CASE WHEN order_hour BETWEEN 6 AND 10 THEN 1 ELSE 0 END AS is_morning,
               CASE WHEN order_hour BETWEEN 11 AND 15 THEN 1 ELSE 0 END AS is_lunch,
               CASE WHEN order_hour BETWEEN 18 AND 22 THEN 1 ELSE 0 END AS is_dinner,
               coalesce(lb.is_anomaly, 0) AS is_anomaly, lr.anomaly_type, lr.anomaly_description
        FROM fr0 LEFT JOIN labels_v lb ON fr0.order_id = lb.order_id LEFT JOIN lr ON fr0.order_id = lr.order_id),
frame AS (SELECT * EXCLUDE (pos_, n_), CASE WHEN pos_ - 1 < floor(n_ * 0.7) THEN 'train'
                  WHEN pos_ - 1 < floor(n_ * 0.85) THEN 'val' ELSE 'test' END AS split,
                 CASE WHEN cashier_id IN ('5-LOW') THEN 1 ELSE 0 END AS cashier_flagged
          FROM (SELECT *, row_number() OVER (ORDER BY order_ts, order_id) AS pos_, count(*) OVER () AS n_ FROM fr1))"""

BASE = (FEATURES_SQL, PROFILES_SQL, FRAME_SQL)


def _z(f):
    return f"abs(({f} - md_{f}) / (1.4826 * greatest(mad_{f}, 1e-6)))"


RZ_SQL = ("""
fitrows AS (SELECT * FROM frame WHERE split = 'train' AND is_anomaly = 0),
med AS (SELECT """ + ", ".join(f"median({f}) AS md_{f}" for f in FEATS) + """ FROM fitrows),
mad AS (SELECT """ + ", ".join(f"median(abs({f} - md_{f})) AS mad_{f}" for f in FEATS) + """ FROM fitrows, med),
rz0 AS (SELECT frame.*, list_sort([""" + ", ".join(_z(f) for f in FEATS) + """]) AS zs FROM frame, med, mad),
rz AS (SELECT * EXCLUDE (zs), 0.7 * (zs[{lo}] + (zs[{hi}] - zs[{lo}]) * CAST('{frac!r}' AS DOUBLE)) + 0.3 * list_max(zs) AS robust_z_score FROM rz0)""".format(
    lo=int(0.99 * (len(FEATS) - 1)) + 1, hi=min(int(0.99 * (len(FEATS) - 1)) + 2, len(FEATS)),
    frac=0.99 * (len(FEATS) - 1) - int(0.99 * (len(FEATS) - 1))))

RULE_SQL = """
b99 AS (SELECT quantile_cont(basket_size, 0.99) AS b99 FROM frame WHERE split = 'train'),
rs0 AS (SELECT rz.*, list_filter([
          CASE WHEN max_discount_rate >= 0.70 THEN 'very_high_discount' END,
          CASE WHEN max_discount_rate >= 0.30 AND max_discount_rate < 0.70 THEN 'high_discount' END,
          CASE WHEN is_voided_order = 1 THEN 'voided_order' END,
          CASE WHEN is_odd_hour = 1 THEN 'odd_hour' END,
          CASE WHEN basket_size >= b99 THEN 'basket_outlier' END,
          CASE WHEN max_abs_price_deviation_pct >= 0.30 THEN 'large_price_deviation' END], lambda x: x IS NOT NULL) AS rl,
          (CASE WHEN max_discount_rate >= 0.70 THEN 0.45 ELSE 0.0 END)
          + (CASE WHEN max_discount_rate >= 0.30 AND max_discount_rate < 0.70 THEN 0.20 ELSE 0.0 END)
          + (CASE WHEN is_voided_order = 1 THEN 0.30 ELSE 0.0 END) + (CASE WHEN is_odd_hour = 1 THEN 0.35 ELSE 0.0 END)
          + (CASE WHEN basket_size >= b99 THEN 0.25 ELSE 0.0 END)
          + (CASE WHEN max_abs_price_deviation_pct >= 0.30 THEN 0.40 ELSE 0.0 END) AS raw_rule
        FROM rz, b99),
rs AS (SELECT * EXCLUDE (rl, raw_rule), CAST(least(greatest(raw_rule, 0.0), 1.0) AS DOUBLE) AS rule_score,
              CASE WHEN len(rl) > 0 THEN array_to_string(rl, '; ') ELSE 'no_rule_triggered' END AS rule_reasons FROM rs0)"""

DENS_SQL = ("""
dst AS (SELECT """ + ", ".join(f"avg({f}) AS mu_{f}, var_pop({f}) + 1e-6 AS v_{f}" for f in DENSITY_FEATS) + """
        FROM frame WHERE split = 'train' AND is_anomaly = 0),
ds AS (SELECT rs.*, 0.0 + """ + " + ".join(
    f"0.5 * (ln(2 * pi() * v_{f}) + pow({f} - mu_{f}, 2) / v_{f})" for f in DENSITY_FEATS) + """ AS density_score FROM rs, dst),
bnd AS (SELECT min(density_score) AS dlo, max(density_score) AS dhi, min(robust_z_score) AS rlo, max(robust_z_score) AS rhi
        FROM ds WHERE split = 'val'),
scored AS (SELECT ds.*,
   least(greatest(CASE WHEN dhi - dlo < 1e-12 THEN 0.0 ELSE (density_score - dlo) / (dhi - dlo) END, 0.0), 1.0) AS density_norm,
   least(greatest(CASE WHEN rhi - rlo < 1e-12 THEN 0.0 ELSE (robust_z_score - rlo) / (rhi - rlo) END, 0.0), 1.0) AS robust_z_norm
   FROM ds, bnd),
scored2 AS (SELECT *, 0.0 + density_norm * (0.5 / 0.6) + rule_score * (0.1 / 0.6) AS ensemble_score FROM scored)""")

FR = A.curve_fractions()
FR_SQL = "[" + ", ".join(f"CAST('{x!r}' AS DOUBLE)" for x in FR) + "]"

CURVE_SQL = f"""
v AS (SELECT * FROM scored2 WHERE split = 'val'),
ths AS (SELECT list_sort(list_distinct(quantile_cont(ensemble_score, {FR_SQL}))) AS ths FROM v),
th AS (SELECT unnest(ths) AS threshold, generate_subscripts(ths, 1) AS bucket FROM ths),
tot AS (SELECT count(*) AS nn, sum(is_anomaly) AS pp FROM v),
cnt AS (SELECT th.threshold, th.bucket,
               (SELECT count(*) FROM v WHERE ensemble_score >= th.threshold) AS alerts,
               (SELECT coalesce(sum(is_anomaly), 0) FROM v WHERE ensemble_score >= th.threshold) AS tp FROM th),
curve AS (SELECT threshold,
             CASE WHEN alerts > 0 THEN tp / alerts ELSE 0.0 END AS precision,
             CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END AS recall,
             CAST(alerts AS BIGINT) AS n_alerts, alerts / nn AS alert_rate FROM cnt, tot),
curve2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM curve)"""

CHOSEN_SQL = """
chosen AS (SELECT threshold FROM curve2 ORDER BY f1 DESC, recall DESC, precision DESC, threshold LIMIT 1)"""


def _eval_sql(score, tiebreak="order_ts DESC, order_id DESC"):
    return f"""
te AS (SELECT *, CASE WHEN {score} >= (SELECT threshold FROM chosen) THEN 1 ELSE 0 END AS pred FROM scored2 WHERE split = 'test'),
conf AS (SELECT CAST(sum(pred * is_anomaly) AS BIGINT) AS tp, CAST(sum(pred * (1 - is_anomaly)) AS BIGINT) AS fp,
                CAST(sum((1 - pred) * is_anomaly) AS BIGINT) AS fn,
                CAST(sum((1 - pred) * (1 - is_anomaly)) AS BIGINT) AS tn, count(*) AS n,
                CAST(sum(is_anomaly) AS BIGINT) AS positives FROM te),
per AS (SELECT {score} AS s, count(*) AS n_, sum(is_anomaly) AS p_ FROM te GROUP BY 1),
cum AS (SELECT *, sum(n_) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cn,
               sum(p_) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cp,
               sum(n_) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS below FROM per),
ap AS (SELECT sum(CASE WHEN (SELECT positives FROM conf) > 0 THEN p_ / (SELECT positives FROM conf) * (cp / cn) END) AS pr_auc FROM cum),
auc AS (SELECT CASE WHEN max(P) > 0 AND max(N) - max(P) > 0
                    THEN (sum(p_ * (below - n_ + (n_ + 1) / 2.0)) - max(P) * (max(P) + 1) / 2) / (max(P) * (max(N) - max(P))) END AS roc_auc
        FROM cum, (SELECT positives AS P, n AS N FROM conf)),
""" + ",\n".join(f"""k{k} AS (SELECT CAST(sum(is_anomaly) AS BIGINT) AS anomalies_found_at_{k}, count(*) AS kk{k} FROM
   (SELECT is_anomaly FROM te ORDER BY {score} DESC, {tiebreak} LIMIT {k}))""" for k in (50, 100, 200)) + """,
ev AS (SELECT conf.*, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
              CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, (tp + fp) / n AS alert_rate,
              ap.pr_auc, auc.roc_auc, """ + ", ".join(
        f"anomalies_found_at_{k}, anomalies_found_at_{k} / kk{k} AS precision_at_{k}, "
        f"CASE WHEN positives > 0 THEN anomalies_found_at_{k} / positives ELSE 0.0 END AS recall_at_{k}"
        for k in (50, 100, 200)) + """ FROM conf, ap, auc, k50, k100, k200),
ev2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM ev)"""


ALERTS_SQL = """
test_ AS (SELECT * FROM scored2 WHERE split = 'test'),
dec AS (SELECT threshold AS decision FROM chosen),
q75 AS (SELECT quantile_cont(ensemble_score, 0.75) AS q FROM test_, dec WHERE ensemble_score >= decision),
hi AS (SELECT least(greatest(CASE WHEN q IS NULL THEN least(1.0, decision + 0.20) ELSE greatest(q, decision) END, decision), 0.999) AS high
       FROM q75, dec),
qq AS (SELECT quantile_cont(basket_size, 0.99) AS b99, quantile_cont(total_amount, 0.99) AS a99 FROM test_),
al0 AS (SELECT test_.*, decision, CASE WHEN ensemble_score >= decision THEN 1 ELSE 0 END AS predicted_is_anomaly,
               CASE WHEN ensemble_score < decision THEN 'NORMAL' WHEN ensemble_score >= high THEN 'CRITIQUE' ELSE 'ALERTE' END AS risk_level,
               high AS high_threshold,
               list_filter([CASE WHEN max_discount_rate >= 0.50 THEN 'high discount' END,
                            CASE WHEN max_abs_price_deviation_pct >= 0.25 THEN 'price deviation' END,
                            CASE WHEN is_voided_order = 1 THEN 'voided order' END,
                            CASE WHEN is_odd_hour = 1 THEN 'odd-hour transaction' END,
                            CASE WHEN basket_size >= b99 THEN 'unusual basket size' END,
                            CASE WHEN total_amount >= a99 THEN 'high transaction amount' END,
                            CASE WHEN cashier_flagged = 1 THEN 'high-risk cashier pattern' END], lambda x: x IS NOT NULL) AS parts
        FROM test_, dec, hi, qq),
alerts AS (SELECT * EXCLUDE (parts), CASE risk_level WHEN 'CRITIQUE' THEN 3 WHEN 'ALERTE' THEN 2 ELSE 1 END AS risk_priority,
                  CASE WHEN len(parts) > 0 THEN array_to_string(parts, '; ')
                       WHEN predicted_is_anomaly = 1 THEN 'high model anomaly probability' ELSE 'normal behavior' END AS alert_explanation,
                  ensemble_score AS score FROM al0)"""

SCORED = BASE + (RZ_SQL, RULE_SQL, DENS_SQL)


@register("order_features", sql=cte(FEATURES_SQL) + "SELECT * FROM ofeat")
def order_features(t):
    """AG6 + JN3 + SF17: 29 order measures from lines with item context."""
    return A.order_features(t.sale_lines)


@register("item_price_stats", sql="""
SELECT item_id, median(price) AS item_median_price, avg(price) AS item_mean_price,
       coalesce(stddev_samp(price), 0.0) AS item_price_std FROM sale_lines GROUP BY item_id""")
def item_price_stats(t):
    """AG9: price median / mean / std per item."""
    return A.item_price_stats(t.sale_lines)


@register("item_demand_stats", sql="""
WITH dd AS (SELECT order_date, item_id, sum(quantity) AS item_daily_quantity FROM sale_lines GROUP BY 1, 2)
SELECT item_id, median(item_daily_quantity) AS item_median_daily_quantity, avg(item_daily_quantity) AS item_mean_daily_quantity,
       stddev_samp(item_daily_quantity) AS item_std_daily_quantity FROM dd GROUP BY item_id""")
def item_demand_stats(t):
    """AG10: per-item daily demand statistics."""
    return A.item_demand_stats(t.sale_lines)[1]


@register("cashier_profile", sql=cte(FEATURES_SQL, PROFILES_SQL) + "SELECT * FROM cp")
def cashier_profile(t):
    """AG11: cashier orders, amount mean / std, void and discount rates."""
    return A.cashier_profile(A.order_features(t.sale_lines))


@register("customer_profile", sql=cte(FEATURES_SQL, PROFILES_SQL) + "SELECT * FROM up")
def customer_profile(t):
    """AG12: customer orders, amount mean / std, mean basket."""
    return A.customer_profile(A.order_features(t.sale_lines))


@register("label_rollup", sql=cte(FEATURES_SQL, PROFILES_SQL) + "SELECT * FROM lr")
def label_rollup(t):
    """AG13: first mode of anomaly type and joined sorted descriptions per order."""
    return A.label_rollup(t.anomaly_lines_v)


@register("anomaly_model_frame", sql=cte(*BASE) + "SELECT * FROM frame")
def anomaly_model_frame(t):
    """WN17 z-scores, WN18 basket deviation, SF13 flags, labels, WN19 70/15/15 split."""
    return frame(t)


@register("rule_scores", sql=cte(*BASE, RZ_SQL, RULE_SQL) + "SELECT order_id, split, rule_score, rule_reasons FROM rs")
def rule_scores(t):
    """DP17: weighted rule score with reasons (train q99 basket threshold)."""
    return A.rule_score(frame(t, ["order_id", "cashier_id", "split", *RULE_FEATS])).select("order_id", "split", "rule_score", "rule_reasons")


@register("robust_z_scores", sql=cte(*BASE, RZ_SQL) + "SELECT order_id, split, robust_z_score FROM rz")
def robust_z_scores(t):
    """DP18: robust z over ten features, 0.7·p99 + 0.3·max per row."""
    return A.robust_z(frame(t, ["order_id", "cashier_id", "is_anomaly", "split", *FEATS]), FEATS).select("order_id", "split", "robust_z_score")


@register("ensemble_scores", sql=cte(*SCORED) + """
SELECT order_id, split, is_anomaly, density_score, density_norm, robust_z_norm, rule_score, ensemble_score FROM scored2""")
def ensemble_scores(t):
    """ML10 (one diagonal Gaussian), SF27 validation min-max, DP22 weighted ensemble."""
    return scored(t, with_robust_z=True).select("order_id", "split", "is_anomaly", "density_score", "density_norm", "robust_z_norm",
                            "rule_score", "ensemble_score")


@register("threshold_curve", sql=cte(*SCORED, CURVE_SQL) + "SELECT * FROM curve2")
def threshold_curve(t):
    """DP19: precision / recall / F1 / alerts at 500 validation quantile thresholds."""
    s = scored(t)
    return A.threshold_curve(s.filter(F.col("split") == "val"), "ensemble_score")


@register("chosen_thresholds", sql=cte(*SCORED, CURVE_SQL) + """
, bf AS (SELECT threshold FROM curve2 ORDER BY f1 DESC, recall DESC, precision DESC, threshold LIMIT 1)
SELECT 'balanced_f1' AS mode, threshold, 'balanced_f1' AS rule FROM bf
UNION ALL """ + "\nUNION ALL ".join(f"""SELECT 'precision_floor_{int(p * 100)}', * FROM (
   SELECT coalesce((SELECT threshold FROM curve2 WHERE precision >= {p}
                    ORDER BY recall DESC, f1 DESC, precision DESC, n_alerts, threshold LIMIT 1), (SELECT threshold FROM bf)),
          CASE WHEN EXISTS (SELECT 1 FROM curve2 WHERE precision >= {p}) THEN 'precision_floor' ELSE 'balanced_f1' END)"""
                                   for p in A.PRECISION_FLOORS))
def chosen_thresholds(t):
    """DP20: best-F1 and precision-floor (0.60 / 0.65 / 0.70) thresholds with fallback."""
    s = scored(t)
    curve = A.threshold_curve(s.filter(F.col("split") == "val"), "ensemble_score")
    out = A.choose_threshold(curve, "balanced_f1")
    for p in A.PRECISION_FLOORS:
        out = out.unionByName(A.choose_threshold(curve, f"precision_floor_{int(p * 100)}", p))
    return out


@register("test_evaluation", sql=cte(*SCORED, CURVE_SQL, CHOSEN_SQL, _eval_sql("ensemble_score")) + "SELECT * FROM ev2")
def test_evaluation(t):
    """DP21 + TK8: confusion, P/R/F1, PR-AUC, ROC-AUC, top-50/100/200 on test."""
    s, th = chosen(t)
    test = s.filter(F.col("split") == "test").crossJoin(F.broadcast(th.select("threshold")))
    return A.evaluate(test, "ensemble_score", F.col("threshold")).drop()


@register("model_leaderboard", sql=cte(*SCORED) + ", " + ",\n".join(
    f"""v_{m} AS (SELECT * FROM scored2 WHERE split = 'val'),
ths_{m} AS (SELECT unnest(list_sort(list_distinct(quantile_cont({m}, {FR_SQL})))) AS threshold FROM v_{m}),
cv_{m} AS (SELECT threshold, (SELECT count(*) FROM v_{m} WHERE {m} >= threshold) AS al,
                  (SELECT coalesce(sum(is_anomaly), 0) FROM v_{m} WHERE {m} >= threshold) AS tp,
                  (SELECT sum(is_anomaly) FROM v_{m}) AS pp FROM ths_{m}),
cf_{m} AS (SELECT threshold, CASE WHEN al > 0 THEN tp / al ELSE 0.0 END AS p, CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END AS r FROM cv_{m}),
ch_{m} AS (SELECT threshold FROM cf_{m} ORDER BY CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END DESC, r DESC, p DESC, threshold LIMIT 1),
e_{m} AS (SELECT '{m}' AS model, sum(pd * is_anomaly) AS tp, sum(pd * (1 - is_anomaly)) AS fp, sum((1 - pd) * is_anomaly) AS fn
          FROM (SELECT is_anomaly, CASE WHEN {m} >= (SELECT threshold FROM ch_{m}) THEN 1 ELSE 0 END AS pd FROM scored2 WHERE split = 'test'))"""
    for m in ("rule_score", "density_norm", "robust_z_norm", "ensemble_score")) + """,
lb AS (SELECT model, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
              CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM (
       SELECT * FROM e_rule_score UNION ALL SELECT * FROM e_density_norm UNION ALL SELECT * FROM e_robust_z_norm
       UNION ALL SELECT * FROM e_ensemble_score)),
lb2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM lb)
SELECT *, row_number() OVER (ORDER BY recall DESC, precision DESC, f1 DESC, model) AS position FROM lb2""")
def model_leaderboard(t):
    """DP23: each score evaluated on test at its own best-F1 validation
    threshold; ordered by recall, precision, F1."""
    s = scored(t, with_robust_z=True)
    rows = []
    for m in ("rule_score", "density_norm", "robust_z_norm", "ensemble_score"):
        th = A.choose_threshold(A.threshold_curve(s.filter(F.col("split") == "val"), m))
        te = s.filter(F.col("split") == "test").crossJoin(F.broadcast(th.select("threshold")))
        pred = (F.col(m) >= F.col("threshold")).cast("int")
        y = F.col("is_anomaly")
        rows.append(te.agg(F.lit(m).alias("model"), F.sum(pred * y).alias("tp"), F.sum(pred * (1 - y)).alias("fp"),
                           F.sum((1 - pred) * y).alias("fn")))
    from retail_spark.operators.relational import union_all
    lb = union_all(rows)
    c = F.col
    lb = lb.select("model", F.when(c("tp") + c("fp") > 0, c("tp") / (c("tp") + c("fp"))).otherwise(0.0).alias("precision"),
                   F.when(c("tp") + c("fn") > 0, c("tp") / (c("tp") + c("fn"))).otherwise(0.0).alias("recall"))
    lb = lb.withColumn("f1", F.when(c("precision") + c("recall") > 0,
                                    2 * c("precision") * c("recall") / (c("precision") + c("recall"))).otherwise(0.0))
    from pyspark.sql import Window
    w = Window.orderBy(F.desc("recall"), F.desc("precision"), F.desc("f1"), F.asc("model"))   # ≤ 4 rows
    return lb.withColumn("position", F.row_number().over(w))


@register("final_alerts", sql=cte(*SCORED, CURVE_SQL, CHOSEN_SQL, ALERTS_SQL) + """
SELECT order_id, order_ts, cashier_id, customer_id, total_amount, risk_level, risk_priority, score,
       predicted_is_anomaly, is_anomaly, anomaly_type, alert_explanation, decision AS threshold FROM alerts""")
def final_alerts(t):
    """DP24 risk levels + DP25 reasons on the test split."""
    return alerts(t).select("order_id", "order_ts", "cashier_id", "customer_id", "total_amount", "risk_level",
                            "risk_priority", "score", "predicted_is_anomaly", "is_anomaly", "anomaly_type",
                            "alert_explanation", F.col("decision").alias("threshold"))


@register("alert_queue", sql=cte(*SCORED, CURVE_SQL, CHOSEN_SQL, ALERTS_SQL) + """
SELECT order_id, risk_level, risk_priority, score, alert_explanation FROM alerts
ORDER BY risk_priority DESC, score DESC, order_id LIMIT 20""")
def alert_queue(t):
    """TK6: alerts by priority then score (top 20 is the feature)."""
    return (alerts(t).select("order_id", "risk_level", "risk_priority", "score", "alert_explanation")
            .orderBy(F.desc("risk_priority"), F.desc("score"), F.asc("order_id")).limit(20))


@register("alert_detail", sql=cte(*SCORED, CURVE_SQL, CHOSEN_SQL, ALERTS_SQL) + """
SELECT order_id, risk_level, score, alert_explanation, basket_size, total_amount, max_discount_rate,
       max_abs_price_deviation_pct, amount_z_cashier, cashier_id FROM alerts
WHERE order_id = (SELECT min(order_id) FROM alerts WHERE risk_level = 'CRITIQUE')""")
def alert_detail(t):
    """DP26: detail view of one scored order (first critical alert)."""
    a = alerts(t)
    first = a.filter(F.col("risk_level") == "CRITIQUE").agg(F.min("order_id").alias("order_id"))
    return a.join(first, "order_id").select("order_id", "risk_level", "score", "alert_explanation", "basket_size",
                                            "total_amount", "max_discount_rate", "max_abs_price_deviation_pct",
                                            "amount_z_cashier", "cashier_id")


@register("risk_summary", sql=cte(*SCORED, CURVE_SQL, CHOSEN_SQL, ALERTS_SQL) + """
SELECT risk_level, count(*) AS orders, avg(score) AS mean_score, CAST(sum(is_anomaly) AS BIGINT) AS true_anomalies,
       count(*) * 100.0 / (SELECT count(*) FROM alerts) AS share_pct, sum(is_anomaly) / count(*) AS precision_in_level
FROM alerts GROUP BY risk_level""")
def risk_summary(t):
    """AG34: alerts by risk level."""
    return A.risk_summary(alerts(t))


@register("recall_by_type", sql=cte(*SCORED, CURVE_SQL, CHOSEN_SQL, ALERTS_SQL) + """
SELECT anomaly_type, count(*) AS anomalies, avg(predicted_is_anomaly) AS recall FROM alerts
WHERE is_anomaly = 1 GROUP BY anomaly_type""")
def recall_by_type(t):
    """AG35: recall by anomaly type on the test split."""
    return A.recall_by_type(alerts(t))


@register("cashier_risk", sql=cte(*BASE) + """
, g AS (SELECT cashier_id, count(*) AS orders, sum(is_voided_order) AS v, sum(is_anomaly) AS a FROM frame GROUP BY cashier_id),
tt AS (SELECT count(*) AS tn, sum(is_voided_order) AS tv, sum(is_anomaly) AS ta FROM frame)
SELECT cashier_id, orders, v / orders AS void_rate, a / orders AS anomaly_rate,
       (tv - v) / nullif(tn - orders, 0) AS others_void_rate, (ta - a) / nullif(tn - orders, 0) AS others_anomaly_rate
FROM g, tt""")
def cashier_risk(t):
    """AG36: cashier void / anomaly rate versus the other cashiers."""
    return A.cashier_risk(frame(t, ["cashier_id", "is_voided_order", "is_anomaly"]))


@register("suspicious_discounts", sql="""
SELECT order_id, customer_id, cashier_id, max(discount_rate) * 10 AS discount, sum(line_total) AS amount FROM sale_lines
GROUP BY ALL HAVING max(discount_rate) * 10 > 0.5""")
def suspicious_discounts(t):
    """AG42: orders with over 50 % discount (the fixture's rates times ten)."""
    orders = t.sale_lines.groupBy("order_id", "customer_id", "cashier_id").agg(
        (F.max("discount_rate") * 10).alias("discount"), F.sum("line_total").alias("amount"))
    return A.suspicious_discounts(orders)


@register("anomaly_type_mix", sql=cte(*BASE) + """
, lab AS (SELECT * FROM frame WHERE anomaly_type IS NOT NULL),
a AS (SELECT anomaly_type, count(*) AS all_count FROM lab GROUP BY 1),
o AS (SELECT anomaly_type, count(*) AS cashier_count FROM lab WHERE cashier_id = '5-LOW' GROUP BY 1)
SELECT a.anomaly_type, all_count, coalesce(cashier_count, 0) AS cashier_count,
       all_count * 100.0 / (SELECT count(*) FROM lab) AS all_pct,
       coalesce(cashier_count, 0) * 100.0 / nullif((SELECT count(*) FROM lab WHERE cashier_id = '5-LOW'), 0) AS cashier_pct
FROM a LEFT JOIN o USING (anomaly_type)""")
def anomaly_type_mix(t):
    """AG42: anomaly-type mix of one cashier versus all."""
    return A.type_mix(frame(t, ["cashier_id", "anomaly_type"]), "5-LOW")
