"""Order-level anomaly features, scores, thresholds, evaluation and alerts
(AG6, AG9–AG13, AG34–AG36, AG42, DP17–DP26, WN17–WN19, TK6, TK8, SF17,
SF27, ML10 with one diagonal component).

Scale notes
* Group profiles (item prices, cashier and customer amounts) are computed by
  partial-aggregating ``groupBy`` and joined back, never by a window
  partitioned on the group: a cashier holding a third of all orders would
  otherwise put a third of the rows into one task.
* Curves and ranking metrics work on one row per *distinct score* (or per
  threshold bucket); where a global order is needed it uses the distributed
  running sums of ``operators.ordered``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retail_spark.functions import exprs as X
from retail_spark.operators.broadcast import bounded
from retail_spark.operators.ordered import exact_quantile_list, exact_quantiles, global_row_number, global_running_sum
from retail_spark.session import cut_lineage, stored

# Fixed values of the reference rules.
RULES = [  # (condition builder key, weight, reason)
    ("very_high_discount", 0.45), ("high_discount", 0.20), ("voided_order", 0.30),
    ("odd_hour", 0.35), ("basket_outlier", 0.25), ("large_price_deviation", 0.40),
]
ENSEMBLE_WEIGHTS = {"density": 0.5, "pca": 0.2, "knn": 0.2, "rules": 0.1}
PRECISION_FLOORS = (0.60, 0.65, 0.70)
RISK_PRIORITY = {"CRITIQUE": 3, "ALERTE": 2, "NORMAL": 1}
MAD_SCALE = 1.4826
N_CURVE_QUANTILES = 500


def _i(c: Column) -> Column:
    return c.cast("int")


# ---------------------------------------------------------------------------
# Line and order features (AG6, AG9, AG10, JN3, SF17)


def item_price_stats(lines: DataFrame) -> DataFrame:
    """Median, mean and sample std of price per item; one-row std → 0 (AG9)."""
    st = lines.groupBy("item_id").agg(
        F.avg("price").alias("item_mean_price"), F.coalesce(F.stddev_samp("price"), F.lit(0.0)).alias("item_price_std"))
    return exact_quantiles(lines, {"item_median_price": ("price", 0.5)}, ["item_id"]).join(st, "item_id")


def item_demand_stats(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Item-day quantity and per-item median / mean / std of it (AG10)."""
    dd = lines.groupBy("order_date", "item_id").agg(F.sum("quantity").alias("item_daily_quantity"))
    st = dd.groupBy("item_id").agg(
        F.median("item_daily_quantity").alias("item_median_daily_quantity"),
        F.avg("item_daily_quantity").alias("item_mean_daily_quantity"),
        F.stddev_samp("item_daily_quantity").alias("item_std_daily_quantity"))
    return dd, st


HOT_ROWS = 2_000_000       # rows of an item from which on it is taken out of its one task
HOT_SHARE = 64             # orders read to look for such items: one in so many


def hot_items(lines: DataFrame, rows: int = HOT_ROWS) -> list:
    """Items that hold about ``rows`` lines or more, by the lines of every 64th order (chooses the way, not the result)."""
    some = lines.filter(F.pmod(F.xxhash64("order_id"), F.lit(HOT_SHARE)) == 0).filter(F.col("item_id").isNotNull())
    found = some.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= max(1, rows // HOT_SHARE))
    return [r["item_id"] for r in found.select("item_id").collect()]        # lines / rows items at most


def _item_context_joined(lines: DataFrame) -> DataFrame:
    """Item and item-day statistics joined to the lines: an item's lines spread over many tasks."""
    dd, st = item_demand_stats(lines)
    # both item-level tables are joined with each other first (one row per
    # item), so the lines are shuffled for one item join and one item-day join
    items = item_price_stats(lines).join(st, "item_id", "full_outer")
    l = lines.join(items, "item_id", "left").join(dd, ["order_date", "item_id"], "left")
    return l.select(*lines.columns, "item_median_price", "item_mean_daily_quantity", "item_std_daily_quantity", "item_daily_quantity")


def _item_context_windowed(lines: DataFrame) -> DataFrame:
    """The same for items of a bounded number of lines: these meet in one task, and every statistic is taken there.

    One shuffle by item and one sort, by item, day and order, serve all windows."""
    item, day = Window.partitionBy("item_id"), Window.partitionBy("item_id", "order_date")
    along = item.orderBy("order_date", "order_id")
    known, dated = F.col("item_id").isNotNull(), F.col("item_id").isNotNull() & F.col("order_date").isNotNull()
    new_day = (F.row_number().over(along) == 1) | ~F.lag("order_date").over(along).eqNullSafe(F.col("order_date"))
    l = lines.withColumn("_first", new_day).withColumn("_day", F.sum("quantity").over(day))
    once = F.when(F.col("_first"), F.col("_day"))              # one value for each day
    l = l.withColumns({"item_median_price": F.when(known, F.median(F.col("price").cast("double")).over(item)),
                       "item_mean_daily_quantity": F.when(known, F.avg(once).over(item)),
                       "item_std_daily_quantity": F.when(known, F.stddev_samp(once).over(item)),
                       "item_daily_quantity": F.when(dated, F.col("_day"))})
    return l.drop("_day", "_first")


def line_context(lines: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Price deviation from the item median and demand z-score per line (JN3).

    Lines are shuffled by item once; only items of very many lines go by joins instead."""
    hot = hot_items(lines, hot_rows)
    if hot:
        is_hot = F.coalesce(F.col("item_id").isin(hot), F.lit(False))
        l = _item_context_windowed(lines.filter(~is_hot)).unionByName(_item_context_joined(lines.filter(is_hot)))
    else:
        l = _item_context_windowed(lines)
    dev_pct = X.safe_div(F.col("price") - F.col("item_median_price"), "item_median_price")
    z = X.safe_div(F.col("item_daily_quantity") - F.col("item_mean_daily_quantity"), "item_std_daily_quantity")
    return l.select("*", dev_pct.alias("price_deviation_pct"),
                    F.coalesce(F.abs(dev_pct), F.lit(0.0)).alias("abs_price_deviation_pct"),
                    F.coalesce(z, F.lit(0.0)).alias("demand_zscore"),
                    (F.col("price") * F.col("discount_rate")).alias("estimated_discount_amount"))


ORDER_KEYS = ["order_id", "order_ts", "order_date", "cashier_id", "customer_id", "payment_method"]


def order_measures(lines: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Line → order aggregation, 29 measures (AG6)."""
    used = ["line_number", "item_id", "category", "quantity", "price", "discount_rate", "line_total", "is_voided"]
    l = line_context(lines.select(*ORDER_KEYS, *used), hot_rows).select(
        *ORDER_KEYS, *[c for c in used if c != "quantity"], "price_deviation_pct", "item_daily_quantity", "demand_zscore")
    # lines meet by order once and are sorted there: distinct values are counted as first
    # ones, so neither sets nor partly aggregated rows (wider than lines) are shuffled
    l = l.repartition("order_id").withColumns({
        "abs_price_deviation_pct": F.coalesce(F.abs("price_deviation_pct"), F.lit(0.0)),
        "estimated_discount_amount": F.col("price") * F.col("discount_rate")})
    for c in ("item_id", "category"):
        w = Window.partitionBy(*ORDER_KEYS, c).orderBy("line_number")
        l = l.withColumn(f"_new_{c}", F.col(c).isNotNull() & (F.row_number().over(w) == 1))
    first_key = F.col("line_number").cast("bigint") * 1_000_000_000 + F.col("item_id")
    return l.groupBy(*ORDER_KEYS).agg(
        F.min_by("category", first_key).alias("main_category"),
        F.count(F.lit(1)).alias("basket_size"), F.count_if("_new_item_id").cast("int").alias("n_unique_items"),
        F.count_if("_new_category").cast("int").alias("n_unique_categories"),
        F.sum("line_total").alias("total_amount"), F.avg("line_total").alias("avg_line_total"),
        F.max("line_total").alias("max_line_total"), F.min("line_total").alias("min_line_total"),
        F.avg("price").alias("avg_item_price"), F.max("price").alias("max_item_price"),
        F.min("price").alias("min_item_price"),
        F.avg("discount_rate").alias("mean_discount_rate"), F.max("discount_rate").alias("max_discount_rate"),
        F.sum(_i(F.col("discount_rate") > 0)).cast("bigint").alias("discount_line_count"),
        F.sum("estimated_discount_amount").alias("estimated_discount_amount"),
        F.max(_i(F.col("is_voided"))).alias("is_voided_order"),
        F.sum(_i(F.col("is_voided"))).cast("bigint").alias("void_line_count"),
        F.avg("price_deviation_pct").alias("mean_price_deviation_pct"),
        F.max("abs_price_deviation_pct").alias("max_abs_price_deviation_pct"),
        F.avg("abs_price_deviation_pct").alias("mean_abs_price_deviation_pct"),
        F.avg("item_daily_quantity").alias("mean_daily_item_quantity"),
        F.max("item_daily_quantity").alias("max_daily_item_quantity"),
        F.avg("demand_zscore").alias("mean_demand_zscore"),
        F.max(F.abs("demand_zscore")).alias("max_abs_demand_zscore"))


RATIOS = {  # name → (columns it is made of, expression)
    "has_discount_order": (["discount_line_count"], lambda: _i(F.col("discount_line_count") > 0)),
    "discount_line_rate": (["discount_line_count", "basket_size"], lambda: X.safe_div("discount_line_count", "basket_size")),
    "void_line_rate": (["void_line_count", "basket_size"], lambda: X.safe_div("void_line_count", "basket_size")),
    "avg_amount_per_item": (["total_amount", "basket_size"], lambda: X.safe_div("total_amount", "basket_size")),
    "unique_item_ratio": (["n_unique_items", "basket_size"], lambda: X.safe_div("n_unique_items", "basket_size"))}


def with_ratios(orders: DataFrame) -> DataFrame:
    """Order measures with the flags and ratios that follow from the columns that are there (SF17)."""
    return orders.withColumns({name: made() for name, (of, made) in RATIOS.items() if set(of) <= set(orders.columns)})


def order_features(lines: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Order measures plus ratios (AG6, SF17)."""
    return with_ratios(order_measures(lines, hot_rows))


def cashier_profile(orders: DataFrame) -> DataFrame:
    """Orders, mean / std amount, void rate, discount rate per cashier (AG11)."""
    return orders.groupBy("cashier_id").agg(
        F.count(F.lit(1)).alias("cashier_orders"), F.avg("total_amount").alias("cashier_mean_amount"),
        F.coalesce(F.stddev_samp("total_amount"), F.lit(0.0)).alias("cashier_std_amount"),
        F.avg("is_voided_order").alias("cashier_void_rate"),
        F.avg("has_discount_order").alias("cashier_discount_rate"))


def customer_profile(orders: DataFrame) -> DataFrame:
    """Orders, mean / std amount, mean basket per customer (AG12)."""
    return orders.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("customer_orders"), F.avg("total_amount").alias("customer_mean_amount"),
        F.coalesce(F.stddev_samp("total_amount"), F.lit(0.0)).alias("customer_std_amount"),
        F.avg("basket_size").alias("customer_mean_basket"))


def label_rollup(labels: DataFrame) -> DataFrame:
    """Per order: first mode of the type (smallest on ties) and the sorted
    distinct descriptions joined by ' | ' (AG13)."""
    return labels.groupBy("order_id").agg(
        F.mode("anomaly_type", True).alias("anomaly_type"),
        F.array_join(F.sort_array(F.collect_set("description")), " | ").alias("anomaly_description"))


def split_by_position(df: DataFrame, order: list[Column], fracs=(0.7, 0.85)) -> DataFrame:
    """Chronological split by row position: first floor(0.7n) train, up to
    floor(0.85n) validation, rest test (WN19).  Positions come from a range
    sort, so rows of one moment spread over many tasks."""
    ranked = global_row_number(df, order, "_pos")
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    idx = F.col("_pos") - 1
    return (ranked.crossJoin(F.broadcast(n))
            .withColumn("split", F.when(idx < F.floor(F.col("_n") * fracs[0]), "train")
                        .when(idx < F.floor(F.col("_n") * fracs[1]), "val").otherwise("test"))
            .drop("_n", "_pos"))


def split_by_key(df: DataFrame, keys: list[str], fracs=(0.7, 0.85)) -> DataFrame:
    """``split_by_position`` in ascending order of columns of a written frame, which stays where it lies: only the
    keys are range-sorted, and rows compare theirs with the keys at both positions.  Rows themselves are sorted only
    if some with equal keys lie on both sides of a position."""
    ranked = global_row_number(df.select(*keys), [F.asc(k) for k in keys], "_pos")      # of written keys
    n = ranked.count()
    at = [int(np.floor(n * f)) for f in fracs]
    ends = ranked.filter(F.col("_pos").isin([a + 1 for a in at])).groupBy("_pos").agg(F.first(F.struct(*keys)).alias("_end"))
    ends = cut_lineage(ends)                                              # a row for each position
    same = F.struct(*keys).eqNullSafe(F.col("_end"))
    lows = ranked.withColumnRenamed("_pos", "_p").join(F.broadcast(ends), same).groupBy("_pos").agg(F.min("_p").alias("_low"))
    if not lows.filter(F.col("_low") < F.col("_pos")).isEmpty():
        return split_by_position(df, [F.asc(k) for k in keys], fracs)
    row = cut_lineage(ends.agg(*[F.max(F.when(F.col("_pos") == a + 1, F.col("_end"))).alias(f"_e{i}") for i, a in enumerate(at)]))
    own = F.struct(*keys)
    return (df.crossJoin(F.broadcast(row))
            .withColumn("split", F.when(own < F.col("_e0"), "train").when(own < F.col("_e1"), "val").otherwise("test"))
            .drop("_e0", "_e1"))


# What the split, the profiles and the ratios of one column read; kept whatever columns are wanted.
FRAME_BASE = ["order_id", "order_ts", "cashier_id", "customer_id", "total_amount", "basket_size", "is_voided_order", "discount_line_count"]


def model_frame(lines: DataFrame, labels: DataFrame, label_lines: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Orders with cashier / customer context, z-scores (WN17), basket
    deviation (WN18), time flags (SF13), labels (one row for an order) and the 70/15/15 split.

    ``columns``: those that the caller reads (all if left out); the lines carry, and the written rows hold, only what
    these are made of."""
    wanted = lambda names: columns is None or not set(names).isdisjoint(columns)
    # order features feed two profiles and the join back: written once.  The labels
    # join first, where an order's lines met: no other shuffle by order
    f = order_measures(lines)
    o = f.join(labels, "order_id", "left").fillna(0, subset=["is_anomaly"]).join(label_rollup(label_lines), "order_id", "left")
    marks = [c for c in o.columns if c not in f.columns]
    if columns is not None:
        kept = {*FRAME_BASE, *columns, *[c for name, (of, _) in RATIOS.items() if name in columns for c in of]}
        o = o.select(*[c for c in o.columns if c in kept])
    o = stored(o, "orders")
    measures = [c for c in f.columns if c in o.columns]
    marks = [c for c in marks if c in o.columns]
    # positions are looked up, by a sort of all orders, for those that read the split
    ends = [*marks, "split"] if wanted(["split"]) else marks
    o = with_ratios(split_by_key(o, ["order_ts", "order_id"]) if "split" in ends else o)
    own = [c for c in o.columns if c not in (*measures, *ends)]
    z = lambda v, m, s: F.coalesce(X.safe_div(F.col(v) - F.col(m), s), F.lit(0.0))
    last, context = [], {}
    cashiers, customers = cashier_profile(o), customer_profile(o)
    of_customer = {"amount_z_customer": z("total_amount", "customer_mean_amount", "customer_std_amount"),
                   "basket_vs_customer": F.col("basket_size") - F.col("customer_mean_basket"),
                   "basket_ratio_customer": X.safe_div("basket_size", "customer_mean_basket")}
    by_customer = wanted([*customers.columns[1:], *of_customer])
    if by_customer:
        o = o.join(customers, "customer_id", "left")
    if wanted([*cashiers.columns[1:], "amount_z_cashier"]):
        # a few cashiers are broadcast: a join by shuffle would gather the orders of each of them in a task
        o = o.join(bounded(cut_lineage(cashiers)), "cashier_id", "left")
        last += cashiers.columns[1:]
        context["amount_z_cashier"] = z("total_amount", "cashier_mean_amount", "cashier_std_amount")
    if by_customer:
        last += customers.columns[1:]
        context |= of_customer
    o = o.select("order_id", "customer_id", "cashier_id", *[c for c in measures if c not in ("order_id", "customer_id", "cashier_id")],
                 *own, *last, *[v.alias(k) for k, v in context.items()], F.hour("order_ts").alias("order_hour"),
                 X.weekday0("order_ts").alias("order_dayofweek"), F.month("order_ts").alias("order_month"), *ends)
    flags = X.time_flags("order_hour", "order_dayofweek")
    o = o.select(*[c for c in o.columns if c not in ends], *[v.alias(k) for k, v in flags.items()], *ends)
    if columns is not None:
        o = o.select(*[c for c in o.columns if c in columns])
    # the customers' join shuffles orders: written for those that read it several times
    return stored(o, "frame") if by_customer else o


# ---------------------------------------------------------------------------
# Scores (DP17, DP18, ML10, DP22, SF27)


def rule_score(df: DataFrame) -> DataFrame:
    """Weighted rule score clipped to [0, 1] with reasons (DP17).  The basket
    threshold is the exact q99 of the train split."""
    q = exact_quantiles(df.filter(F.col("split") == "train"), {"_b99": ("basket_size", 0.99)})
    d = df.crossJoin(F.broadcast(q))
    c = F.col
    conds = {
        "very_high_discount": c("max_discount_rate") >= 0.70,
        "high_discount": (c("max_discount_rate") >= 0.30) & (c("max_discount_rate") < 0.70),
        "voided_order": c("is_voided_order") == 1,
        "odd_hour": c("is_odd_hour") == 1,
        "basket_outlier": c("basket_size") >= c("_b99"),
        "large_price_deviation": c("max_abs_price_deviation_pct") >= 0.30,
    }
    weights = dict(RULES)
    score = sum((F.when(cond, F.lit(weights[k])).otherwise(0.0) for k, cond in conds.items()), F.lit(0.0))
    reasons = F.array_compact(F.array(*[F.when(cond, F.lit(k)) for k, cond in conds.items()]))
    return (d.withColumn("rule_score", X.clip(score, 0.0, 1.0))
            .withColumn("rule_reasons", F.when(F.size(reasons) > 0, F.array_join(reasons, "; "))
                        .otherwise("no_rule_triggered")).drop("_b99"))


def _fit_rows(df: DataFrame) -> DataFrame:
    return df.filter((F.col("split") == "train") & (F.col("is_anomaly") == 0))


def robust_z(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    """|x − median| / (1.4826 · MAD) per feature from train normal rows; row
    score 0.7 · p99 + 0.3 · max across the features (DP18).  ``df`` should be a
    projection of written rows: each pass of the quantiles reads it."""
    fit = _fit_rows(df)
    med = exact_quantiles(fit, {f"_med_{f}": (f, 0.5) for f in feats}, written=True)          # one row
    off = fit.crossJoin(F.broadcast(med)).select(*[F.abs(F.col(f) - F.col(f"_med_{f}")).alias(f) for f in feats])
    mad = exact_quantiles(off, {f"_mad_{f}": (f, 0.5) for f in feats}, written=True)
    d = df.crossJoin(F.broadcast(med)).crossJoin(F.broadcast(mad))
    zs = [F.abs((F.col(f) - F.col(f"_med_{f}")) /
                (MAD_SCALE * F.greatest(F.col(f"_mad_{f}"), F.lit(1e-6)))) for f in feats]
    m = len(feats)
    pos = 0.99 * (m - 1)
    lo, frac = int(np.floor(pos)), pos - np.floor(pos)
    s = F.sort_array(F.array(*zs))
    p99 = s[lo] + (s[min(lo + 1, m - 1)] - s[lo]) * F.lit(float(frac))
    score = 0.7 * p99 + 0.3 * F.array_max(s)
    return d.withColumn("robust_z_score", score).drop(*[f"_med_{f}" for f in feats], *[f"_mad_{f}" for f in feats])


def density_score(df: DataFrame, feats: Sequence[str], reg: float = 1e-6) -> DataFrame:
    """Negative log-likelihood under one diagonal Gaussian fitted on train
    normal rows (ML10 with a single component; variances + 1e-6)."""
    st = cut_lineage(_fit_rows(df).agg(*[F.avg(f).alias(f"_mu_{f}") for f in feats],
                                       *[(F.var_pop(f) + reg).alias(f"_v_{f}") for f in feats]))      # one row
    d = df.crossJoin(F.broadcast(st))
    nll = sum((0.5 * (F.log(2 * np.pi * F.col(f"_v_{f}")) + F.pow(F.col(f) - F.col(f"_mu_{f}"), 2) / F.col(f"_v_{f}"))
               for f in feats), F.lit(0.0))
    return d.withColumn("density_score", nll).drop(*[f"_mu_{f}" for f in feats], *[f"_v_{f}" for f in feats])


def minmax_ref(df: DataFrame, score: str, name: str, ref_split: str = "val") -> DataFrame:
    """Min-max normalisation with validation bounds, clipped to [0, 1] (SF27);
    constant validation scores give 0."""
    b = cut_lineage(df.filter(F.col("split") == ref_split).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi")))      # one row
    d = df.crossJoin(F.broadcast(b))
    norm = F.when(F.col("_hi") - F.col("_lo") < 1e-12, F.lit(0.0)).otherwise(
        (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return d.withColumn(name, X.clip(norm, 0.0, 1.0)).drop("_lo", "_hi")


def ensemble(df: DataFrame, scores: dict[str, str], name: str = "ensemble_score") -> DataFrame:
    """Σ w·s / Σ w over the available normalised scores (DP22)."""
    w = {k: ENSEMBLE_WEIGHTS[k] for k in scores}
    tot = sum(w.values())
    return df.withColumn(name, sum((F.col(c) * (w[k] / tot) for k, c in scores.items()), F.lit(0.0)))


# ---------------------------------------------------------------------------
# Curves, thresholds and evaluation (DP19–DP21, TK8)


def curve_fractions() -> list[float]:
    return [float(x) for x in np.linspace(0.01, 0.999, N_CURVE_QUANTILES)]


def threshold_curve(df: DataFrame, score: str, label: str = "is_anomaly") -> DataFrame:
    """Precision, recall, F1, alerts at each distinct quantile threshold (DP19).

    Thresholds (≤ 500, one row) are broadcast; each score row finds its bucket
    (number of thresholds ≤ score); counts per bucket are suffix-summed over
    ≤ 501 rows — no row × threshold product is formed."""
    fr = curve_fractions()
    ths = exact_quantile_list(df, score, fr, "q").select(F.array_distinct(F.sort_array("q")).alias("ths"))   # one row
    d = df.select(score, label).crossJoin(F.broadcast(ths))
    b = d.select(F.size(F.filter("ths", lambda t: t <= F.col(score))).alias("bucket"), label)
    per = b.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum(label).alias("_p"))
    tot = df.agg(F.count(F.lit(1)).alias("_N"), F.sum(label).alias("_P"))
    th = ths.select(F.posexplode("ths").alias("i", "threshold")).withColumn("bucket", F.col("i") + 1)
    w = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)   # ≤ 501 rows
    cum = (per.select("bucket", F.sum("_n").over(w).alias("alerts"), F.sum("_p").over(w).alias("tp")))
    # a threshold i counts scores in buckets ≥ i + 1; carry the suffix sum of the
    # nearest non-empty bucket at or above it
    full = th.join(cum, "bucket", "left")
    wf = Window.orderBy("bucket").rowsBetween(0, Window.unboundedFollowing)
    full = full.withColumn("alerts", F.coalesce(F.first("alerts", True).over(wf), F.lit(0))) \
        .withColumn("tp", F.coalesce(F.first("tp", True).over(wf), F.lit(0)))
    out = full.crossJoin(F.broadcast(tot))
    prec = F.when(F.col("alerts") > 0, F.col("tp") / F.col("alerts")).otherwise(0.0)
    rec = F.when(F.col("_P") > 0, F.col("tp") / F.col("_P")).otherwise(0.0)
    curve = (out.select("threshold", prec.alias("precision"), rec.alias("recall"),
                       F.col("alerts").cast("bigint").alias("n_alerts"),
                       (F.col("alerts") / F.col("_N")).alias("alert_rate"))
            .withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                     2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                        .otherwise(0.0)))
    return cut_lineage(curve)      # ≤ 500 rows, read by several choices


def choose_threshold(curve: DataFrame, mode: str = "balanced_f1", floor: float = 0.60) -> DataFrame:
    """Best F1 (then recall, precision); or best recall with precision ≥ floor
    (then F1, precision, fewest alerts), falling back to best F1 (DP20)."""
    c = curve
    bf = c.orderBy(F.desc("f1"), F.desc("recall"), F.desc("precision"), F.asc("threshold")).limit(1) \
        .select("threshold", F.lit("balanced_f1").alias("rule"))
    if mode == "balanced_f1":
        return bf.withColumn("mode", F.lit(mode))
    fl = (c.filter(F.col("precision") >= floor)
          .orderBy(F.desc("recall"), F.desc("f1"), F.desc("precision"), F.asc("n_alerts"), F.asc("threshold"))
          .limit(1).select("threshold", F.lit("precision_floor").alias("rule")))
    both = fl.unionByName(bf).withColumn("_o", F.when(F.col("rule") == "precision_floor", 0).otherwise(1))
    return both.orderBy("_o").limit(1).drop("_o").withColumn("mode", F.lit(mode))


def evaluate(df: DataFrame, score: str, threshold: float | Column, label: str = "is_anomaly",
             ks: Sequence[int] = (50, 100, 200), tiebreak: Sequence[str] = ("order_ts", "order_id")) -> DataFrame:
    """Confusion counts, precision / recall / F1 at the threshold, average
    precision (step), tie-aware ROC-AUC and top-k precision / recall (DP21, TK8)."""
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pred = (F.col(score) >= thr).cast("int")
    y = F.col(label)
    conf = df.agg(F.sum(pred * y).alias("tp"), F.sum(pred * (1 - y)).alias("fp"),
                  F.sum((1 - pred) * y).alias("fn"), F.sum((1 - pred) * (1 - y)).alias("tn"),
                  F.count(F.lit(1)).alias("n"), F.sum(y).alias("positives"))
    c = F.col
    conf = conf.select("*", F.when(c("tp") + c("fp") > 0, c("tp") / (c("tp") + c("fp"))).otherwise(0.0).alias("precision"),
                       F.when(c("tp") + c("fn") > 0, c("tp") / (c("tp") + c("fn"))).otherwise(0.0).alias("recall"),
                       ((c("tp") + c("fp")) / c("n")).alias("alert_rate"))
    conf = conf.withColumn("f1", F.when(c("precision") + c("recall") > 0,
                                        2 * c("precision") * c("recall") / (c("precision") + c("recall"))).otherwise(0.0))
    # one row per distinct score, distributed running sums in both directions
    # (Spark resolves names case-insensitively: group and total columns get
    # distinct names, not _p / _P)
    per = df.groupBy(score).agg(F.count(F.lit(1)).alias("_gn"), F.sum(label).alias("_gp"))
    # one distributed ascending pass; "at or above" sums are total − below + own
    asc = cut_lineage(global_running_sum(per, [F.asc(score)], {"_below": F.col("_gn"), "_below_p": F.col("_gp")}))
    pos = df.agg(F.sum(label).alias("_tp_all"), F.count(F.lit(1)).alias("_n_all"))
    P, N = c("_tp_all"), c("_n_all")
    desc = (asc.crossJoin(F.broadcast(pos))
            .withColumn("_cn", N - c("_below") + c("_gn")).withColumn("_cp", P - c("_below_p") + c("_gp")))
    ap = desc.agg(F.sum(F.when(P > 0, c("_gp") / P * (c("_cp") / c("_cn")))).alias("pr_auc"))
    auc = (asc.crossJoin(F.broadcast(pos))
           .select((c("_below") - c("_gn") + (c("_gn") + 1) / 2.0).alias("_avg_rank"), "_gp", "_tp_all", "_n_all")
           .groupBy("_tp_all", "_n_all").agg(F.sum(c("_gp") * c("_avg_rank")).alias("_rs"))
           .select(F.when((P > 0) & (N - P > 0), (c("_rs") - P * (P + 1) / 2) / (P * (N - P))).alias("roc_auc")))
    out = conf.crossJoin(ap).crossJoin(auc)
    best = cut_lineage(df.orderBy(F.desc(score), *[F.desc(t) for t in tiebreak]).limit(max(ks)))   # max(ks) rows, sorted once
    for k in ks:
        top = (best.orderBy(F.desc(score), *[F.desc(t) for t in tiebreak]).limit(k)
               .agg(F.sum(label).alias(f"anomalies_found_at_{k}"), F.count(F.lit(1)).alias(f"_k{k}")))
        out = out.crossJoin(top)
        out = (out.withColumn(f"precision_at_{k}", c(f"anomalies_found_at_{k}") / c(f"_k{k}"))
               .withColumn(f"recall_at_{k}", F.when(c("positives") > 0, c(f"anomalies_found_at_{k}") / c("positives"))
                           .otherwise(0.0)).drop(f"_k{k}"))
    return out


# ---------------------------------------------------------------------------
# Alerts (DP24–DP26, AG34–AG36, AG42, TK6)


def risk_levels(df: DataFrame, score: str, decision: float | Column) -> DataFrame:
    """NORMAL below the decision threshold; CRITIQUE at or above
    max(q75 of flagged scores, decision) clipped to ≤ .999; else ALERTE (DP24)."""
    dec = decision if isinstance(decision, Column) else F.lit(float(decision))
    flagged = df.filter(F.col(score) >= dec)
    q = exact_quantiles(flagged, {"_q75": (score, 0.75)})
    d = df.crossJoin(F.broadcast(q))
    high = F.when(F.col("_q75").isNull(), F.least(F.lit(1.0), dec + 0.20)).otherwise(F.greatest(F.col("_q75"), dec))
    high = F.least(F.greatest(high, dec), F.lit(0.999))
    lvl = F.when(F.col(score) < dec, "NORMAL").when(F.col(score) >= high, "CRITIQUE").otherwise("ALERTE")
    pr = F.when(lvl == "CRITIQUE", 3).when(lvl == "ALERTE", 2).otherwise(1)
    return (d.withColumn("predicted_is_anomaly", (F.col(score) >= dec).cast("int"))
            .withColumn("risk_level", lvl).withColumn("risk_priority", pr)
            .withColumn("high_threshold", high).drop("_q75"))


def alert_reasons(df: DataFrame) -> DataFrame:
    """Readable reasons in fixed order; fallbacks for model-only and normal
    rows (DP25).  Basket and amount thresholds are the exact q99 over all orders."""
    q = exact_quantiles(df, {"_b99": ("basket_size", 0.99), "_a99": ("total_amount", 0.99)})
    d = df.crossJoin(F.broadcast(q))
    c = F.col
    parts = F.array_compact(F.array(
        F.when(c("max_discount_rate") >= 0.50, F.lit("high discount")),
        F.when(c("max_abs_price_deviation_pct") >= 0.25, F.lit("price deviation")),
        F.when(c("is_voided_order") == 1, F.lit("voided order")),
        F.when(c("is_odd_hour") == 1, F.lit("odd-hour transaction")),
        F.when(c("basket_size") >= c("_b99"), F.lit("unusual basket size")),
        F.when(c("total_amount") >= c("_a99"), F.lit("high transaction amount")),
        F.when(c("cashier_flagged") == 1, F.lit("high-risk cashier pattern"))))
    text = (F.when(F.size(parts) > 0, F.array_join(parts, "; "))
            .when(c("predicted_is_anomaly") == 1, "high model anomaly probability").otherwise("normal behavior"))
    return d.withColumn("alert_explanation", text).drop("_b99", "_a99")


def risk_summary(alerts: DataFrame) -> DataFrame:
    """Orders, mean score, hits, share and precision per risk level (AG34)."""
    tot = alerts.agg(F.count(F.lit(1)).alias("_t"))
    g = alerts.groupBy("risk_level").agg(F.count(F.lit(1)).alias("orders"), F.avg("score").alias("mean_score"),
                                         F.sum("is_anomaly").alias("true_anomalies"))
    return (g.crossJoin(F.broadcast(tot)).withColumn("share_pct", F.col("orders") * 100.0 / F.col("_t"))
            .withColumn("precision_in_level", F.col("true_anomalies") / F.col("orders")).drop("_t"))


def recall_by_type(alerts: DataFrame) -> DataFrame:
    """Share of labelled anomalies flagged, by anomaly type (AG35)."""
    return (alerts.filter(F.col("is_anomaly") == 1).groupBy("anomaly_type")
            .agg(F.count(F.lit(1)).alias("anomalies"), F.avg("predicted_is_anomaly").alias("recall")))


def suspicious_discounts(orders: DataFrame, rate: str = "discount", limit: float = 0.5) -> DataFrame:
    """Orders with a discount over the limit, the highest first (AG42)."""
    return orders.filter(F.col(rate) > limit)


def cashier_risk(orders: DataFrame) -> DataFrame:
    """Void and anomaly rate per cashier versus the mean of the other
    cashiers' orders (AG36): totals minus own, one aggregate pass."""
    g = orders.groupBy("cashier_id").agg(F.count(F.lit(1)).alias("orders"),
                                         F.sum("is_voided_order").alias("_v"), F.sum("is_anomaly").alias("_a"))
    tot = orders.agg(F.count(F.lit(1)).alias("_tn"), F.sum("is_voided_order").alias("_tv"),
                     F.sum("is_anomaly").alias("_ta"))
    c = F.col
    return (g.crossJoin(F.broadcast(tot))
            .select("cashier_id", "orders", (c("_v") / c("orders")).alias("void_rate"),
                    (c("_a") / c("orders")).alias("anomaly_rate"),
                    X.safe_div(c("_tv") - c("_v"), c("_tn") - c("orders")).alias("others_void_rate"),
                    X.safe_div(c("_ta") - c("_a"), c("_tn") - c("orders")).alias("others_anomaly_rate")))


def type_mix(orders: DataFrame, cashier: str) -> DataFrame:
    """Anomaly-type shares of one cashier versus all cashiers (AG42)."""
    lab = orders.filter(F.col("anomaly_type").isNotNull())
    allc = lab.groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("all_count"))
    one = lab.filter(F.col("cashier_id") == cashier).groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("cashier_count"))
    t_all = lab.agg(F.count(F.lit(1)).alias("_ta"))
    t_one = lab.filter(F.col("cashier_id") == cashier).agg(F.count(F.lit(1)).alias("_to"))
    j = allc.join(one, "anomaly_type", "left").fillna(0, subset=["cashier_count"]) \
        .crossJoin(F.broadcast(t_all)).crossJoin(F.broadcast(t_one))
    return j.select("anomaly_type", "all_count", "cashier_count",
                    (F.col("all_count") * 100.0 / F.col("_ta")).alias("all_pct"),
                    X.safe_div(F.col("cashier_count") * 100.0, "_to").alias("cashier_pct"))
