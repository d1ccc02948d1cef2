"""Model-fitting queries (rows-only checks: fits and random choices have no
SQL twin).  Inputs are the same Spark-derived tables as the SQL-checked
queries: customer features, order features, weekly demand, interactions."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from retail_spark.catalog import register
from retail_spark.catalog import anomaly as CA
from retail_spark.catalog import recommend as CR
from retail_spark.catalog import timeseries as CT
from retail_spark.catalog.segments import features
from retail_spark.functions import exprs as X
from retail_spark.operators.broadcast import bounded
from retail_spark.operators.windows import latest_per
from retail_spark.plans import additive as AD
from retail_spark.plans import anomaly as A
from retail_spark.plans import customers as C
from retail_spark.plans import detectors as D
from retail_spark.plans import factors as F_
from retail_spark.plans import machines as MA
from retail_spark.plans import models as M
from retail_spark.plans import recommend as RC
from retail_spark.plans import timeseries as TS
from retail_spark.session import cut_lineage, stored

SEG_NUM = ["avg_order_value", "avg_basket_size", "avg_item_price", "avg_discount_pct", "discount_order_rate",
           "weekend_order_rate", "avg_order_hour", "recency", "frequency", "monetary"]
SEG_CAT = ["preferred_payment_method", "dominant_meal_period"]
# The feature list of the demand regressor.
TREE_FEATS = ["lag_1w", "lag_2w", "lag_3w", "lag_4w", "lag_8w", "lag_1_2_ratio", "lag_1_2_diff", "lag_1_4_mean",
              "rolling_mean_4w", "rolling_std_4w", "rolling_max_4w", "rolling_min_4w", "rolling_mean_8w",
              "rolling_std_8w", "rolling_mean_13w", "rolling_cv_4w", "demand_momentum", "expanding_mean",
              "total_lag_1w", "total_rolling_4w", "week_of_year", "month", "month_sin", "month_cos",
              "week_sin", "week_cos"]


def _seg_vectors(t):
    f = features(t)[1]
    _, x = M.preprocess(f, SEG_NUM, SEG_CAT)
    return cut_lineage(x)


@register("ml_preprocessed_customers")
def ml_preprocessed_customers(t):
    """ML1: median impute + standardise numerics, one-hot categoricals (unseen kept)."""
    return _seg_vectors(t).select("customer_id", vector_to_array("features").alias("features"))


@register("ml_kmeans_segments")
def ml_kmeans_segments(t):
    """ML2 K-means (k=5, best of three seeds) + DP27 naming of the clusters +
    SF5 hybrid segment."""
    x = _seg_vectors(t)
    _, p = M.kmeans(x, 5)
    prof = C.segment_profile(p, "cluster")
    names = C.name_clusters(prof, "cluster", "kmeans_segment_name")
    return (p.join(names.select("cluster", "kmeans_segment_name"), "cluster")
            .select("customer_id", "cluster", "kmeans_segment_name",
                    F.concat_ws(" | ", "rfm_value_tier", "kmeans_segment_name").alias("hybrid_segment")))


@register("ml_k_sweep")
def ml_k_sweep(t):
    """ML3: k = 2..10 with inertia, silhouette, Davies–Bouldin, Calinski–Harabasz."""
    return M.k_sweep(_seg_vectors(t))


@register("ml_gmm_sweep")
def ml_gmm_sweep(t):
    """ML4: diagonal Gaussian mixtures k = 1..5 (best of three starts) with log-likelihood, AIC, BIC and label quality."""
    return M.gmm_sweep(cut_lineage(_seg_vectors(t).select("features", vector_to_array("features").alias("x"))))


@register("ml_pca_projection")
def ml_pca_projection(t):
    """ML5: 2-D PCA projection of the customer feature vectors."""
    return M.pca2(_seg_vectors(t), keep=["customer_id"])


def _rec_inputs(t, item="section"):
    inter = CR._inter(t, item)
    idx = cut_lineage(RC.item_index(inter))
    inter = inter.join(bounded(idx), "item").select("customer_id", "item", "item_idx", "count")
    sp = cut_lineage(RC.holdout(inter.select("customer_id", "item")))
    train = cut_lineage(inter.join(sp.filter("split = 'train'").select("customer_id", "item"), ["customer_id", "item"]))
    return train, sp.filter("split = 'test'").select("customer_id", "item"), idx, idx.count()


# The numbers of factors, confidences and penalties that are compared, and the iterations.
SVD_FACTORS = (5, 10, 15, 20, 30, 50)
ALS_FACTORS, ALS_ALPHAS, ALS_PENALTIES = (5, 10, 15, 20, 30), (10.0, 20.0, 40.0, 80.0), (0.01, 0.1, 0.5, 1.0)


def _sweep(t, rows):
    """Held-out quality of each tried setting, the best by F1@5 marked."""
    cols = ["users", "precision_at_k", "recall_at_k", "ndcg_at_k", "f1_at_k"]
    best = max(range(len(rows)), key=lambda i: (rows[i][1]["f1_at_k"], -i))
    names = list(rows[0][0])
    schema = ", ".join([f"{c} {'string' if c == 'model' else 'double' if c in ('alpha', 'reg') else 'int'}" for c in names] + ["users long"]
                       + [f"{c} double" for c in cols[1:]] + ["is_best boolean"])
    return t.spark.createDataFrame([(*setting.values(), *[q[c] for c in cols], i == best) for i, (setting, q) in enumerate(rows)], schema)


def _svd_sweep(t, item="section"):
    train, truth, idx, n_items = _rec_inputs(t, item)
    rows = F_.user_rows(train, n_items)
    ks = [k for k in SVD_FACTORS if k < n_items]
    _, vectors = F_.truncated_svd(rows, n_items, max(ks), tol=1e-4)
    recs = cut_lineage(F_.svd_recommendations(rows, vectors, ks, 5))
    return recs, idx, _sweep(t, [({"model": f"svd_k{k}", "k": k}, F_.held_out_quality(recs.filter(F.col("k") == k), idx, truth, 5)) for k in ks])


@register("ml_svd_recommendations")
def ml_svd_recommendations(t):
    """ML6: truncated SVD of the mean-centred matrix, k swept by held-out F1@5 (DP12 metrics for each k)."""
    return _svd_sweep(t)[2]


@register("ml_svd_item_recommendations")
def ml_svd_item_recommendations(t):
    """ML6 on single items: top five for every customer under the k with the best held-out F1@5."""
    recs, idx, sweep = _svd_sweep(t, "item_id")
    best = sweep.filter("is_best").first()["k"]
    return (recs.filter(F.col("k") == best).join(idx, "item_idx")
            .select(F.col("user").alias("customer_id"), F.col("item").alias("item_id"), "k", "score", "rank"))


@register("ml_als_recommendations")
def ml_als_recommendations(t):
    """ML7: implicit ALS; factors first (alpha 40, penalty 0.1), then alpha and penalty, by held-out F1@5; own items masked."""
    train, truth, idx, n_items = _rec_inputs(t)
    rows = F_.user_rows(train, n_items)
    name = lambda s: {"model": "als", "k": s.rank, "alpha": s.alpha, "reg": s.reg}
    if F_.by_passes(n_items, max(ALS_FACTORS)):
        held = (truth.join(bounded(idx), "item").groupBy(F.col("customer_id").cast("long").alias("user"))
                .agg(F.collect_list(F.col("item_idx").cast("int")).alias("held")))
        left_out = held.join(rows, "user", "left_anti").count()
        data = F_.als_rows(rows.join(held, "user", "left").withColumn("held", F.coalesce("held", F.array().cast("array<int>"))), n_items, ALS_FACTORS)

        def tried(settings, iterations):
            tops = F_.als_tops(data, settings, F_.als_factors(data, settings, iterations), 5)
            return list(zip(map(name, settings), F_.tops_quality(tops, len(settings), left_out, 5)))
    else:
        def tried(settings, iterations):
            recs = [cut_lineage(F_.als_recommendations(train, rows, n_items, s.rank, s.alpha, s.reg, 5, iterations)) for s in settings]
            return [(name(s), F_.held_out_quality(r, idx, truth, 5)) for s, r in zip(settings, recs)]

    factors = tried([F_.Setting(k, 40.0, 0.1) for k in ALS_FACTORS], 20)
    k = max(factors, key=lambda x: x[1]["f1_at_k"])[0]["k"]
    return _sweep(t, factors + tried([F_.Setting(k, a, r) for a in ALS_ALPHAS for r in ALS_PENALTIES], 15))


def _fm_data(t):
    lines = t.valid_lines.select("order_id", "customer_id", "section", "category", "cashier_id", "order_ts")
    idx = RC.item_index(lines.select(F.col("section").alias("item")))
    of_item = lines.groupBy(F.col("section").alias("item")).agg(F.mode("category", True).alias("category"))      # an item's usual category
    idx = cut_lineage(idx.join(of_item, "item"))
    order = ["order_id", "customer_id", "cashier_id", "order_ts"]
    # an order's lines meet first: distinct rows, own items and negatives then need no other shuffle, and no task
    # gathers the rows of a large input split in a hash table
    pos = lines.select(*order, F.col("section").alias("item")).repartition("order_id").distinct().join(bounded(idx.select("item", "item_idx")), "item")
    own = pos.groupBy(*order).agg(F.collect_set("item_idx").alias("_own"))
    neg = M.negatives(pos, idx.count()).groupBy("order_id").agg(F.collect_list("item_idx").alias("_neg"))
    # a row's positives and negatives lie together: no union that would part them
    marked = lambda c, label: F.transform(c, lambda i: F.struct(i.cast("long").alias("item_idx"), F.lit(label).alias("label")))
    rows = F.concat(marked(F.col("_own"), 1.0), F.coalesce(marked(F.col("_neg"), 0.0), F.array().cast("array<struct<item_idx:bigint,label:double>>")))
    data = own.join(neg, "order_id", "left").select(*order, F.inline(rows))
    return data.join(bounded(idx.select("item_idx", "category")), "item_idx"), idx


def _context(data):
    """Meal, weekday, weekend, hour, restaurant (the cashier stands for it) and category beside customer and item; texts are hashed."""
    hour, day = F.hour("order_ts"), F.weekday("order_ts")
    return data.select("*", X.meal_period(hour, "training").alias("meal"), day.cast("string").alias("weekday"), (day >= 5).cast("double").alias("weekend"),
                       (hour / 23.0).alias("hour"), F.col("cashier_id").cast("string").alias("restaurant"),
                       F.col("customer_id").cast("string").alias("customer"), F.col("item_idx").cast("string").alias("itm"))


# the four context configurations, each with all of the one before
FM_CONFIGS = {"user_item": [], "meal": ["meal"], "day": ["meal", "weekday", "weekend"],
              "full": ["meal", "weekday", "weekend", "hour", "restaurant", "category"]}


@register("ml_negative_samples")
def ml_negative_samples(t):
    """JN12: two hash-chosen items per positive that its order does not contain."""
    data, _ = _fm_data(t)
    return data.filter("label = 0").select("order_id", "item_idx")


@register("negative_sample_counts", sql="""
WITH pos AS (SELECT DISTINCT order_id, section FROM valid_lines),
n AS (SELECT count(DISTINCT section) AS items FROM pos)
SELECT order_id, count(*) * least(2, max(n.items) - count(*)) AS negatives, 0 AS in_order FROM pos, n
GROUP BY order_id HAVING max(n.items) > count(*)""")
def negative_sample_counts(t):
    """JN12 check: min(2, available) negatives for each positive of an order, none of them in it."""
    data, _ = _fm_data(t)
    neg = data.filter("label = 0").select("order_id", "item_idx")
    own = data.filter("label = 1").select("order_id", "item_idx", F.lit(1).alias("own"))
    return (neg.join(own, ["order_id", "item_idx"], "left").groupBy("order_id")
            .agg(F.count(F.lit(1)).alias("negatives"), F.count("own").cast("int").alias("in_order")))


@register("ml_fm_configs")
def ml_fm_configs(t):
    """ML8: the four context configurations of the factorisation machine, AUC on held-out orders."""
    data, _ = _fm_data(t)
    return M.fm_compare(_context(stored(data, "pairs")), FM_CONFIGS)


@register("ml_fm_context_scores")
def ml_fm_context_scores(t):
    """ML8 + ML9: factorisation machine with the full context; every item scored
    in one context (customer 7, Monday, dinner at 20 h, the first cashier) and DP10's multiplier,
    score ÷ mean score of all items."""
    data, idx = _fm_data(t)
    cols = ["customer", "itm", *FM_CONFIGS["full"]]
    fm = M.fm_fit(_context(data), cols)
    ctx = idx.select("item_idx", "category", F.col("item_idx").cast("string").alias("itm"), F.lit("7").alias("customer"), F.lit("dinner").alias("meal"),
                     F.lit("0").alias("weekday"), F.lit(0.0).alias("weekend"), F.lit(20 / 23.0).alias("hour"), F.lit("1-URGENT").alias("restaurant"))
    scored = cut_lineage(MA.with_raw(M.hashed(ctx, cols), "fm_features", fm, ["item_idx"]).select("item_idx", "score"))
    mean = scored.agg(F.avg("score").alias("m"))
    return scored.crossJoin(F.broadcast(mean)).select("item_idx", "score", F.try_divide("score", "m").alias("multiplier"))


VECTOR_COLUMNS = ["order_id", "order_ts", "cashier_id", "split", "is_anomaly", *CA.FEATS]


def _anomaly_vectors(t, f=None):
    f = CA.frame(t, VECTOR_COLUMNS) if f is None else f
    va = VectorAssembler(inputCols=CA.FEATS, outputCol="raw", handleInvalid="keep")
    x = va.transform(f.fillna(0.0, subset=CA.FEATS))
    from pyspark.ml.feature import StandardScaler
    sc = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(
        x.filter((F.col("split") == "train") & (F.col("is_anomaly") == 0)))
    x = stored(sc.transform(x).select("order_id", "split", "is_anomaly", "order_ts", vector_to_array("features").alias("x")), "vectors")
    return x.withColumn("features", array_to_vector("x"))


def _train_normal(x):
    return x.filter((F.col("split") == "train") & (F.col("is_anomaly") == 0))


ID = ["order_id", "split", "is_anomaly"]


def _chosen(scored, candidates):
    """Number of the best candidate score on validation rows."""
    return D.best_on_validation(scored.filter("split = 'val'"), candidates)


def _pca(x):
    """Reconstruction errors for 80, 90, 95 and 99 % of the variance, fitted on train-normal rows; the chosen one."""
    targets = (0.80, 0.90, 0.95, 0.99)
    names = [f"p{i}" for i in range(len(targets))]
    scored = stored(M.pca_errors(x, M.pca_fits(_train_normal(x), targets), names, ID), "errors")
    best = _chosen(scored, names)
    return scored.select(*ID, F.col(f"p{best}").alias("pca_error"), F.lit(targets[best]).alias("target_variance"))


def _knn(x):
    """Mean distances to the 5, 10, 20, 35 or 50 nearest of all train-normal rows; the chosen one."""
    ks = (5, 10, 20, 35, 50)
    near = D.neighbour_distances(x.select(*ID, "x"), _train_normal(x), max(ks), keep=ID)
    scored = stored(near.select(*ID, *[D.mean_of_first(F.col("distances"), k).alias(f"k{k}") for k in ks]), "distances")
    best = ks[_chosen(scored, [f"k{k}" for k in ks])]
    return scored.select(*ID, F.col(f"k{best}").alias("knn_score"), F.lit(best).alias("k"))


def _density(x):
    """Negative log-likelihoods of diagonal mixtures of 1 to 4 components over all features; the chosen one."""
    counts = (1, 2, 3, 4)
    models = D.fit_mixtures(_train_normal(x).select("x"), "x", [(k, M.SEED) for k in counts])
    scored = stored(x.select(*ID, *[D.mixture_score(m, F.col("x")).alias(f"c{k}") for k, m in zip(counts, models)]), "densities")
    best = counts[_chosen(scored, [f"c{k}" for k in counts])]
    return scored.select(*ID, F.col(f"c{best}").alias("density_score"), F.lit(best).alias("components"))


@register("ml_pca_reconstruction")
def ml_pca_reconstruction(t):
    """ML11: mean squared PCA reconstruction error; explained variance chosen by recall, precision, F1 on validation rows."""
    return _pca(_anomaly_vectors(t))


@register("ml_knn_scores")
def ml_knn_scores(t):
    """ML12: exact mean distance to the nearest train-normal rows; k chosen by recall, precision, F1 on validation rows."""
    return _knn(_anomaly_vectors(t))


@register("ml_density_scores")
def ml_density_scores(t):
    """ML10: diagonal Gaussian mixture over all ten features; components chosen by recall, precision, F1 on validation rows."""
    return _density(_anomaly_vectors(t))


@register("ml_isolation_forest")
def ml_isolation_forest(t):
    """ML13: isolation forest (100 trees of 60 % of the train-normal rows)."""
    x = _anomaly_vectors(t)
    return D.isolation_scores(x, cut_lineage(_train_normal(x).select("order_id", "x")), keep=ID)


@register("ml_ensemble_scores")
def ml_ensemble_scores(t):
    """DP22: density .5, PCA .2, kNN .2, rules .1, each scaled by its validation bounds, and their weighted mean."""
    f = CA.frame(t, [*VECTOR_COLUMNS, *CA.RULE_FEATS])
    x = _anomaly_vectors(t, f)
    parts = {"density": _density(x).select("order_id", "density_score"), "pca": _pca(x).select("order_id", "pca_error"),
             "knn": _knn(x).select("order_id", "knn_score"), "rules": A.rule_score(f).select("order_id", "rule_score")}
    joined = x.select(*ID)
    for p in parts.values():
        joined = joined.join(p, "order_id")
    joined = cut_lineage(joined)
    scaled = {k: f"{k}_norm" for k in parts}
    for k, p in parts.items():
        joined = A.minmax_ref(joined, p.columns[1], scaled[k])
    return A.ensemble(joined, scaled).select(*ID, *[c for k, p in parts.items() for c in (p.columns[1], scaled[k])], "ensemble_score")


@register("ml_supervised_leaderboard")
def ml_supervised_leaderboard(t):
    """ML14 logistic regression, ML15 random forest, ML16 gradient-boosted
    trees (class-balanced) evaluated on test at their best-F1 validation
    threshold (DP19–DP21, DP23)."""
    x = _anomaly_vectors(t)
    train = x.filter(F.col("split") == "train")
    rows = []
    for kind in ("logit", "rf", "gbt"):
        m = M.fit_classifier(train, kind)
        # scores of train rows would not be read
        p = cut_lineage(M.probability(m, x.filter(F.col("split").isin("val", "test")), ["order_id", "split", "is_anomaly", "order_ts"]))
        th = A.choose_threshold(A.threshold_curve(p.filter(F.col("split") == "val"), "score"))
        te = p.filter(F.col("split") == "test").crossJoin(F.broadcast(th.select("threshold")))
        ev = A.evaluate(te, "score", F.col("threshold"), ks=(50,))
        rows.append(ev.select(F.lit(kind).alias("model"), "precision", "recall", "f1", "pr_auc", "roc_auc"))
    from retail_spark.operators.relational import union_all
    return union_all(rows)


@register("ml_feature_importance")
def ml_feature_importance(t):
    """ML17: random-forest feature importances ranked."""
    x = _anomaly_vectors(t)
    m = M.fit_classifier(x.filter(F.col("split") == "train"), "rf")
    return M.importance(m, CA.FEATS)


def _weekly_feats(t):
    return cut_lineage(TS.weekly_features(CT.weekly(t), "section"))


@register("ml_gbt_forecast_metrics")
def ml_gbt_forecast_metrics(t):
    """ML18: global gradient-boosted demand regressor (validation early stop,
    clipped at 0); DP31 metrics per split."""
    f = _weekly_feats(t)
    _, pred = M.gbt_forecast(f, TREE_FEATS)
    p = pred.select("section", "week_start", "split", F.col("quantity").alias("actual"),
                    F.col("prediction").alias("predicted"))
    return TS.forecast_metrics(p, ["split"])


@register("ml_score_next_week")
def ml_score_next_week(t):
    """ML19: latest feature row per section (WN14) scored by the model,
    ≥ 0 and rounded half-even."""
    f = _weekly_feats(t)
    model, _ = M.gbt_forecast(f, TREE_FEATS)
    missing = set(TREE_FEATS) - set(f.columns)
    if missing:
        raise ValueError(f"feature rows lack {sorted(missing)}")
    latest = latest_per(f, "section", "week_start")
    va = VectorAssembler(inputCols=TREE_FEATS, outputCol="features", handleInvalid="keep")
    return (model.transform(va.transform(latest))
            .select("section", "week_start", F.greatest(F.lit(0.0), F.bround("prediction")).alias("next_week")))


@register("ml_additive_forecast")
def ml_additive_forecast(t):
    """ML20: per-section piecewise-linear trend, yearly seasonality and holidays fitted on train weeks, 80 % band."""
    weekly = CT.weekly(t)
    history = weekly.filter("split = 'train'")
    d = AD.design(history, "week_start", CT.HOLIDAYS)
    return AD.forecast(weekly, cut_lineage(AD.fit(history, "section", "week_start", "quantity", d)), "section", d)


@register("ml_additive_forecast_metrics")
def ml_additive_forecast_metrics(t):
    """ML20 + DP31: metrics of the additive forecast by split."""
    return TS.forecast_metrics(ml_additive_forecast(t).filter("split <> 'train'"), ["split"])


@register("ml_injected_anomalies")
def ml_injected_anomalies(t):
    """DP39: deterministic hash-bucketed injection of six anomaly kinds."""
    inj = M.inject(t.sale_lines, 0.02)
    return inj.filter(F.col("anomaly_type").isNotNull()).groupBy("anomaly_type").agg(
        F.countDistinct("order_id").alias("orders"), F.count(F.lit(1)).alias("lines"))
