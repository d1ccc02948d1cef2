"""Model fitting on MLlib and grouped pandas (ML1–ML9, ML14–ML20; the detectors of
ML10–ML13 are in ``plans.detectors``), deterministic negative sampling (JN12) and anomaly injection for tests (DP39).

Random choices are replaced by hash-ordered ones (``xxhash64`` with a fixed
seed) so reruns — including task retries after an executor loss — agree.
Driver-side values are limited to model parameters whose size is bounded by
the number of features, clusters or items (centroids, loadings, factors).
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.feature import (PCA, FeatureHasher, Imputer, OneHotEncoder, StandardScaler, StringIndexer,
                                VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retail_spark.plans.detectors import fit_mixtures, mixture_score, with_scores
from retail_spark.plans.machines import Machine, fit_machines, with_raw
from retail_spark.session import cut_lineage

SEED = 42


# ---------------------------------------------------------------------------
# Preprocessing and clustering (ML1–ML5)


def preprocess(df: DataFrame, num: Sequence[str], cat: Sequence[str] = (), out: str = "features"):
    """Median impute + standardise numerics; mode impute, index + one-hot
    categoricals (unseen → extra slot); assemble (ML1).  Returns (model, transformed)."""
    if cat:
        modes = df.agg(*[F.mode(c, True).alias(c) for c in cat]).first().asDict()       # the smallest among the most frequent
        df = df.fillna({c: m for c, m in modes.items() if m is not None}, subset=list(cat))
    imp = Imputer(strategy="median", inputCols=list(num), outputCols=[f"{c}__imp" for c in num])
    num_vec = VectorAssembler(inputCols=[f"{c}__imp" for c in num], outputCol="_num")
    scaler = StandardScaler(inputCol="_num", outputCol="_num_std", withMean=True, withStd=True)
    stages = [imp, num_vec, scaler]
    cat_cols = []
    for c in cat:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep",
                                    stringOrderType="frequencyDesc"))
        cat_cols.append(f"{c}__oh")
    if cat:
        stages.append(OneHotEncoder(inputCols=[f"{c}__idx" for c in cat], outputCols=cat_cols, dropLast=False,
                                    handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=["_num_std"] + cat_cols, outputCol=out))
    model = Pipeline(stages=stages).fit(df)
    return model, model.transform(df)


def kmeans(df: DataFrame, k: int, seeds: Sequence[int] = (SEED, SEED + 1, SEED + 2), col: str = "features"):
    """K-means with k clipped to the row count, best of several seeds by
    inertia; fewer than 2 rows → one cluster (ML2)."""
    n = df.count()
    k = min(k, n)
    if k < 2:
        return None, df.withColumn("cluster", F.lit(0))
    best = None
    for s in seeds:
        m = KMeans(k=k, seed=s, featuresCol=col, predictionCol="cluster", maxIter=50).fit(df)
        if best is None or m.summary.trainingCost < best.summary.trainingCost:
            best = m
    return best, best.transform(df)


def cluster_quality(pred: DataFrame, col: str = "features") -> dict:
    """Inertia, silhouette, Davies–Bouldin and Calinski–Harabasz (ML3) of the
    labels in ``cluster``.  Per-cluster means and scatter are aggregated on the
    executors; only k rows reach the driver."""
    means = pred.groupBy("cluster").agg(Summarizer.mean(F.col(col)).alias("m")).orderBy("cluster").collect()
    numbers, centers = [r["cluster"] for r in means], np.array([r["m"].toArray() for r in means])
    k = len(centers)
    sil = ClusteringEvaluator(featuresCol=col, predictionCol="cluster").evaluate(pred)
    spark = pred.sparkSession
    cdf = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in zip(numbers, centers)],
                                "cluster int, center array<double>")
    p = pred.select("cluster", vector_to_array(col).alias("x")).join(F.broadcast(cdf), "cluster")
    sq = F.aggregate(F.zip_with("x", "center", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    per = (p.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(sq).alias("w"),
                                    F.avg(F.sqrt(sq)).alias("s")).orderBy("cluster").collect())   # k rows
    n_k = np.array([r["n"] for r in per], dtype=float)
    s_k = np.array([r["s"] for r in per])
    w = float(sum(r["w"] for r in per))
    n = n_k.sum()
    g = (centers * n_k[:, None]).sum(axis=0) / n
    b = float((n_k * ((centers - g) ** 2).sum(axis=1)).sum())
    ch = (b / (k - 1)) / (w / (n - k)) if k > 1 and n > k and w > 0 else float("nan")
    dist = np.sqrt(((centers[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2))
    db = np.mean([max((s_k[i] + s_k[j]) / dist[i, j] for j in range(k) if j != i) for i in range(k)])
    return {"k": k, "inertia": w, "silhouette": sil, "davies_bouldin": float(db), "calinski_harabasz": ch}


def k_sweep(df: DataFrame, ks: Sequence[int] = range(2, 11), col: str = "features") -> DataFrame:
    """Quality measures for each k; best by silhouette (ML3)."""
    rows = []
    for k in ks:
        m, p = kmeans(df, k, seeds=(SEED,), col=col)
        if m is not None:
            rows.append(cluster_quality(p, col))
    out = df.sparkSession.createDataFrame(pd.DataFrame(rows))
    w = Window.orderBy(F.desc("silhouette"), F.asc("k"))   # ≤ 9 rows
    return out.withColumn("is_best", F.row_number().over(w) == 1)


def gmm_sweep(df: DataFrame, ks: Sequence[int] = (1, 2, 3, 4, 5), seeds: Sequence[int] = (SEED, SEED + 1, SEED + 2), max_iter: int = 300) -> DataFrame:
    """Diagonal Gaussian mixtures of the array column ``x``, the best of several starts for each k, with log-likelihood,
    AIC, BIC and, from two clusters on, silhouette, Davies–Bouldin and Calinski–Harabasz of the labels (ML4)."""
    found = fit_mixtures(df, "x", [(k, s) for k in ks for s in (seeds if k > 1 else seeds[:1])], max_iter=max_iter)
    rows = []
    for k in ks:
        best = max((m for m in found if len(m.weights) == k), key=lambda m: m.log_likelihood)
        row = {"k": k, "log_likelihood": best.log_likelihood, "aic": best.aic, "bic": best.bic}
        if k > 1:
            scores = F.array(*[-mixture_score(dataclasses.replace(best, weights=best.weights[c:c + 1], means=best.means[c:c + 1],
                                                                  variances=best.variances[c:c + 1]), F.col("x")) for c in range(k)])
            labelled = cut_lineage(df.select("features", (F.array_position(scores, F.array_max(scores)) - 1).cast("int").alias("cluster")))
            if labelled.select("cluster").distinct().count() > 1:
                row |= {c: float(v) for c, v in cluster_quality(labelled).items() if c not in ("k", "inertia")}
        rows.append(row)
    schema = "k int, log_likelihood double, aic double, bic double, silhouette double, davies_bouldin double, calinski_harabasz double"
    return df.sparkSession.createDataFrame([tuple(r.get(c.split()[0]) for c in schema.split(", ")) for r in rows], schema)


def pca2(df: DataFrame, col: str = "features", keep: Sequence[str] = ()) -> DataFrame:
    """2-D PCA projection (ML5)."""
    m = PCA(k=2, inputCol=col, outputCol="_pc").fit(df)
    arr = vector_to_array("_pc")
    return m.transform(df).select(*keep, arr[0].alias("pc1"), arr[1].alias("pc2"))


def pca_fits(fit: DataFrame, targets: Sequence[float], col: str = "features") -> list[np.ndarray]:
    """For each target a projection (d × d) onto the fewest components that reach it as explained variance of the fit
    rows, all from one fit."""
    d = len(fit.select(col).first()[0])
    full = PCA(k=d, inputCol=col, outputCol="_p").fit(fit)
    share, pc = np.cumsum(full.explainedVariance.toArray()), full.pc.toArray()
    chosen = [pc[:, :int(np.searchsorted(share, target) + 1)] for target in targets]
    return [v @ v.T for v in chosen]


def pca_errors(df: DataFrame, projections: Sequence[np.ndarray], names: Sequence[str], keep: Sequence[str], x: str = "x") -> DataFrame:
    """``keep`` of each row with the mean squared reconstruction error of the array column ``x`` under each projection (ML11)."""
    return with_scores(df, x, keep, names, lambda rows: [((rows - rows @ p) ** 2).mean(axis=1) for p in projections])


# ---------------------------------------------------------------------------
# Supervised models (ML14–ML17)


def class_weights(df: DataFrame, label: str = "is_anomaly") -> DataFrame:
    """Balanced weights n / (2 · n_class)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    w = c.crossJoin(n).select(label, (F.col("_n") / (2.0 * F.col("_c"))).alias("weight"))
    return df.join(F.broadcast(w), label)   # two rows


def fit_classifier(train: DataFrame, kind: str, label: str = "is_anomaly", col: str = "features"):
    """Class-balanced logistic regression / random forest / gradient-boosted
    trees (ML14–ML16)."""
    # a task sends the sums of all open nodes at each level: no more tasks than run at once
    train = train.coalesce(train.sparkSession.sparkContext.defaultParallelism)
    tr = class_weights(train, label).select(F.col(label).cast("double").alias("label"), "weight", col)
    if kind == "logit":
        est = LogisticRegression(featuresCol=col, weightCol="weight", maxIter=100, regParam=0.0)
    elif kind == "rf":
        est = RandomForestClassifier(featuresCol=col, weightCol="weight", numTrees=400, seed=SEED, maxDepth=8)
    else:
        est = GBTClassifier(featuresCol=col, weightCol="weight", maxIter=50, maxDepth=4, stepSize=0.1, seed=SEED)
    return est.fit(tr)


def probability(model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias("score"))


def importance(model, names: Sequence[str]) -> DataFrame:
    """Feature importances joined to names, ranked (ML17)."""
    imp = model.featureImportances.toArray()
    rows = sorted(((n, float(v)) for n, v in zip(names, imp)), key=lambda r: -r[1])
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(rows, "feature string, importance double")


# ---------------------------------------------------------------------------
# Recommendation models (ML8, ML9, JN12; ML6 and ML7 are in plans.factors)


def negatives(pos: DataFrame, n_items: int, key: str = "order_id", item: str = "item_idx") -> DataFrame:
    """``min(2, available)`` items for each positive (key, item) that its order does not hold (JN12).

    An order's complement has ``n_items`` − own items; two different ranks in it
    come from hashes of (order, positive) and are turned into items by stepping
    over the order's own items, so nothing is drawn twice or thrown away."""
    own = pos.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(item)).alias("_own"))      # one order's items
    # an order's positives are its own items: no join of the two
    p = own.select(key, "_own", F.explode("_own").alias(item), (F.lit(n_items) - F.size("_own")).alias("_free"))
    first = F.pmod(F.xxhash64(F.lit(SEED), key, item), F.col("_free"))
    step = F.pmod(F.xxhash64(F.lit(SEED + 1), key, item), F.greatest(F.col("_free") - 1, F.lit(1))) + 1
    ranks = (F.when(F.col("_free") <= 0, F.array().cast("array<bigint>")).when(F.col("_free") == 1, F.array(first))
             .otherwise(F.array(first, F.pmod(first + step, F.col("_free")))))
    d = p.select(key, F.col(item).alias("positive_idx"), "_own", F.explode(ranks).alias("_r"))
    idx = F.aggregate("_own", F.col("_r"), lambda at, o: at + F.when(o <= at, 1).otherwise(0))
    return d.select(key, "positive_idx", idx.cast("int").alias(item))


def hashed(df: DataFrame, cols: Sequence[str], out: str = "fm_features", buckets: int = 1 << 14) -> DataFrame:
    """Feature vector of hashed name=value pairs (texts) and named numbers; values are neither indexed nor held on the driver."""
    texts = [c for c in cols if dict(df.dtypes)[c] == "string"]
    df = df.withColumns({c: F.nullif(c, F.lit(0.0)) for c in cols if c not in texts})      # a zero is no entry of the vector
    return FeatureHasher(inputCols=list(cols), outputCol=out, numFeatures=buckets, categoricalCols=texts).transform(df)


def _item_columns(cols: Sequence[str]) -> list[str]:
    """Those that an item has whatever the context."""
    return [c for c in cols if c in ("itm", "category")]


def fm_compare(data: DataFrame, configs: dict[str, list[str]], key: str = "order_id") -> DataFrame:
    """AUC of each context configuration on a fifth of the orders that the fit does not see (ML8)."""
    held = F.pmod(F.xxhash64(F.lit(SEED), key), F.lit(5)) == 0
    rows, vectors = [], [f"fm_{i}" for i in range(len(configs))]
    used = [["customer", "itm", *ctx] for ctx in configs.values()]
    parts = ["_".join(["part", *_item_columns(cols)]) for cols in used]
    x = data.withColumn("held", held)
    for part, cols in dict(zip(parts, map(_item_columns, used))).items():
        x = hashed(x, cols, part)
    for out, cols in zip(vectors, used):
        x = hashed(x, cols, out)
    x = x.select("label", "held", *vectors, *dict.fromkeys(parts))
    models = fit_machines(x.filter(~F.col("held")), vectors, parts=parts)          # all in the same passes
    for out, model, (name, ctx) in zip(vectors, models, configs.items()):
        scored = with_raw(x.filter("held"), out, model, ["label"])
        auc = BinaryClassificationEvaluator(rawPredictionCol="raw", labelCol="label", metricName="areaUnderROC").evaluate(scored)
        rows.append((name, len(ctx), float(auc)))
    return data.sparkSession.createDataFrame(rows, "config string, context_columns int, auc double")


def fm_fit(train: DataFrame, cols: Sequence[str], label: str = "label") -> Machine:
    """Factorisation machine classifier of hashed columns, 20 factors (ML8)."""
    x = hashed(hashed(train, cols), _item_columns(cols), "fm_item")
    return fit_machines(x, ["fm_features"], label, ["fm_item"])[0]


# ---------------------------------------------------------------------------
# Forecasting models (ML18, ML19; ML20 is in plans.additive)


def gbt_forecast(feats: DataFrame, cols: Sequence[str], label: str = "quantity"):
    """Global gradient-boosted regressor on lag / calendar features with a
    validation split for early stopping; predictions clipped at 0 (ML18)."""
    va = VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep")
    tr = va.transform(feats.filter(F.col("split") != "test")).withColumn("is_val", F.col("split") == "val")
    model = GBTRegressor(featuresCol="features", labelCol=label, maxIter=100, maxDepth=5, stepSize=0.05,
                         seed=SEED, validationIndicatorCol="is_val").fit(tr)
    pred = model.transform(va.transform(feats))
    return model, pred.withColumn("prediction", F.greatest(F.lit(0.0), F.col("prediction")))


# ---------------------------------------------------------------------------
# Test data: anomaly injection (DP39)


INJECTION_KINDS = ["high_discount", "void_after_payment", "basket_stuffing", "price_manipulation",
                   "odd_hour", "void_cluster"]


def inject(lines: DataFrame, rate: float = 0.02, key: str = "order_id") -> DataFrame:
    """Deterministic hash-bucketed mutation of whole orders into six labelled
    kinds (DP39): discount 70–95 %, void after payment, basket filled with
    copies, one line's price × 0.25–0.55, odd order time, voided lines."""
    h = F.xxhash64(F.lit(SEED), F.col(key))
    bucket = F.pmod(h, F.lit(10_000)) / 10_000.0
    kind_idx = F.pmod(F.xxhash64(F.lit(SEED + 1), F.col(key)), F.lit(len(INJECTION_KINDS)))
    frac = F.pmod(F.xxhash64(F.lit(SEED + 2), F.col(key)), F.lit(1000)) / 1000.0
    kinds = F.array(*[F.lit(k) for k in INJECTION_KINDS])
    d = (lines.withColumn("anomaly_type", F.when(bucket < rate, kinds[kind_idx.cast("int")]))
         .withColumn("_frac", frac))
    k = F.col("anomaly_type")
    d = (d.withColumn("discount_rate", F.when(k == "high_discount", 0.70 + 0.25 * F.col("_frac"))
                      .otherwise(F.col("discount_rate")))
         .withColumn("is_voided", F.when(k.isin("void_after_payment", "void_cluster"), F.lit(True))
                     .otherwise(F.col("is_voided")))
         .withColumn("price", F.when((k == "price_manipulation") & (F.col("line_number") == 1),
                                     F.col("price") * (0.25 + 0.30 * F.col("_frac"))).otherwise(F.col("price")))
         .withColumn("order_ts", F.when(k == "odd_hour", F.col("order_ts") + F.expr("INTERVAL 3 HOURS"))
                     .otherwise(F.col("order_ts"))))
    stuffed = (d.filter(k == "basket_stuffing")
               .select("*", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("_copy")).drop("_copy"))
    return d.unionByName(stuffed).drop("_frac")
