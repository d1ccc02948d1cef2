"""Hand-made frames for exact quantiles, skewed keys, negatives, nearest neighbours and the corrected rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retail_spark.functions import exprs as X
from retail_spark.operators.ordered import exact_quantile_list, exact_quantiles
from retail_spark.plans import customers as C
from retail_spark.plans import detectors as D
from retail_spark.plans import inventory as INV
from retail_spark.plans import models as M
from retail_spark.plans import recommend as RC
from retail_spark.plans import timeseries as TS


def test_exact_quantiles_with_a_hot_value(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([np.full(500, 3.0), rng.normal(size=501)])            # one value holds half of the rows
    df = spark.createDataFrame([(int(i % 3), float(x), float(-x) if i % 5 else None) for i, x in enumerate(v)], "g int, a double, b double")
    got = exact_quantiles(df, {"q": ("a", 0.73), "m": ("b", 0.5)}).first()
    b = [-x for i, x in enumerate(v) if i % 5]
    assert got["q"] == pytest.approx(np.quantile(v, 0.73)) and got["m"] == pytest.approx(np.median(b))
    by = {r["g"]: r["m"] for r in exact_quantiles(df, {"m": ("a", 0.5)}, ["g"]).collect()}
    assert by == {g: pytest.approx(np.median(v[g::3])) for g in range(3)}
    fr = [0.01, 0.5, 0.73, 0.999, 1.0]
    assert exact_quantile_list(df, "a", fr, "q").first()["q"] == pytest.approx(np.quantile(v, fr).tolist())
    assert exact_quantile_list(df.limit(0), "a", fr, "q").first()["q"] == []


def test_quintile_with_one_value_for_half_of_the_rows(spark):
    vals = [1.0] * 30 + [float(i) for i in range(30)]
    df = spark.createDataFrame(list(enumerate(vals)), "customer_id long, frequency double")
    got = {r["customer_id"]: r["s"] for r in C.quintile(df, "frequency", "customer_id", "s").collect()}
    order = sorted(range(60), key=lambda i: (vals[i], i))
    assert got == {c: max(1, int(np.ceil(k * 5 / 59))) for k, c in enumerate(order)}


def test_churn_risk_has_the_visit_gap_arm(spark):
    base = dict(monetary=1.0, frequency=1, recency=1, rfm_value_tier="Low-Value", rfm_segment="Others", avg_discount_pct=0.0,
                avg_basket_size=1.0, weekend_order_rate=0.0, segment_name="x", customer_tenure_days=1)
    rows = [dict(base, customer_id=i) for i in range(7)] + [dict(base, customer_id=9, recency=300, customer_tenure_days=900)]
    got = {(r["customer_id"], r["target_group"]) for r in C.target_audiences(spark.createDataFrame(rows)).collect()}
    assert (9, "Churn Risk") in got


def test_metrics_are_fractions(spark):
    m = TS.forecast_metrics(spark.createDataFrame([("a", 10.0, 5.0), ("a", 0.0, 5.0)], "model string, actual double, predicted double"), ["model"]).first()
    assert m["mape"] == pytest.approx(0.5) and m["smape"] == pytest.approx((5 / 7.5 + 5 / 2.5) / 2)


def test_baselines_come_from_train_weeks_only(spark):
    weeks = [("s", i, "train" if i < 6 else "val" if i < 9 else "test", float(i)) for i in range(12)]
    df = spark.createDataFrame(weeks, "section string, w int, split string, quantity double").withColumn("week_start", F.expr("date_add(date'2020-01-07', w * 7)"))
    got = {r["w"]: r for r in TS.naive_forecasts(df, "section").collect()}
    assert set(got) == set(range(6, 12)) and all(r["pred_mean"] == 2.5 and r["pred_last"] == 5.0 for r in got.values())
    assert [got[w]["pred_seasonal_4"] for w in range(6, 12)] == [2.0, 3.0, 4.0, 5.0, 2.0, 3.0]
    assert [got[w]["pred_seasonal_52"] for w in range(6, 12)] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]     # six weeks, tiled whole


def test_shortage_is_rounded(spark):
    fc = spark.createDataFrame([(1, 2.5, 1.0), (2, 3.4, 1.0)], "product_id int, forecast double, avg_price double")
    recipe = spark.createDataFrame([(1, 7, 0.333), (2, 7, 1.0)], "product_id int, ingredient_id int, quantity_needed double")
    ing = spark.createDataFrame([(7, "flour", "kg", 1.04, 2.555)], "ingredient_id int, ingredient_name string, unit string, current_stock double, cost_per_unit double")
    r = INV.ingredient_shortages(fc, recipe, ing).first()
    assert (r["need"], r["shortage"], r["cost_impact"], r["status"]) == (3.7, 2.7, 6.9, "CRITICAL")      # 2 and 3 servings
    text = INV.top_consumers(fc, recipe, spark.createDataFrame([(1, "A"), (2, "B")], "product_id int, product_name string"), ing).first()["top_consumers"]
    assert text == "B (3.0kg), A (0.7kg)"


def test_rule_sentence(spark):
    row = spark.range(1).select(X.explain_rule(F.lit("Tea"), F.lit("Cake"), F.lit(0.456), F.lit(1.234)).alias("t")).first()
    assert row["t"] == "Customers who buy Tea also buy Cake (46% confidence, 1.2x lift)"


def test_negatives_are_complete(spark):
    pos = spark.createDataFrame([(o, i) for o in range(40) for i in range(o % 7)] + [(99, i) for i in range(6)], "order_id int, item_idx int")
    own, got = {}, {}
    for r in pos.collect():
        own.setdefault(r["order_id"], set()).add(r["item_idx"])
    for r in M.negatives(pos, 7).collect():
        got.setdefault((r["order_id"], r["positive_idx"]), []).append(r["item_idx"])
    for (o, p) in [(o, p) for o, s in own.items() for p in s]:
        free = 7 - len(own[o])
        draw = got.get((o, p), [])
        assert len(draw) == len(set(draw)) == min(2, free) and not set(draw) & own[o] and all(0 <= x < 7 for x in draw)


def test_nearest_neighbours_reach_the_exact_ones(spark):
    rng = np.random.default_rng(2)
    ref, q = rng.normal(size=(1500, 4)), rng.normal(size=(200, 4))
    ref[:400] = ref[0]                                                         # a group of copies
    frame = lambda x: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "order_id int, x array<double>")
    got = {r["order_id"]: r["knn_score"] for r in D.neighbour_distances(frame(q), frame(ref), 5, keep=["order_id"], cell_rows=100, probes=8, chunk=50)
           .select("order_id", D.mean_of_first(F.col("distances"), 5).alias("knn_score")).collect()}
    exact = np.sort(np.linalg.norm(q[:, None] - ref[None], axis=2), axis=1)[:, :5].mean(axis=1)
    assert all(abs(got[i] - exact[i]) < 1e-6 for i in range(len(q)))


def test_hashed_features_do_not_see_the_label(spark):
    df = spark.createDataFrame([("7", "1", "dinner", 1.0), ("7", "1", "dinner", 0.0)], "customer string, itm string, meal string, label double")
    a, b = M.hashed(df, ["customer", "itm", "meal"]).select("fm_features").collect()
    assert a == b


def test_itemsets_stop_at_three(spark):
    b = spark.createDataFrame([(i, ["a", "b", "c", "d"]) for i in range(4)] + [(9, ["a", "z"])], "order_id int, items array<string>")
    got = {tuple(r["items"]): r["count"] for r in RC.itemsets(b, 0.6).collect()}
    assert got == {("a",): 5, ("b",): 4, ("c",): 4, ("d",): 4, **{p: 4 for p in [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d"),
                                                                                 ("a", "b", "c"), ("a", "b", "d"), ("a", "c", "d"), ("b", "c", "d")]}}


def test_names_by_substring(spark):
    names = spark.createDataFrame([(" Iced Tea ",), ("tea",), ("double espresso shot",), ("water",)], "name string")
    cat = spark.createDataFrame([("iced tea",), ("Espresso",), ("Green Tea",)], "name string")
    got = {r["name"]: (r["match"], r["how"]) for r in RC.resolve_names(names, cat).collect()}
    assert got == {" Iced Tea ": ("iced tea", "exact"), "tea": ("Green Tea", "substring"), "double espresso shot": ("Espresso", "substring")}
