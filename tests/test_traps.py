"""Hand-made frames for the traps listed in the survey (§7.4) and for the
distributed re-formulations of ordered operators."""

import datetime as dt
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from retail_spark.functions import exprs as X
from retail_spark.operators.ordered import global_row_number, global_running_sum, keyed_clamped_running
from retail_spark.plans import anomaly as A
from retail_spark.plans import customers as C
from retail_spark.plans import recommend as RC
from retail_spark.plans import timeseries as TS
from retail_spark.operators.windows import add_rolling, preferred


def _qcut_scores(values, reverse):
    s = pd.Series(values)
    ranked = s.rank(method="first", ascending=not reverse)
    return pd.qcut(ranked, 5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()


@pytest.mark.parametrize("n", [5, 6, 7, 9, 13, 40])
def test_quintile_matches_pandas_qcut(spark, n):
    rng = np.random.default_rng(n)
    vals = [float(v) for v in rng.integers(0, 4, n)]          # many ties: first-come order matters
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "customer_id long, recency double")
    for reverse in (False, True):
        got = (C.quintile(df, "recency", "customer_id", "s", reverse=reverse)
               .orderBy("customer_id").select("s").toPandas()["s"].tolist())
        assert got == _qcut_scores(vals, reverse)


def test_quintile_small_n_gives_three(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(4)], "customer_id long, recency double")
    got = C.quintile(df, "recency", "customer_id", "s").select("s").toPandas()["s"].tolist()
    assert got == [3, 3, 3, 3]


def test_ntile_differs_for_seven(spark):
    # the survey's example: ntile(5) is not qcut on ranks
    assert _qcut_scores(list(range(7)), False) != [1, 1, 2, 2, 3, 4, 5]


def test_week_starts_on_tuesday(spark):
    days = [dt.date(2024, 1, d) for d in range(1, 15)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = df.select("d", X.week_start_tue("d").alias("w")).toPandas()
    for d, w in zip(got["d"], got["w"]):
        assert w.weekday() == 1 and 0 <= (d - w).days < 7


def _clamp_loop(start, deltas):
    out, lvl = [], start
    for d in deltas:
        lvl = max(0.0, lvl + d)
        out.append(lvl)
    return out


def test_clamped_ledger_dips_and_recovers_across_partitions(spark):
    rows, expected = [], {}
    for key, start in ((1, 5.0), (2, 0.0), (3, 100.0)):
        deltas = [(-3.0 if i % 4 else 7.0) * (1 + (i % 3)) for i in range(200)]
        expected[key] = _clamp_loop(start, deltas)
        rows += [(key, i, d, start) for i, d in enumerate(deltas)]
    df = spark.createDataFrame(rows, "k long, t long, d double, s double").repartition(13)
    spark.conf.set("spark.sql.shuffle.partitions", "17")      # keys spread over many range partitions
    try:
        got = keyed_clamped_running(df, "k", [F.asc("t")], F.col("d"), F.col("s"), "level").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for key, exp in expected.items():
        g = got[got.k == key].sort_values("t")["level"].tolist()
        assert np.allclose(g, exp)


def test_global_row_number_and_running_sum(spark):
    pdf = pd.DataFrame({"id": range(500), "v": [float(i % 7) for i in range(500)]})
    df = spark.createDataFrame(pdf).repartition(9)
    rn = global_row_number(df, [F.desc("v"), F.asc("id")], "rn").toPandas().sort_values("rn")
    exp = pdf.sort_values(["v", "id"], ascending=[False, True])
    assert rn["id"].tolist() == exp["id"].tolist() and rn["rn"].tolist() == list(range(1, 501))
    rs = global_running_sum(df, [F.asc("id")], {"cum": F.col("v")}).toPandas().sort_values("id")
    assert np.allclose(rs["cum"], pdf["v"].cumsum())


def test_position_split_with_half_of_the_rows_at_one_moment(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": rng.permutation(300), "day": np.where(rng.random(300) < 0.5, 9, rng.integers(0, 20, 300))})
    df = spark.createDataFrame(pdf).repartition(7)
    got = A.split_by_position(df, [F.asc("day"), F.asc("id")]).toPandas().sort_values(["day", "id"])
    assert got["split"].tolist() == ["train"] * 210 + ["val"] * 45 + ["test"] * 45


def _greedy_prune(rules, tol=0.10):
    kept, seen = [], {}
    order = sorted(range(len(rules)), key=lambda i: (-rules[i][2], -rules[i][3], i))
    for i in order:
        ant, cons, conf, lift = rules[i]
        red = any(set(a) <= set(ant) and abs(conf - c) / c < tol for a, c in seen.get(cons, []))
        if not red:
            kept.append((tuple(ant), cons))
            seen.setdefault(cons, []).append((ant, conf))
    return set(kept)


def test_prune_join_form_matches_greedy_loop(spark):
    rng = np.random.default_rng(3)
    items = ["a", "b", "c", "d"]
    rules = []
    for x in items:                                   # singles first, as generated
        for y in items:
            if x != y:
                rules.append(([x], y, float(rng.choice([0.2, 0.3, 0.31, 0.5])), float(rng.choice([1.1, 1.3]))))
    for x, y in itertools.combinations(items, 2):
        for z in items:
            if z not in (x, y):
                rules.append(([x, y], z, float(rng.choice([0.2, 0.28, 0.3, 0.45, 0.5])), float(rng.choice([1.1, 1.3]))))
    df = spark.createDataFrame([(a, c, 0.1, conf, lift) for a, c, conf, lift in rules],
                               "antecedent array<string>, consequent string, support double, confidence double, lift double")
    got = {(tuple(r.antecedent), r.consequent) for r in RC.prune(df).collect()}
    assert got == _greedy_prune(rules)


def _auc_brute(y, s):
    pos = [si for yi, si in zip(y, s) if yi == 1]
    neg = [si for yi, si in zip(y, s) if yi == 0]
    tot = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg)
    return tot / (len(pos) * len(neg))


def _ap_brute(y, s):
    pairs = sorted(zip(s, y), key=lambda t: -t[0])
    P = sum(y)
    ap, tp, fp, prev_r = 0.0, 0, 0, 0.0
    for thr in sorted(set(s), reverse=True):
        tp = sum(1 for sc, yy in pairs if sc >= thr and yy == 1)
        fp = sum(1 for sc, yy in pairs if sc >= thr and yy == 0)
        r = tp / P
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    return ap


def test_tie_aware_auc_and_average_precision(spark):
    rng = np.random.default_rng(7)
    s = [float(v) for v in rng.integers(0, 6, 300)]          # heavy ties
    y = [int(v) for v in rng.integers(0, 2, 300)]
    df = spark.createDataFrame([(i, sc, yy, dt.datetime(2020, 1, 1)) for i, (sc, yy) in enumerate(zip(s, y))],
                               "order_id long, score double, is_anomaly int, order_ts timestamp_ntz")
    ev = A.evaluate(df, "score", 3.0, ks=(10,)).first()
    assert math.isclose(ev["roc_auc"], _auc_brute(y, s), rel_tol=1e-9)
    assert math.isclose(ev["pr_auc"], _ap_brute(y, s), rel_tol=1e-9)
    pred = [1 if sc >= 3.0 else 0 for sc in s]
    assert ev["tp"] == sum(p * t for p, t in zip(pred, y))


def test_threshold_curve_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    s = [float(v) for v in rng.random(400).round(2)]
    y = [int(v) for v in rng.integers(0, 2, 400)]
    df = spark.createDataFrame(list(zip(s, y)), "score double, is_anomaly int")
    curve = A.threshold_curve(df, "score").toPandas()
    ths = np.unique(np.quantile(np.array(s), np.linspace(0.01, 0.999, 500)))
    assert len(curve) == len(ths)
    for t, n_alerts in zip(curve.sort_values("threshold")["threshold"], curve.sort_values("threshold")["n_alerts"]):
        assert n_alerts == sum(1 for v in s if v >= t)


def test_wilcoxon_normal_approximation(spark):
    a = [3.0, 1.0, 4.0, 1.5, 5.0, 9.0, 2.0, 6.0, 5.0, 3.5]
    b = [2.0, 1.0, 3.0, 2.5, 4.0, 8.0, 2.5, 4.0, 4.0, 3.0]
    rows = [("m1", i, x) for i, x in enumerate(a)] + [("m2", i, x) for i, x in enumerate(b)]
    per = spark.createDataFrame(rows, "model string, section long, mae double")
    got = TS.wilcoxon(per, "section", "m1", "m2").first()
    d = [x - y for x, y in zip(a, b) if x != y]
    ranks = pd.Series(np.abs(d)).rank(method="average").to_numpy()
    wp = ranks[np.array(d) > 0].sum()
    wm = ranks[np.array(d) < 0].sum()
    n = len(d)
    _, counts = np.unique(np.abs(d), return_counts=True)
    var = n * (n + 1) * (2 * n + 1) / 24 - (counts ** 3 - counts).sum() / 48
    z = (min(wp, wm) - n * (n + 1) / 4) / math.sqrt(var)
    assert got["n"] == n and math.isclose(got["w_plus"], wp) and math.isclose(got["z"], z)


def test_rfm_rule_order(spark):
    df = spark.createDataFrame([(2, 4, 4), (1, 4, 4), (3, 1, 1), (4, 1, 5), (5, 5, 5)], "r int, f int, m int")
    got = [r.s for r in df.select(X.rfm_segment("r", "f", "m").alias("s")).collect()]
    assert got == ["At Risk", "Cannot Lose Them", "Need Attention", "New / Promising", "Champions"]


def test_meal_period_schemes(spark):
    df = spark.createDataFrame([(h,) for h in (None, 5, 6, 15, 16, 22, 23)], "h int")
    seg = [r.m for r in df.select(X.meal_period("h", "segmentation").alias("m")).collect()]
    srv = [r.m for r in df.select(X.meal_period("h", "serving").alias("m")).collect()]
    trn = [r.m for r in df.select(X.meal_period("h", "training").alias("m")).collect()]
    assert seg == ["unknown", "late_night", "morning", "lunch", "dinner", "dinner", "late_night"]
    assert srv == ["late_night", "breakfast", "breakfast", "lunch", "dinner", "late_night", "late_night"]
    assert trn == ["late_night", "late_night", "breakfast", "afternoon", "afternoon", "dinner", "late_night"]


def test_rolling_std_single_row_is_null(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 7.0), ("a", 3, 9.0)], "k string, t int, q double")
    got = add_rolling(df, "k", "t", "q", [4], ("std", "mean")).orderBy("t").collect()
    assert got[0]["rolling_std_4"] is None and got[1]["rolling_std_4"] is None
    assert math.isclose(got[2]["rolling_std_4"], math.sqrt(2.0))


def test_preferred_ties_go_alphabetical(spark):
    df = spark.createDataFrame([(1, "card"), (1, "cash"), (2, "cash"), (2, "card"), (2, "cash")], "c long, m string")
    got = {r.c: r.p for r in preferred(df, "c", "m", name="p").collect()}
    assert got == {1: "card", 2: "cash"}


def test_zero_denominators_and_empty_input(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, None), (3.0, 2.0)], "a double, b double")
    assert [r.x for r in df.select(X.safe_div("a", "b").alias("x")).collect()] == [None, None, 1.5]
    preds = spark.createDataFrame([("m", 0.0, 1.0), ("m", 2.0, 1.0)], "model string, actual double, predicted double")
    m = TS.forecast_metrics(preds, ["model"]).first()
    assert math.isclose(m["mape"], 0.5) and math.isclose(m["wape"], 1.0)
    empty = spark.createDataFrame([], "customer_id long, recency double")
    assert C.quintile(empty, "recency", "customer_id", "s").count() == 0


def test_wall_clock_constants_ignore_session_zone(spark):
    from retail_spark.plans import reporting as R
    df = spark.createDataFrame([(1, dt.datetime(2001, 7, 31, 12, 0), "draft", 1)],
                               "order_id long, created_at timestamp_ntz, status string, table_id long")
    for zone in ("America/New_York", "Asia/Kolkata", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = R.open_age_minutes(df, dt.datetime(2001, 8, 1, 12, 0)).first()["age_minutes"]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert got == 1440, zone


def test_two_item_antecedent_fires_only_on_full_match(spark):
    rules = spark.createDataFrame([(["a", "b"], "c", 0.1, 0.5, 2.0), (["a"], "d", 0.1, 0.4, 1.5)],
                                  "antecedent array<string>, consequent string, support double, confidence double, lift double")
    hist = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "customer_id long, item string")
    got = {(r.customer_id, r.item) for r in RC.recommend_rules(hist, rules, 5).collect()}
    assert got == {(1, "c"), (1, "d"), (2, "d")}


def test_ledger_summary_equals_the_summed_ledger(spark):
    from retail_spark.catalog.inventory import _ledger_summary
    from retail_spark.operators.ordered import keyed_clamped_summary
    rng = np.random.default_rng(8)
    n = 600
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.6, 1, rng.integers(2, 9, n)), "t": rng.integers(0, 50, n), "id": np.arange(n),
                        "delta": rng.integers(-6, 6, n).astype(float)})
    moves = spark.createDataFrame(pdf).repartition(6)
    start = spark.createDataFrame([(k, 5.0 * k) for k in range(1, 7)], "k long, s double")       # keys 7 and 8 start from nothing
    order = [F.col("t"), F.col("id")]
    rows = keyed_clamped_running(moves.join(start, "k", "left"), "k", order, F.col("delta"), F.coalesce(F.col("s"), F.lit(0.0)), "stock_level")
    old = _ledger_summary(rows.withColumnRenamed("s", "start_stock"), "k").toPandas().sort_values("k").reset_index(drop=True)
    new = keyed_clamped_summary(moves, "k", order, F.col("delta"), start, "s").toPandas().sort_values("k").reset_index(drop=True)
    pd.testing.assert_frame_equal(old, new)
    assert new["zero_hits"].sum() > 0


@pytest.mark.parametrize("parts", ["2", "7"])
def test_clamped_summary_moves_rows_once(spark, parts):
    """Few keys over many tasks, missing changes, keys without a start or without changes: as the running ledger, with one
    exchange of the rows and no row written."""


    from retail_spark.operators import ordered as O

    # k 0: missing changes first; k 1: hot; k 3: without a start; k 9: without changes; k 5: falls and stays at nothing
    d = F.when((F.col("k") == 0) & (F.col("t") < 40), None).when(F.col("k") == 5, -1.0).otherwise((F.pmod(F.xxhash64("t", "k"), F.lit(13)) - 6).cast("double"))
    moves = spark.range(4000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.pmod("id", F.lit(7))).cast("long").alias("k"), F.col("id").alias("t")).withColumn("d", d)
    start = spark.createDataFrame([(0, 3.0), (1, 25.0), (2, None), (4, 0.0), (5, 30.0), (6, -4.0), (9, 1.0)], "k long, s double")
    levels = {r["k"]: r["s"] or 0.0 for r in start.collect()}
    want, rows = {}, sorted(((r["k"], r["t"], r["d"]) for r in moves.collect()))
    for k, _, x in rows:
        n, total, low, least, zeros, now = want.get(k, (0, None, None, None, 0, 0.0))
        if x is not None:
            total = (total or 0.0) + x
            c = levels.get(k, 0.0) + total
            low = c if low is None else min(low, c)
            now = max(0.0, c - min(0.0, low))
        want[k] = (n + 1, total, low, now if least is None else min(least, now), zeros + (now <= 1e-6), now)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    written, kept = [], O.stored
    O.stored = lambda df, name="rows", options=None: written.append(df) or kept(df, name, options)
    try:
        got = {r["k"]: r for r in O.keyed_clamped_summary(moves, "k", [F.col("t")], F.col("d"), start, "s").collect()}
    finally:
        O.stored = kept
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got.keys() == want.keys()
    for k, (n, total, _, least, zeros, now) in want.items():
        assert (got[k]["movements"], got[k]["net_change"], got[k]["min_level"], got[k]["zero_hits"], got[k]["final_stock"]) == (n, total, least, zeros, now), k
    assert len(written) == 1
    assert written[0]._jdf.queryExecution().executedPlan().toString().count("rangepartitioning") == 1
    assert written[0].filter("_lows IS NULL").count() < 40 and "Window" not in written[0]._jdf.queryExecution().executedPlan().toString()
