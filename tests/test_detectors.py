"""Detectors against single-process versions written without them."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from retail_spark.plans import anomaly as A
from retail_spark.plans import detectors as D


def rows(spark, x, parts=5):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "order_id long, x array<double>").repartition(parts).cache()


def sample_data(n=1500, d=5, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * np.array([1, 3, 0.2, 1, 1])
    x[: n // 3] += 4
    x[:, 3] = np.round(x[:, 3])                    # ties
    x[: n // 2, 4] = 0.0                           # often constant
    x[:20] *= 6                                    # far out
    return x


def single_forest(x, trees, share, seed):
    """Isolation forest grown tree by tree, depth first, on random subsets."""
    rng = np.random.default_rng(seed)
    n = max(2, round(share * len(x)))
    limit = math.ceil(math.log2(n))

    def expect(m):
        return 0.0 if m <= 1 else 1.0 if m == 2 else 2 * (math.log(m - 1) + 0.5772156649015329) - 2 * (m - 1) / m

    def grow(idx, depth):
        free = [f for f in range(x.shape[1]) if x[idx, f].min() < x[idx, f].max()] if len(idx) > 1 else []
        if depth >= limit or not free:
            return len(idx), depth
        f = free[rng.integers(len(free))]
        at = rng.uniform(x[idx, f].min(), x[idx, f].max())
        return f, at, grow(idx[x[idx, f] <= at], depth + 1), grow(idx[x[idx, f] > at], depth + 1)

    def path(node, v):
        while len(node) == 4:
            node = node[2] if v[node[0]] <= node[1] else node[3]
        return node[1] + expect(node[0])

    total = np.zeros(len(x))
    for _ in range(trees):
        tree = grow(rng.choice(len(x), n, replace=False), 0)
        total += [path(tree, v) for v in x]
    return 2 ** (-total / trees / expect(n))


def ranks(v):
    return np.argsort(np.argsort(v, kind="stable"), kind="stable")


def test_isolation_forest_ranks_as_a_single_process_one(spark):
    x = sample_data()
    df = rows(spark, x)
    got = {r["order_id"]: r["iforest_score"] for r in D.isolation_scores(df, df, keep=["order_id"], trees=100, together=40).collect()}
    want = single_forest(x, 100, 0.6, 7)
    assert np.corrcoef(ranks([got[i] for i in range(len(x))]), ranks(want))[0, 1] >= 0.95
    assert set(np.argsort([-got[i] for i in range(len(x))])[:15]) <= set(range(20))


def test_forest_nodes_hold_their_rows(spark):
    x = sample_data(400)
    df = rows(spark, x)
    f = D.grow_forest(df, "x", "order_id", trees=6, together=4)
    assert f.sample == 240 and (f.depth <= 8).all()
    inner = np.flatnonzero(f.feature >= 0)
    assert (f.size[f.left[inner]] + f.size[f.left[inner] + 1] == f.size[inner]).all() and (f.size[f.left[inner]] > 0).all()
    assert (np.abs(f.size[f.roots] - 240) < 60).all() and len(set(f.size[f.roots].tolist())) > 1
    leaves = np.flatnonzero((f.feature < 0) & (f.depth < 8) & (f.size > 1))
    for t in range(6):                              # a leaf above the limit with several rows holds equal rows only
        at = f.leaf(t, x, np.arange(len(x)))
        assert not set(at) & set(leaves) or all(f.size[i] <= (at == i).sum() for i in set(at) & set(leaves))
    low = D.grow_forest(df, "x", "order_id", trees=6, height=2)
    assert low.depth.max() == 2


def numpy_em(x, centres, iters=100, tol=1e-3):
    r = np.eye(len(centres))[((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)]
    before = None
    for _ in range(iters + 1):
        n = r.sum(0)
        w, mu = n / len(x), r.T @ x / n[:, None]
        var = np.stack([(r[:, c, None] * (x - mu[c]) ** 2).sum(0) / n[c] for c in range(len(n))]) + 1e-6
        p = np.stack([np.log(w[c]) - 0.5 * (np.log(2 * np.pi * var[c]) + (x - mu[c]) ** 2 / var[c]).sum(1) for c in range(len(n))], 1)
        whole = np.log(np.exp(p - p.max(1, keepdims=True)).sum(1)) + p.max(1)
        if before is not None and abs(whole.mean() - before) < tol:
            break
        before, r = whole.mean(), np.exp(p - whole[:, None])
    return w, mu, var, whole


def test_diagonal_mixtures_equal_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal([0, 0, 0], [1, 2, .3], (300, 3)), rng.normal([6, -5, 2], [.5, 1, 1], (200, 3)), rng.normal([-7, 6, 0], 1, (100, 3))])
    df = rows(spark, x)
    found = D.fit_mixtures(df, "x", [(1, 1), (2, 1), (3, 1), (3, 2)])
    one = found[0]
    assert one.means[0] == pytest.approx(x.mean(0)) and one.variances[0] == pytest.approx(x.var(0) + 1e-6)
    assert one.parameters == 6 and found[2].parameters == 20
    three = max(found[2:], key=lambda m: m.log_likelihood)
    w, mu, var, whole = numpy_em(x, np.array([[0, 0, 0], [6, -5, 2], [-7, 6, 0]], float))
    at = np.argsort(three.means[:, 0])
    order = np.argsort(mu[:, 0])
    assert three.means[at] == pytest.approx(mu[order], abs=1e-2) and three.variances[at] == pytest.approx(var[order], rel=2e-2)
    assert three.weights[at] == pytest.approx(w[order], abs=1e-3) and three.log_likelihood == pytest.approx(whole.sum(), rel=1e-4)
    assert three.bic == pytest.approx(20 * math.log(600) - 2 * three.log_likelihood) and three.aic == pytest.approx(40 - 2 * three.log_likelihood)
    assert three.bic < found[1].bic < one.bic
    got = {r["order_id"]: r["s"] for r in df.select("order_id", D.mixture_score(three, F.col("x")).alias("s")).collect()}
    assert [got[i] for i in range(600)] == pytest.approx((-D.log_sum(D.log_densities(three, x))).tolist())


@pytest.mark.parametrize("sizes", [dict(cell_rows=20, probes=1, chunk=8), dict()])
def test_neighbour_distances_are_exact(spark, sizes):
    x = sample_data(700)
    x[100:300] = x[100]                             # a large group of equal rows
    ref, df = rows(spark, x), rows(spark, np.concatenate([x[::7] + 0.01, [[50.0] * 5], x[100:101]]))
    got = {r["order_id"]: r["distances"] for r in D.neighbour_distances(df, ref, 50, keep=["order_id"], **sizes).collect()}
    q = np.concatenate([x[::7] + 0.01, [[50.0] * 5], x[100:101]])
    want = np.sort(np.sqrt(((q[:, None] - x[None]) ** 2).sum(2)), axis=1)[:, :50]
    assert len(got) == len(q) and all(got[i] == pytest.approx(want[i].tolist(), abs=1e-9) for i in range(len(q)))
    few = D.neighbour_distances(df, ref.limit(3), 5, keep=["order_id"]).first()
    assert len(few["distances"]) == 3


def test_choice_on_validation(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.1).astype(int)
    cols = {"bad": rng.random(400), "good": y + 0.4 * rng.random(400), "same": y * 5 + 2 * rng.random(400), "flat": np.ones(400)}
    df = spark.createDataFrame([(int(a), *map(float, r)) for a, r in zip(y, zip(*cols.values()))], "is_anomaly int, bad double, good double, same double, flat double")
    quality = D.validation_quality(df, list(cols))
    for (recall, precision, f1), v in zip(quality, cols.values()):
        z = (v - v.min()) / (v.max() - v.min()) if v.max() > v.min() else v * 0
        best = None
        for t in np.unique(np.quantile(z, np.linspace(0.01, 0.999, 500))):
            hit, n = int(y[z >= t].sum()), int((z >= t).sum())
            p, r = (hit / n if n else 0), hit / y.sum()
            score = (2 * p * r / (p + r) if p + r else 0, r, p)
            best = max(best, score) if best else score
        assert (f1, recall, precision) == pytest.approx(best)
    assert D.best_on_validation(df, list(cols)) == 1


def test_ensemble_of_four_chosen_scores(spark):
    """The registered query against its own parts and numpy: scaling by validation bounds, weights, PCA and density values."""
    import __spark_entry__ as E
    from retail_spark.catalog import anomaly as CA
    from retail_spark.sources.tables import Tables
    from tests.conftest import SF_SMALL

    got = E.queries()["ml_ensemble_scores"](spark, SF_SMALL).toPandas().set_index("order_id")
    val = got[got["split"] == "val"]
    total = 0
    for part, column, weight in (("density", "density_score", .5), ("pca", "pca_error", .2), ("knn", "knn_score", .2), ("rules", "rule_score", .1)):
        lo, hi = val[column].min(), val[column].max()
        want = np.clip((got[column] - lo) / (hi - lo), 0, 1) if hi - lo >= 1e-12 else 0 * got[column]
        assert got[f"{part}_norm"].to_numpy() == pytest.approx(want.to_numpy(), abs=1e-9)
        total = total + weight * want
    assert got["ensemble_score"].to_numpy() == pytest.approx(total.to_numpy(), abs=1e-9)
    frame = CA.frame(Tables(spark, SF_SMALL)).toPandas().set_index("order_id").loc[got.index]
    raw = frame[CA.FEATS].fillna(0).to_numpy(float)
    fit = ((frame["split"] == "train") & (frame["is_anomaly"] == 0)).to_numpy()
    spread = raw[fit].std(axis=0, ddof=1)
    x = np.where(spread > 0, (raw - raw[fit].mean(axis=0)) / np.where(spread > 0, spread, 1), 0)
    values, vectors = np.linalg.eigh(np.cov(x[fit].T))
    share = np.cumsum(values[::-1]) / values.sum()
    errors = []
    for target in (.8, .9, .95, .99):
        v = vectors[:, ::-1][:, :int(np.searchsorted(share, target) + 1)]
        errors.append((((x - x[fit].mean(0)) - (x - x[fit].mean(0)) @ v @ v.T) ** 2).mean(axis=1))
    assert any(got["pca_error"].to_numpy() == pytest.approx(e, abs=1e-6) for e in errors)
    near = np.sort(np.sqrt(((x[:, None] - x[fit][None]) ** 2).sum(2)), axis=1)
    assert any(got["knn_score"].to_numpy() == pytest.approx(near[:, :k].mean(axis=1), abs=1e-6) for k in (5, 10, 20, 35, 50))


# -- order features -----------------------------------------------------------


def _sale_lines(spark, n=3000):
    rng = np.random.default_rng(11)
    order = rng.integers(0, 700, n)
    item = np.where(rng.random(n) < 0.4, 3, rng.integers(0, 90, n))
    pdf = pd.DataFrame({
        "order_id": order, "line_number": np.arange(n) % 7 + 1, "item_id": pd.array(np.where(rng.random(n) < 0.02, None, item), dtype="Int64"),
        "order_ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(order % 40, unit="D"), "cashier_id": ["c" + str(o % 4) for o in order],
        "customer_id": order % 50, "payment_method": ["p" + str(o % 3) for o in order], "category": ["k" + str(i % 6) for i in item],
        "quantity": rng.integers(1, 9, n).astype(float), "price": np.round(rng.random(n) * 20, 2), "discount_rate": rng.integers(0, 5, n) / 10,
        "is_voided": rng.random(n) < 0.2})
    pdf["line_total"] = pdf["price"] * pdf["quantity"]
    return spark.createDataFrame(pdf).withColumn("order_date", F.to_date("order_ts")).repartition(5).cache()


def _feature_rows(df):
    return df.toPandas().sort_values(["order_id"]).reset_index(drop=True)


def test_order_features_do_not_depend_on_how_items_are_gathered(spark):
    lines = _sale_lines(spark)
    whole, spread = _feature_rows(A.order_features(lines)), _feature_rows(A.order_features(lines, hot_rows=200))
    assert 3 in A.hot_items(lines, 200) and A.hot_items(lines) == []
    assert list(whole.columns) == list(spread.columns) and len(whole) == len(spread)
    for c in whole.columns:
        if whole[c].dtype == float:
            np.testing.assert_allclose(whole[c], spread[c], rtol=1e-9, atol=1e-9)
        else:
            assert whole[c].astype(str).tolist() == spread[c].astype(str).tolist(), c
    pdf = lines.toPandas()
    items = pdf.groupby("order_id")["item_id"].nunique().sort_index()
    assert whole["n_unique_items"].tolist() == items.tolist()
    day = pdf.dropna(subset=["item_id"]).groupby(["item_id", "order_date"])["quantity"].sum()
    mean, std = day.groupby("item_id").mean(), day.groupby("item_id").std()
    z = [0.0 if pd.isna(i) or not std[i] > 0 else (day[i, d] - mean[i]) / std[i] for i, d in zip(pdf["item_id"], pdf["order_date"])]
    np.testing.assert_allclose(whole["mean_demand_zscore"], pd.Series(z).groupby(pdf["order_id"]).mean().sort_index(), rtol=1e-9, atol=1e-9)


def test_lines_move_twice_at_most_for_order_features(spark):
    """A shuffle by item and one by order; sets and item-day tables used to add five more."""
    plan = A.order_features(_sale_lines(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "collect_set" not in plan


def test_split_by_key_cuts_equal_keys_at_the_position(spark):
    df = spark.createDataFrame([(None if i < 3 else i // 8, i % 2) for i in range(100)], "ts int, id int").repartition(4)
    got = A.split_by_key(df, ["ts", "id"]).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 70, "val": 15, "test": 15}
    single = spark.createDataFrame([(None if i < 3 else i // 2, i) for i in range(99)], "ts int, id int").repartition(4)
    a = A.split_by_key(single, ["ts", "id"]).orderBy("ts", "id").toPandas()["split"].tolist()
    assert a == ["train"] * 69 + ["val"] * 15 + ["test"] * 15


def test_negatives_take_positives_from_the_own_items(spark):
    """An order's rows are sorted for no join with themselves."""
    from retail_spark.plans import models as M
    pos = spark.createDataFrame([(o, i) for o in range(40) for i in range(o % 5 + 1)], "order_id long, item_idx int")
    neg = M.negatives(pos, 6)
    assert "Join" not in neg._jdf.queryExecution().optimizedPlan().toString()
    own = {(r[0], r[1]) for r in pos.collect()}
    rows = neg.collect()
    assert not any((r["order_id"], r["item_idx"]) in own for r in rows)
    assert len(rows) == sum(min(2, 6 - (o % 5 + 1)) * (o % 5 + 1) for o in range(40))


def test_item_statistics_share_one_sort(spark):
    """Median, day sums and their mean and deviation used to sort an item's lines more than once."""
    plan = A.line_context(_sale_lines(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1
    rows_ = [(o, o % 3, None if o % 7 == 0 else o % 5, float(o)) for o in range(60)] + [(o, None, 1, 2.0) for o in range(3)]
    lines = spark.createDataFrame([(o, i, None if d is None else d, p, 1.0 + o % 2, 0.1) for o, i, d, p in rows_],
                                  "order_id int, item_id int, order_date int, price double, quantity double, discount_rate double")
    got = A.line_context(lines).toPandas()
    for item, g in got[got["item_id"].notna()].groupby("item_id"):
        days = g.groupby("order_date", dropna=False)["quantity"].sum()
        assert g["item_median_price"].tolist() == [g["price"].median()] * len(g)
        assert g["item_mean_daily_quantity"].tolist() == pytest.approx([days.mean()] * len(g))
        assert g["item_std_daily_quantity"].tolist() == pytest.approx([days.std()] * len(g))
        dated = g[g["order_date"].notna()]
        assert dated["item_daily_quantity"].tolist() == [days[d] for d in dated["order_date"]]
        assert g[g["order_date"].isna()]["item_daily_quantity"].isna().all()
    assert got[got["item_id"].isna()][["item_median_price", "item_mean_daily_quantity", "item_daily_quantity"]].isna().all().all()


@pytest.mark.parametrize("part", ["scores", "robust", "types"])
def test_frame_holds_what_is_read(spark, part):
    """The frame of a few columns has the whole frame's rows, and its written rows hold no others (all were written before)."""
    from retail_spark.catalog import anomaly as CA
    from retail_spark.sources.tables import Tables
    from tests.conftest import SF_SMALL

    t = Tables(spark, SF_SMALL)
    columns = {"scores": CA.SCORED_COLUMNS, "robust": ["order_id", "is_anomaly", "split", *CA.FEATS],
               "types": ["order_id", "anomaly_type", "void_line_rate", "cashier_void_rate", "basket_vs_customer"]}[part]
    few = CA.frame(t, ["cashier_id", *columns])
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "avg_item_price" not in plan and "Scan ExistingRDD[order_id" not in plan
    whole = CA.frame(t)
    assert [c for c in whole.columns if c in few.columns] == few.columns
    a, b = [f.select(*columns).toPandas().sort_values("order_id").reset_index(drop=True) for f in (few, whole)]
    pd.testing.assert_frame_equal(a, b, rtol=1e-9)


def test_scores_are_not_written_again(spark):
    """Scored rows are expressions over the frame's written rows; they used to be a checkpoint of all columns."""
    from retail_spark.catalog import anomaly as CA
    from retail_spark.sources.tables import Tables
    from tests.conftest import SF_SMALL

    s = CA.scored(Tables(spark, SF_SMALL)).select("order_id", "density_score")
    plan = s._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("ReadSchema: "):].split("\n")[0]
    assert "total_amount" in read and "anomaly_type" not in read and "is_odd_hour" not in read


@pytest.mark.parametrize("sizes", [dict(cell_rows=20, probes=1, chunk=8, group_rows=10, block_rows=64), dict(cell_rows=20, probes=2, group_rows=40)])
def test_neighbours_beyond_the_first_cells_meet_in_blocks(spark, sizes, monkeypatch):
    """Rows that the first cells do not settle used to be sent to every cell that could matter, round by round."""
    x = sample_data(700, seed=5)
    x[100:300] = x[100]
    x[300:310] *= 1e4                               # far away: few rows near, limits in large squares
    q = np.concatenate([x[::7] + 0.01, [[50.0] * 5], x[100:101]])
    asked, ask = [], D._ask
    monkeypatch.setattr(D, "_ask", lambda *a: asked.append(1) or ask(*a))
    got = {r["order_id"]: r["distances"] for r in D.neighbour_distances(rows(spark, q), rows(spark, x), 50, keep=["order_id"], **sizes).collect()}
    want = np.sort(np.sqrt(((q[:, None] - x[None]) ** 2).sum(2)), axis=1)[:, :50]
    assert len(asked) == 1 and len(got) == len(q)
    assert all(got[i] == pytest.approx(want[i].tolist(), rel=1e-9, abs=1e-9) for i in range(len(q)))


def test_fits_of_many_passes_read_packed_rows(spark, monkeypatch):
    """Each pass used to turn every row into Arrow again."""
    seen = []
    for name in ("_mixture_sums", "_bounds"):
        once = getattr(D, name)
        monkeypatch.setattr(D, name, lambda data, *a, once=once: seen.append(data.dtypes) or once(data, *a))
    df = rows(spark, sample_data(300, seed=6))
    D.fit_mixtures(df, "x", [(2, 1)], max_iter=2)
    D.grow_forest(df, "x", "order_id", trees=2, height=2)
    assert seen and all(kind == "binary" for dtypes in seen for _, kind in dtypes)


def test_split_is_not_worked_out_for_those_that_do_not_read_it(spark, monkeypatch):
    from retail_spark.catalog import anomaly as CA
    from retail_spark.plans import anomaly as A
    from retail_spark.sources.tables import Tables
    from tests.conftest import SF_SMALL

    whole = CA.frame(Tables(spark, SF_SMALL))
    want = {r["cashier_id"]: r for r in whole.groupBy("cashier_id").agg(F.count("*").alias("n"), F.avg("is_anomaly").alias("a")).collect()}
    monkeypatch.setattr(A, "split_by_key", lambda *a: pytest.fail("positions were looked up"))
    got = CA.cashier_risk(Tables(spark, SF_SMALL)).collect()
    assert {r["cashier_id"]: (r["orders"], r["anomaly_rate"]) for r in got} == {c: (r["n"], pytest.approx(r["a"])) for c, r in want.items()}


def test_a_row_asks_only_cells_whose_ball_and_box_it_reaches(monkeypatch):
    from retail_spark.plans import detectors as D

    monkeypatch.setattr(D, "SLICE", 64)
    rng = np.random.default_rng(4)
    cell = np.repeat(np.arange(20), 40)
    centres = rng.standard_normal((20, 4)) * 3
    y = centres[cell] + rng.standard_normal((800, 4)) * np.array([2.0, 0.01, 0.01, 0.01])        # long and flat: balls overlap, boxes do not
    n, x = rng.integers(1, 4, 800), y[rng.choice(800, 300)] + 0.01
    radius = np.array([np.sqrt(((y[cell == c] - centres[c]) ** 2).sum(axis=1)).max() for c in range(20)])
    far = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    want = [np.sort(np.repeat(f, n))[:10] for f in far]
    seen, nonzero = [], np.nonzero
    monkeypatch.setattr(D.np, "nonzero", lambda a: (seen.append(a.size) if a.ndim == 2 else None) or nonzero(a))
    for bound in (np.full(300, np.inf), np.array([w[-1] for w in want])):
        seen.clear()
        got = D._nearest(x, bound, y, n, cell, centres, radius, 10)
        assert all(a == pytest.approx(b) for a, b in zip(got, want))
    assert sum(seen) < 300 * 800 / 3                  # with a bound, of 240,000 pairs
