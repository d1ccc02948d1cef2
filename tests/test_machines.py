"""Factorisation machines by packed passes against MLlib's."""

import numpy as np
import pytest
from pyspark.ml.classification import FMClassifier
from pyspark.sql import functions as F

from retail_spark.plans import machines as MA
from retail_spark.plans import models as M


def _rows(spark, n=250, seed=3):
    rng = np.random.default_rng(seed)
    made = [(int(i), str(rng.integers(9)), str(rng.integers(5)), rng.choice(["a", "b", None]), float(rng.integers(0, 3)) / 2, float(rng.random() < 0.4))
            for i in range(n)]
    return spark.createDataFrame(made, "order_id long, customer string, itm string, meal string, hour double, label double").repartition(3)


@pytest.mark.parametrize("buckets", [64, 4])               # four buckets: several columns meet in one
def test_machines_equal_mllib(spark, monkeypatch, buckets):
    monkeypatch.setattr(MA, "PASSES", 4)
    x = _rows(spark)
    cols = ["customer", "itm", "meal", "hour"]
    x = M.hashed(M.hashed(x, cols[:2], "few", buckets), cols, "all", buckets).cache()
    few, every = MA.fit_machines(x, ["few", "all"])
    for col, got in (("few", few), ("all", every)):
        want = FMClassifier(featuresCol=col, factorSize=20, stepSize=0.05, regParam=0.001, maxIter=4, seed=42).fit(x)
        assert got.factors == pytest.approx(want.factors.toArray(), abs=1e-9)
        assert got.linear == pytest.approx(want.linear.toArray(), abs=1e-9)
        assert got.intercept == pytest.approx(want.intercept, abs=1e-9)
        scores = {r["order_id"]: r["score"] for r in MA.with_raw(x, col, got, ["order_id"]).collect()}
        assert all(scores[r["order_id"]] == pytest.approx(r["probability"][1]) for r in want.transform(x).collect())


def test_configurations_share_passes(spark, monkeypatch):
    monkeypatch.setattr(MA, "PASSES", 3)
    seen, once = [], MA._gradients
    monkeypatch.setattr(MA, "_gradients", lambda blocks, machines: seen.append(len(machines)) or once(blocks, machines))
    got = M.fm_compare(_rows(spark), {"one": [], "two": ["meal"]}).collect()
    assert seen == [2, 2, 2] and [r["context_columns"] for r in got] == [0, 1]


def test_classifiers_fit_in_no_more_tasks_than_run_at_once(spark, monkeypatch):
    """Each task of a forest's level sends the sums of all open nodes."""
    from pyspark.ml.functions import array_to_vector

    seen = []
    monkeypatch.setattr(M.RandomForestClassifier, "fit", lambda self, df: seen.append((df.rdd.getNumPartitions(), df.count())))
    train = spark.range(500).select((F.col("id") % 5 == 0).cast("int").alias("is_anomaly"), array_to_vector(F.array(F.col("id").cast("double"))).alias("features"))
    M.fit_classifier(train.repartition(40), "rf")
    assert seen[0][0] <= spark.sparkContext.defaultParallelism and seen[0][1] == 500


@pytest.mark.parametrize("buckets", [64, 8])               # eight buckets: an item's entry often meets another column's
def test_machines_of_contexts_and_items_equal_mllib(spark, monkeypatch, buckets):
    """A block holds an order's context once for all its rows, and few numbers for a row."""
    monkeypatch.setattr(MA, "PASSES", 4)
    x = _rows(spark, 600)
    x = x.unionAll(x.limit(200)).repartition(2)             # equal rows
    cols = ["customer", "itm", "meal", "hour"]
    x = M.hashed(M.hashed(x, cols, "all", buckets), ["itm"], "item", buckets).cache()
    got = MA.fit_machines(x, ["all"], parts=["item"])[0]
    want = FMClassifier(featuresCol="all", factorSize=20, stepSize=0.05, regParam=0.001, maxIter=4, seed=42).fit(x)
    assert got.factors == pytest.approx(want.factors.toArray(), abs=1e-9)
    assert got.linear == pytest.approx(want.linear.toArray(), abs=1e-9)
    assert got.intercept == pytest.approx(want.intercept, abs=1e-9)


def test_slopes_of_few_and_of_most_pairs_are_the_same():
    rng = np.random.default_rng(2)
    m = MA.Machine(rng.standard_normal((50, 20)), rng.standard_normal(50), 0.3)
    ci, cv, ii, iv = rng.integers(0, 50, (40, 3)), rng.random((40, 3)), rng.integers(0, 50, (40, 1)), np.ones((40, 1))
    cell = np.flatnonzero(np.eye(40).ravel())               # few of the 1600 pairs
    parts = MA._part(MA._table(m), ci, cv), MA._part(MA._table(m), ii, iv)
    few = MA._slopes(m, *parts, cell, np.ones(40), np.zeros(40))
    every = MA._slopes(m, *parts, np.arange(1600), np.eye(40).ravel(), np.zeros(1600))
    assert all(a == pytest.approx(b) for a, b in zip(few, every))


def test_blocks_are_small_and_read_a_few_at_a_time(spark, monkeypatch):
    import glob

    import pyarrow.parquet as pq

    monkeypatch.setattr(MA, "PACK", 500)
    monkeypatch.setattr(MA, "_GROUPS", MA._GROUPS | {"parquet.block.size": "20000"})
    x = spark.range(40_000, numPartitions=1).select(F.col("id").cast("string").alias("customer"), (F.col("id") % 7).cast("string").alias("itm"), F.lit(1.0).alias("label"))
    x = M.hashed(M.hashed(x, ["customer", "itm"], "all"), ["itm"], "item")
    blocks = MA._packed(x, ["all"], "label", ["item"])
    sizes = [len(v) for r in blocks.drop("size").collect() for v in r]
    assert sum(sizes) < 40_000 * 12                         # of two entries and a label: 32 bytes as plain numbers
    files = [pq.ParquetFile(f.removeprefix("file:")) for f in blocks.inputFiles()]
    groups = [f.metadata.row_group(i) for f in files for i in range(f.num_row_groups)]
    assert len(groups) > 5 and max(g.total_byte_size for g in groups) < 100_000


def test_only_scores_that_are_read_are_worked_out(spark, monkeypatch):
    from pyspark.sql import functions as F

    from retail_spark.catalog import models as CM

    x = spark.range(60).select(F.col("id").alias("order_id"), F.when(F.col("id") < 42, "train").when(F.col("id") < 51, "val").otherwise("test").alias("split"),
                               (F.col("id") % 3 == 0).cast("int").alias("is_anomaly"), F.current_timestamp().alias("order_ts"))
    seen = []
    monkeypatch.setattr(CM, "_anomaly_vectors", lambda t: x)
    monkeypatch.setattr(M, "fit_classifier", lambda train, kind: seen.append(train.count()))
    monkeypatch.setattr(M, "probability", lambda m, df, keep: seen.append(df.count()) or df.select(*keep, (F.col("order_id") / 60).alias("score")))
    assert CM.ml_supervised_leaderboard(None).count() == 3
    assert seen == [42, 18] * 3
