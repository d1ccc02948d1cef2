"""The stock ledger stream against a single pass per product, with one product holding half of the rows."""

import numpy as np
import pandas as pd
import pytest

from retail_spark.streaming import jobs


@pytest.mark.parametrize("files", [1, 4])
def test_ledger_stream_with_a_hot_product(spark, tmp_path, files):
    rng = np.random.default_rng(8)
    n = 6000
    df = pd.DataFrame({"product_id": np.where(rng.random(n) < 0.5, 1, rng.integers(2, 40, n)), "ts": np.arange(n) // 3, "order_id": rng.integers(0, 9, n),
                       "line_number": rng.integers(1, 7, n), "supplier_id": np.arange(n), "delta": rng.integers(-40, 39, n).astype(float),
                       "amount": 1.0, "flag": "N"})
    for k, part in enumerate(np.array_split(df, files)):     # times do not go back from file to file
        part.to_parquet(tmp_path / f"p{k}.parquet")
    products = spark.createDataFrame([(i, float(100 + i)) for i in range(30)], "product_id long, stock_quantity double")
    schema = "product_id long, ts long, order_id long, line_number long, supplier_id long, delta double, amount double, flag string"
    moves = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = {r["product_id"]: tuple(r)[1:] for r in jobs.stock_ledger(moves, products).collect()}
    want = {}
    for p, g in df.sort_values(jobs.ORDER_COLS).groupby("product_id"):
        level, levels, alerts = (100.0 + p if p < 30 else 0.0), [], 0
        for d in g["delta"]:
            ahead, level = level, max(0.0, level + d)
            alerts += level <= 100 < ahead
            levels.append(level)
        want[p] = (len(levels), level, min(levels), sum(v <= 1e-6 for v in levels), alerts)
    assert got == want
