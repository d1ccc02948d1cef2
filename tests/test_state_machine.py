"""Order states: requests taken in order, one order holding half of the log."""

import numpy as np
from pyspark.sql import functions as F

from retail_spark.functions.exprs import ALLOWED_TRANSITIONS
from retail_spark.operators.ordered import keyed_state_machine


def replay(rows, start):
    out, state = [], {}
    for order, at, request in sorted(rows, key=lambda r: r[:2]):
        now = state.get(order, start)
        ok = request in ALLOWED_TRANSITIONS.get(now, [])
        state[order] = request if ok else now
        out.append((order, at, request, now, ok, state[order]))
    return out


def test_hand_made_order_log(spark):
    log = [(1, 1, "in_progress"), (1, 2, "paid"), (1, 3, "served"), (1, 4, "paid"), (1, 5, "cancelled"), (2, 1, "served"), (2, 2, "cancelled"), (2, 3, "in_progress")]
    df = spark.createDataFrame(log, "order_id long, at int, status string")
    got = keyed_state_machine(df, "order_id", [F.asc("at")], "status", ALLOWED_TRANSITIONS, "draft").orderBy("order_id", "at").collect()
    assert [(r["accepted"], r["state_after"]) for r in got] == [
        (True, "in_progress"), (False, "in_progress"), (True, "served"), (True, "paid"), (False, "paid"), (False, "draft"), (True, "cancelled"), (False, "cancelled")]


def test_state_machine_over_many_ranges(spark):
    rng = np.random.default_rng(2)
    names = [*ALLOWED_TRANSITIONS, "draft", "lost"]
    rows = [(7 if rng.random() < 0.5 else int(rng.integers(0, 60)), i, str(rng.choice(names, p=[.1, .3, .25, .1, .05, .1, .1]))) for i in range(4000)]
    for keep in (rows, [r for r in rows if r[0] == 7]):
        df = spark.createDataFrame(keep, "order_id long, at int, status string").repartition(6)
        got = keyed_state_machine(df, "order_id", [F.asc("at")], "status", ALLOWED_TRANSITIONS, "draft").orderBy("order_id", "at").collect()
        assert [tuple(r) for r in got] == replay(keep, "draft")
    empty = keyed_state_machine(df.limit(0), "order_id", [F.asc("at")], "status", ALLOWED_TRANSITIONS, "draft")
    assert empty.count() == 0
