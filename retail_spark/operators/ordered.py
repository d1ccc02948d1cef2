"""Global order without a single-task window.

``Window.orderBy(...)`` with no ``partitionBy`` moves every row into one task.
That is fine for tables bounded by construction (weeks, sections, one row per
threshold bucket) but not for orders or customers at cluster scale.  The
helpers here give the same results in a distributed way:

1. ``orderBy`` range-partitions the rows (sampled bounds) and sorts each range;
2. each row is tagged with its partition and its position in the partition and
   the result is checkpointed into the shared folder, so every later use sees
   the same assignment even when an executor is lost and work is redone;
3. per-partition counts / sums (one row per partition — bounded by the number
   of partitions) give prefix offsets, which are broadcast back.

A global row number or a running sum is then ``offset + local value``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retail_spark.operators.broadcast import DEFAULT_MAX_ROWS
from retail_spark.operators.quantiles import one_row, quantile_values
from retail_spark.session import cut_lineage, stored

_PART, _MID = "_rs_part", "_rs_mid"
LEFT = 1e-6            # a level up to this is none


def _tagged(df: DataFrame, order: list[Column]) -> DataFrame:
    return (df.orderBy(*order)
            .select("*", F.spark_partition_id().alias(_PART),
                    F.monotonically_increasing_id().alias(_MID)))


def _sorted_tagged(df: DataFrame, order: list[Column]) -> DataFrame:
    return cut_lineage(_tagged(df, order))


def global_row_number(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """1-based position of each row in the total order ``order``."""
    s = stored(_tagged(df, order), "ranked")
    per_part = s.groupBy(_PART).agg(F.count(F.lit(1)).alias("_n"), F.min(_MID).alias("_m0"))
    w = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(_PART, "_m0", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (s.join(F.broadcast(offsets), _PART)   # one row per partition
            .withColumn(name, F.col("_off") + (F.col(_MID) - F.col("_m0")) + 1)
            .drop(_PART, _MID, "_m0", "_off"))


def global_running_sum(df: DataFrame, order: list[Column], values: dict[str, Column],
                       row_number: str | None = None) -> DataFrame:
    """Inclusive running sums of ``values`` (name → expression) in ``order``.

    Optionally also adds a 1-based ``row_number`` column.
    """
    base = df.select("*", *[e.alias(f"_v_{k}") for k, e in values.items()])
    s = _sorted_tagged(base, order)
    local = Window.partitionBy(_PART).orderBy(_MID).rowsBetween(Window.unboundedPreceding, 0)
    aggs = [F.count(F.lit(1)).alias("_n"), F.min(_MID).alias("_m0")]
    aggs += [F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values]
    per_part = s.groupBy(_PART).agg(*aggs)
    w = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        _PART, "_m0", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off_n"),
        *[F.coalesce(F.sum(f"_t_{k}").over(w), F.lit(0)).alias(f"_off_{k}") for k in values])
    out = s.join(F.broadcast(offsets), _PART)
    for k in values:
        out = out.withColumn(k, F.col(f"_off_{k}") + F.sum(f"_v_{k}").over(local))
    if row_number:
        out = out.withColumn(row_number, F.col("_off_n") + (F.col(_MID) - F.col("_m0")) + 1)
    drop = [_PART, _MID, "_m0", "_off_n"] + [f"_v_{k}" for k in values] + [f"_off_{k}" for k in values]
    return out.drop(*drop)


def keyed_clamped_running(df: DataFrame, key: str, order: list[Column], delta: Column,
                          start: Column, name: str = "level", previous: str | None = None) -> DataFrame:
    """Running level per key that never goes below zero (WN24); ``previous`` names a column for the level ahead of each row.

    ``L_t = max(0, L_{t−1} + d_t)`` with ``L_0 = start`` equals
    ``C_t − min(0, min_{k≤t} C_k)`` where ``C`` is the unclamped running sum
    starting at ``start``.  Rows are sorted globally by (key, order), so a hot
    key is spread over many range partitions; each (partition, key) segment
    computes local prefix sums and minima, and one summary row per segment
    (bounded by partitions + keys) carries the offsets between segments.
    """
    base = df.select("*", delta.alias("_d"), start.alias("_s0"))
    s = _sorted_tagged(base, [F.asc(key)] + list(order))
    local = Window.partitionBy(_PART, key).orderBy(_MID)
    run = local.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_ls", F.sum("_d").over(run)).withColumn("_lmin", F.min("_ls").over(run))
    if previous:
        s = s.withColumn("_lahead", F.min("_ls").over(local.rowsBetween(Window.unboundedPreceding, -1)))
    seg = s.groupBy(_PART, key).agg(F.sum("_d").alias("_segsum"), F.min("_ls").alias("_segmin"))
    before = Window.partitionBy(key).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.withColumn("_off", F.coalesce(F.sum("_segsum").over(before), F.lit(0.0)))
    # lowest running sum reached in the earlier segments of the same key
    seg = (seg.withColumn("_segmin_abs", F.col("_off") + F.col("_segmin"))
           .withColumn("_prevmin", F.min("_segmin_abs").over(before)))
    out = s.join(seg.select(_PART, key, "_off", "_prevmin"), [_PART, key])
    c_t = F.col("_s0") + F.col("_off") + F.col("_ls")
    run_min = F.col("_s0") + F.col("_off") + F.col("_lmin")
    run_min = F.least(run_min, F.coalesce(F.col("_s0") + F.col("_prevmin"), run_min))
    if previous:      # least() passes over what is missing, so the first row of a key starts from its own start
        ahead = F.least(F.lit(0.0), F.col("_s0") + F.col("_off") + F.col("_lahead"), F.col("_s0") + F.col("_prevmin"))
        out = out.withColumn(previous, c_t - F.col("_d") - ahead).drop("_lahead")
    return (out.withColumn("running_unclamped", c_t)
            .withColumn(name, F.greatest(F.lit(0.0), c_t - F.least(F.lit(0.0), run_min)))
            .drop(_PART, _MID, "_d", "_s0", "_ls", "_lmin", "_off", "_prevmin"))


def keyed_clamped_summary(df: DataFrame, key: str, order: list[Column], delta: Column, start: DataFrame, at_start: str) -> DataFrame:
    """What ``keyed_clamped_running`` gives in ``order`` (ties by the change), summed up for each key: ``movements``,
    ``net_change``, ``final_stock``, the least level ``min_level`` and ``zero_hits``, the rows after which nothing is left.

    Rows move once, by the range sort, and are not written: a task sums up its keys as they come.  Start levels
    (``at_start`` of ``start``, a row for each key) are sorted along and come ahead of their key's changes, so only a
    task's first key can begin in an earlier task.  Such a segment is summed up for any level that it may start from:
    its sum, its lowest running sum, and (written, in pieces) the running sums that are no higher than any before, as only
    after these nothing can be left."""
    rows = (df.select(F.col(key), F.lit(1).cast("byte").alias("_kind"), *[c.alias(f"_o{i}") for i, c in enumerate(order)], delta.alias("_d"))
            .filter(F.col(key).isNotNull()))
    types = dict(rows.dtypes)
    ahead = start.filter(F.col(key).isNotNull()).select(F.col(key).cast(types[key]), F.lit(0).cast("byte").alias("_kind"),
                         *[F.lit(None).cast(types[f"_o{i}"]).alias(f"_o{i}") for i in range(len(order))], F.col(at_start).cast("double").alias("_d"))
    by = [key, "_kind", *[f"_o{i}" for i in range(len(order))], "_d"]
    ordered = rows.unionByName(ahead).orderBy(*[F.asc(c) for c in by]).select(key, "_kind", "_d", F.spark_partition_id().alias(_PART))
    names = [key, _PART, "_n", "_segsum", "_segmin", "_lead", "_hits", "_s0", "_lows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict = {}                                  # the key that the task is at
        part, first, done = None, True, []

        def segments(some: list[dict]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([x["key"] for x in some], schema_key), pa.array([part] * len(some), pa.int32()),
                                    *[pa.array([x[c] for x in some], t) for c, t in (("n", pa.int64()), ("sum", pa.float64()), ("low", pa.float64()), ("lead", pa.int64()),
                                      ("hits", pa.int64()), ("s0", pa.float64()), ("lows", pa.list_(pa.float64())))]], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            schema_key, part = batch.schema.field(key).type, batch.column(_PART)[0].as_py()
            keys, kinds = batch.column(key), batch.column("_kind").to_numpy()
            known = batch.column("_d").is_valid().to_numpy(zero_copy_only=False)
            change = batch.column("_d").fill_null(0.0).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)])) if batch.num_rows > 1 else np.array([0])
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows]):
                k = keys[a].as_py()
                if not now or now["key"] != k:
                    if now:
                        done.append(now)
                        first = False
                    now = {"key": k, "n": 0, "sum": None, "low": None, "lead": 0, "hits": 0, "s0": None, "lows": None, "settled": not first}
                if kinds[a] == 0:
                    now["s0"], now["settled"] = float(change[a]) if known[a] else 0.0, True
                    a += 1
                if a == b:
                    continue
                now["n"] += b - a
                if now["sum"] is None:                  # missing changes ahead of the first one
                    there = np.flatnonzero(known[a:b])
                    lead = int(there[0]) if len(there) else b - a
                    now["lead"] += lead
                    a += lead
                    if a == b:
                        continue
                sums = (now["sum"] or 0.0) + np.cumsum(change[a:b])
                lows = np.minimum.accumulate(sums)
                if now["low"] is not None:
                    lows = np.minimum(lows, now["low"])
                now["sum"], now["low"] = float(sums[-1]), float(lows[-1])
                if now["settled"]:
                    at = now["s0"] or 0.0
                    now["hits"] += int((at + sums - np.minimum(at + lows, 0.0) <= LEFT).sum())
                else:
                    few = sums[sums - lows <= LEFT]
                    if len(few):
                        yield segments([now | {"n": 0, "sum": None, "low": None, "lead": 0, "hits": 0, "lows": few}])
            if len(done) >= 4096:
                yield segments(done)
                done = []
        if now:
            yield segments([*done, now])

    s = stored(ordered.mapInArrow(run, f"`{key}` {types[key]}, {_PART} int, _n long, _segsum double, _segmin double, _lead long, _hits long, _s0 double, _lows array<double>"), "ledger")
    seg = s.filter(F.col("_lows").isNull()).drop("_lows")                # a row for each key, and for each task
    before = Window.partitionBy(key).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    seg = (seg.withColumn("_s0", F.coalesce(F.max("_s0").over(Window.partitionBy(key)), F.lit(0.0)))
           .withColumn("_off", F.sum("_segsum").over(before))
           .withColumn("_low", F.col("_s0") + F.coalesce("_off", F.lit(0.0)) + F.col("_segmin")))
    lowest = F.least(F.lit(0.0), F.min("_low").over(before))                       # least() passes over nulls
    seg = cut_lineage(seg.withColumn("_base", F.col("_s0") + F.coalesce("_off", F.lit(0.0)) - lowest))
    # changes that are missing leave the level of before, or nothing if there was none
    still = F.when(F.col("_lead") > 0, F.when(F.col("_off").isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.col("_base"))))
    waiting = s.filter(F.col("_lows").isNotNull()).select(key, _PART, "_lows")
    later = (waiting.join(F.broadcast(seg.select(key, _PART, "_base")), [key, _PART]) if seg.count() <= DEFAULT_MAX_ROWS else waiting.join(seg.select(key, _PART, "_base"), [key, _PART]))
    later = later.groupBy(key).agg(F.sum(F.size(F.filter("_lows", lambda x: x + F.col("_base") <= LEFT))).alias("_more"))
    end = F.col("_s0") + F.coalesce("_off", F.lit(0.0)) + F.coalesce("_segsum", F.lit(0.0))
    whole = seg.groupBy(key).agg(
        F.sum("_n").alias("movements"), F.sum("_segsum").alias("net_change"),
        # added up as the lowest sum is, so that a key which ends there has nothing left to the last digit
        F.greatest(F.lit(0.0), F.when(F.sum("_segsum").isNotNull(), F.max_by(end, _PART) - F.least(F.lit(0.0), F.min("_low")))).alias("final_stock"),
        F.min(F.least(F.when(F.col("_segmin").isNotNull(), F.greatest(F.lit(0.0), F.col("_base") + F.col("_segmin"))), still)).alias("min_level"),
        F.sum(F.col("_hits") + F.when(still <= LEFT, F.col("_lead")).otherwise(0)).alias("zero_hits"))
    return (whole.filter("movements > 0").join(later, key, "left")
            .select(key, "movements", "net_change", "final_stock", "min_level", (F.col("zero_hits") + F.coalesce("_more", F.lit(0))).alias("zero_hits")))


def keyed_state_machine(log: DataFrame, key: str, order: list[Column], request: str, allowed: dict[str, list[str]],
                        start: str | None) -> DataFrame:
    """Requests to change a key's state, taken in order: adds ``state_before``, ``accepted`` and ``state_after`` (DP16).

    A request is accepted if the table allows it from the state of that moment, and changes nothing otherwise, so a
    state depends on all requests before it.  Each run of requests is a function from states to states, and functions
    compose: rows are sorted by (key, order) over many tasks, each task gives one function for its first and one for
    its last key (the only ones that other tasks can share), a scan over those summaries (one row for each task) gives
    the state that every task begins with, and the tasks replay their requests.  Without ``start`` a key's first
    request is accepted whatever it is.  Unknown and null requests are rejected.
    """
    states = sorted({*allowed, *[s for to in allowed.values() for s in to], *([start] if start else [])})
    code = {s: i for i, s in enumerate(states)}
    none = len(states)                              # no state yet
    first = code[start] if start else none
    moves = {(code[a], code[b]) for a, to in allowed.items() for b in to} | {(none, i) for i in range(none)}
    columns = log.columns
    s = _sorted_tagged(log, [F.asc(key), *order])

    def requests(batch: pa.RecordBatch) -> tuple[list, list[int]]:
        return batch.column(key).to_pylist(), [code.get(r, -1) for r in batch.column(request).to_pylist()]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, keys, ends = None, [], []             # a function for the first key and for the latest one
        for batch in batches:
            if batch.num_rows:
                here = batch.column(_PART)[0].as_py()
            for k, r in zip(*requests(batch)):
                if not keys or keys[-1] != k:
                    keys, ends = [*keys[:1], k], [*ends[:1], list(range(none + 1))]
                if r >= 0:
                    ends[-1] = [r if (x, r) in moves else x for x in ends[-1]]
        if here is not None:
            yield pa.record_batch([pa.array([here], pa.int32()), pa.array([[str(k) for k in keys]]), pa.array([ends])], names=["part", "keys", "ends"])

    began, held = {}, (None, first)
    for r in sorted(s.select(_PART, key, request).mapInArrow(summarise, "part int, keys array<string>, ends array<array<bigint>>").collect(),
                    key=lambda r: r["part"]):       # one row for each task
        began[r["part"]] = held[1] if held[0] == r["keys"][0] else first
        held = (r["keys"][-1], r["ends"][-1][began[r["part"]] if len(r["keys"]) == 1 else first])

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now = [], first
        for batch in batches:
            if not batch.num_rows:
                continue
            if not last:
                last, now = [batch.column(key)[0].as_py()], began[batch.column(_PART)[0].as_py()]
            before, taken, after = [], [], []
            for k, r in zip(*requests(batch)):
                if k != last[0]:
                    last, now = [k], first
                before.append(now)
                taken.append((now, r) in moves)
                now = r if taken[-1] else now
                after.append(now)
            names = [[None if x == none else states[x] for x in side] for side in (before, after)]
            yield pa.record_batch([*[batch.column(c) for c in columns], pa.array(names[0], pa.string()), pa.array(taken), pa.array(names[1], pa.string())],
                                  names=[*columns, "state_before", "accepted", "state_after"])

    schema = ", ".join(f"`{c}` {t}" for c, t in log.dtypes) + ", state_before string, accepted boolean, state_after string"
    return s.select(*columns, _PART).mapInArrow(replay, schema)


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], by: list[str] | None = None, written: bool = False) -> DataFrame:
    """Exact linear quantiles without a buffer of values: one row (per group of
    ``by``), a column ``name`` for each ``name: (column, fraction)``.

    Whole columns go by bracket refinement (``operators.quantiles``; ``written`` rows are not
    written again).  With groups,
    rows become counts per (group, column, value) with map-side combining, the
    counts are range-sorted for running counts, and the two positions around
    each fraction are picked by a partial aggregate.  No task holds a group's or
    a column's values; a group's totals are joined back (adaptive execution
    splits a hot group).  NULLs are left out, as in ``percentile``.
    """
    by = list(by or [])
    cols = sorted({c for c, _ in wanted.values()})
    if not by:
        asked = {c: [p for col, p in wanted.values() if col == c] for c in cols}
        found = {c: dict(zip(asked[c], v)) for c, v in quantile_values(df, asked, written).items()}
        return one_row(df, {name: found[c].get(p) for name, (c, p) in wanted.items()})
    cells = F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in cols])
    long = df.select(*by, F.explode(cells).alias("_x")).select(*by, "_x._c", "_x._v").filter(F.col("_v").isNotNull())
    counts = long.groupBy(*by, "_c", "_v").agg(F.count(F.lit(1)).alias("_k"))
    run = global_running_sum(counts, [F.asc(c) for c in [*by, "_c", "_v"]], {"_cum": F.col("_k")})
    span = run.groupBy(*by, "_c").agg(F.min(F.col("_cum") - F.col("_k")).alias("_from"), F.sum("_k").alias("_tot"))
    left = run.select(*[F.col(c).alias(f"_l_{i}") for i, c in enumerate(by)], F.col("_c").alias("_lc"), "_v", "_k", "_cum")
    same = F.col("_lc") == F.col("_c")
    for i, c in enumerate(by):
        same = same & F.col(f"_l_{i}").eqNullSafe(F.col(c))
    j = left.join(span, same)
    below, upto = F.col("_cum") - F.col("_k") - F.col("_from"), F.col("_cum") - F.col("_from")
    aggs = []
    for name, (c, p) in wanted.items():
        pos = (F.col("_tot") - 1) * F.lit(float(p))
        mine = F.col("_c") == c
        for end, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            aggs.append(F.max(F.when(mine & (below <= at) & (at < upto), F.col("_v"))).alias(f"_{end}_{name}"))
        aggs.append(F.max(F.when(mine, pos - F.floor(pos))).alias(f"_f_{name}"))
    g = j.groupBy(*by).agg(*aggs)
    return g.select(*by, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in wanted])


def exact_quantile_list(df: DataFrame, c: str, fractions: list[float], name: str) -> DataFrame:
    """One row with ``name``: the exact linear quantiles of ``c`` at many fractions, in their order (none without values)."""
    found = quantile_values(df, {c: fractions})[c]
    return df.sparkSession.range(1).select(F.array(*[F.lit(v) for v in found]).cast("array<double>").alias(name))
