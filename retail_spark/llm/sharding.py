"""Sharding by the minimax contiguous partition of ordered atomic groups.

Rows with equal texts form a group that is never split.  Groups stand in the
order of a digest of their text; the shards are runs of this order.  The
smallest capacity that lets all groups fit into the shards is found by binary
search, each candidate being checked greedily, and the cuts are made under it.

The running size at the end of each group lives in a checkpointed table; the
driver holds a summary of some real group ends (``SUMMARY`` at first) and how
many ends lie hidden between them.  A greedy pass over the known ends alone proves that a
capacity is enough; a pass that may cut anywhere inside a gap with hidden ends
proves that one is not.  Where the two disagree, the gaps with hidden ends that
the cuts can still fall into are summarised anew, ever finer, until both searches
name the same capacity: it is the exact optimum, whatever the number of groups.

Under that capacity the cuts are then spread evenly: each goes to the known end
nearest to an equal share of what remains, as long as the rest still fits.

Edge cases: null texts are a group of their own with no bytes and CRC 0, empty
texts are another; a text of any length is one atom; repeated rows stay
together; fewer groups than shards leave shards empty; an empty table gives an
empty result; only the id and text columns are read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_spark.llm.text_udf import quoted
from retail_spark.operators.ordered import global_running_sum
from retail_spark.session import cut_lineage

SUMMARY = 20_000      # group ends that a summary returns, or 16 times the square of the shards, if that is more
OVERHEAD = 16         # bytes that each row takes besides its text


@dataclass
class Ends:
    """Known group ends (ascending, the last is the total), rows up to each, and the hidden ends just before each:
    how many, all of them after ``since``."""
    at: list[int]
    rows: list[int]
    hidden: list[int]
    since: list[int]

    def fits(self, capacity: int, shards: int) -> bool:
        """Greedy over known ends: true only if the capacity is enough."""
        start = 0
        for _ in range(shards):
            i = bisect_right(self.at, start + capacity) - 1
            if i < 0 or self.at[i] <= start:
                return False
            start = self.at[i]
            if start == self.at[-1]:
                return True
        return False

    def may_fit(self, capacity: int, shards: int) -> bool:
        """Greedy that may cut anywhere among hidden ends: false only if the capacity is not enough."""
        return self.reach(capacity, shards, True)[-1] >= self.at[-1]

    def reach(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        """Where each shard of the greedy pass ends, at least (or at most, if hopeful)."""
        start, out = 0, []
        for _ in range(shards):
            j = bisect_right(self.at, start + capacity)
            if j == len(self.at):
                start = self.at[-1]
            elif hopeful and self.hidden[j] and start + capacity > self.since[j]:
                start += capacity
            elif j:
                start = max(start, self.at[j - 1])
            out.append(start)
        return out


def least(low: int, high: int, ok) -> int:
    """Smallest value in [low, high] that is ok; high is."""
    while low < high:
        mid = (low + high) // 2
        if ok(mid):
            high = mid
        else:
            low = mid + 1
    return low


def even_cuts(ends: Ends, capacity: int, shards: int) -> list[int]:
    """Indexes into ``ends`` where the shards end: close to equal shares, none above the capacity."""
    at, total = ends.at, ends.at[-1]
    need = [total]                       # need[r]: the earliest end from which r shards can hold the rest
    for _ in range(shards - 1):
        i = bisect_left(at, need[-1] - capacity)
        need.append(0 if need[-1] <= capacity else at[i])
    start, out, last = 0, [], len(at) - 1
    for s in range(shards):
        left = shards - s
        if start == total:
            out.append(last)
            continue
        most = bisect_right(at, start + capacity) - 1
        fewest = max(bisect_left(at, need[left - 1]), bisect_right(at, start))
        target = start + (total - start) / left
        i = min(max(bisect_left(at, target), fewest), most)
        if i > fewest and target - at[i - 1] < at[i] - target:
            i -= 1
        out.append(i)
        start = at[i]
    return out


def _summary(groups: DataFrame, stretches: list[tuple[int, int]], most: int) -> list[tuple[int, int, int, int]]:
    """(last end, rows up to it, other ends, where the slice begins) of the slices of each stretch (a, b] (ascending, disjoint).

    Stretches get slices in proportion to their size, two at least: no more than most + 2 * len(stretches) rows in all."""
    a, b = (np.array(x, dtype=np.int64) for x in zip(*stretches, strict=True))
    parts = np.maximum(2, most * (b - a) // int((b - a).sum()))
    width = np.maximum(1, -(-(b - a) // parts))
    first = np.cumsum(parts) - parts

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = batch.column(0).to_numpy(zero_copy_only=False)
            k = np.searchsorted(a, upto, side="left") - 1
            inside = (k >= 0) & (upto <= b[np.maximum(k, 0)])
            k, upto = k[inside], upto[inside]
            yield pa.RecordBatch.from_arrays([pa.array(first[k] + (upto - a[k] - 1) // width[k]), pa.array(upto),
                                              pa.array(batch.column(1).to_numpy(zero_copy_only=False)[inside])], ["cell", "upto", "rows"])

    got = (groups.select("upto", "rows").mapInArrow(cells, "cell long, upto long, rows long").groupBy("cell")
           .agg(F.max("upto").alias("upto"), F.max("rows").alias("rows"), F.count(F.lit(1)).alias("n")).collect())
    out = []
    for r in got:
        k = int(np.searchsorted(first, r["cell"], side="right")) - 1
        out.append((r["upto"], r["rows"], r["n"] - 1, int(a[k] + (r["cell"] - first[k]) * width[k])))
    return sorted(out)


def minimax(groups: DataFrame, shards: int) -> tuple[Ends, int]:
    """Known ends and the smallest feasible capacity for ``groups`` (size, upto, rows: running sums at the group's end)."""
    top = groups.agg(F.max("upto").alias("t"), F.max("size").alias("b")).first()
    total, biggest = top["t"], top["b"]
    floor = max(biggest, -(-total // shards))
    # The cuts can be off by a slice for each shard before them, so together they leave about shards² / most of all
    # bytes open after the first round.  Later rounds only cut gaps that still hide ends, each into two at least.
    most = max(SUMMARY, 16 * shards * shards)
    found = _summary(groups, [(0, total)], most)
    ends = Ends(*map(list, zip(*found, strict=True)))
    while True:
        enough = least(floor, total, lambda c: ends.fits(c, shards))
        possible = least(floor, enough, lambda c: ends.may_fit(c, shards))
        if enough == possible:
            return ends, enough
        open_gaps: set[int] = set()       # those with hidden ends that a cut can fall into
        for low, high in zip(ends.reach(possible, shards, False), ends.reach(enough, shards, True), strict=True):
            i, j = bisect_right(ends.at, low), bisect_left(ends.at, high)
            open_gaps.update(k for k in range(i, min(j, len(ends.at) - 1) + 1) if ends.hidden[k])
        found = _summary(groups, [(ends.since[k], ends.at[k]) for k in sorted(open_gaps)], most)
        known = [x for k, x in enumerate(zip(ends.at, ends.rows, ends.hidden, ends.since, strict=True)) if k not in open_gaps]
        ends = Ends(*map(list, zip(*sorted(known + found), strict=True)))


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id_col, size, text_crc32, shard, slot) for each row of ``docs``."""
    text = F.col(quoted(text_col))
    rows = docs.select(
        F.col(quoted(id_col)).alias(id_col), (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), F.coalesce(F.md5(text), F.lit("")).alias("_group"))
    placed = cut_lineage(global_running_sum(rows, [F.col("_group"), F.col(quoted(id_col)), F.monotonically_increasing_id()],
                                            {"_upto": F.col("size")}, row_number="_row"))
    groups = cut_lineage(placed.groupBy("_group").agg(F.sum("size").alias("size"), F.max("_upto").alias("upto"), F.max("_row").alias("rows")))
    if groups.isEmpty():
        return placed.select(id_col, "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ends, capacity = minimax(groups, shards)
    cuts = even_cuts(ends, capacity, shards)[:-1]
    at = F.array(*[F.lit(ends.at[i]).cast("long") for i in cuts])
    before = F.array(F.lit(0).cast("long"), *[F.lit(ends.rows[i]).cast("long") for i in cuts])
    number = F.size(F.filter(at, lambda c: c < F.col("_upto")))
    return placed.withColumn("shard", number).select(
        id_col, "size", "text_crc32", "shard", (F.col("_row") - 1 - F.get(before, F.col("shard"))).cast("long").alias("slot"))


# ---- registered query -------------------------------------------------------

def query(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes; equal texts share a shard."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                              F.lit(None).cast("int").alias("grown_shard"))
