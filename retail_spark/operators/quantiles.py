"""Exact quantiles of many columns by bracket refinement.

A sample of each column cuts its values into points and the gaps between them.
One counted pass over the rows (counts kept in each partition, merged by Spark)
tells in which point or gap every wanted position falls.  Points are answers;
gaps that hold a wanted position are the next brackets, and everything else is
left alone.  Once the brackets hold few enough values those are counted one by
one.  No row is shuffled or sorted across tasks, and a value that holds a large
part of the rows is one point.

Sizes: ``SAMPLE`` values over all brackets and ``COLLECT`` counted values reach
the driver at a time.  The rows are written once (checkpoint, if the caller has not
written them), so every pass reads the same partitions and a lost task draws the same sample again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_spark.session import cut_lineage

SAMPLE = 50_000
COLLECT = 1 << 20
SEED = 42


@dataclass
class Bracket:
    """Values of a column between ``lo`` and ``hi`` (both left out, but for the whole column) and the ranks wanted in it."""

    column: int
    lo: float
    hi: float
    below: int                    # values of the column under the bracket
    count: int
    ranks: list[int] = field(default_factory=list)


def _inside(brackets: list[Bracket], columns: list[np.ndarray], whole: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(bracket number, its values) for some rows."""
    for c, values in enumerate(columns):
        mine = [i for i, b in enumerate(brackets) if b.column == c]
        if not mine:
            continue
        values = values[~np.isnan(values)]
        if whole:
            yield mine[0], values
            continue
        lows, highs = np.array([brackets[i].lo for i in mine]), np.array([brackets[i].hi for i in mine])
        at = np.searchsorted(lows, values, side="left") - 1
        kept = (at >= 0) & (values < highs[at])
        values, at = values[kept], at[kept]
        order = np.argsort(at, kind="stable")
        values, at = values[order], at[order]
        for k in np.unique(at):
            lo, hi = np.searchsorted(at, [k, k + 1])
            yield mine[k], values[lo:hi]


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]      # nulls become NaN


def quantile_values(df: DataFrame, wanted: dict[str, Sequence[float]], written: bool = False) -> dict[str, list[float]]:
    """Exact linear quantiles of each column at its fractions; no value for a column of nulls (NaN counts as null).

    ``written``: the rows are a projection of written ones, which every pass reads as they are."""
    names = list(wanted)
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    rows = rows if written else cut_lineage(rows)
    counted = rows.agg(*[F.count(F.when(F.col(c).isNotNull() & ~F.isnan(c), 1)).alias(c) for c in rows.columns]).first()
    n = list(counted)
    at = [[p * (n[i] - 1) for p in wanted[c]] if n[i] else [] for i, c in enumerate(names)]
    brackets = [Bracket(i, -np.inf, np.inf, 0, n[i], sorted({int(e) for p in at[i] for e in (np.floor(p), np.ceil(p))}))
                for i in range(len(names)) if at[i]]
    known: list[dict[int, float]] = [{} for _ in names]
    turn = 0
    while brackets:
        if sum(b.count for b in brackets) <= COLLECT:
            _settle(known, brackets, *_counted(rows, brackets, None, turn == 0))
            break
        brackets = _refined(known, rows, brackets, turn)
        turn += 1
    out = {}
    for i, c in enumerate(names):
        ends = [(known[i][int(np.floor(p))], known[i][int(np.ceil(p))], p - np.floor(p)) for p in at[i]]
        out[c] = [lo if lo == hi else lo + (hi - lo) * part for lo, hi, part in ends]
    return out


def _sampled(rows: DataFrame, brackets: list[Bracket], turn: int) -> list[np.ndarray]:
    """Some different values of each bracket, in order."""
    share = min(1.0, SAMPLE / sum(b.count for b in brackets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([SEED, turn, TaskContext.get().partitionId()])
        for batch in batches:
            for i, v in _inside(brackets, _columns(batch), turn == 0):
                v = v[rng.random(len(v)) < share]
                if len(v):
                    yield pa.record_batch([pa.array(np.full(len(v), i, np.int32)), pa.array(v)], names=["bracket", "v"])

    got = rows.mapInArrow(run, "bracket int, v double").distinct().toArrow()
    which, values = got["bracket"].to_numpy(), got["v"].to_numpy()
    ends = [-np.inf, np.inf] if turn == 0 else []            # a bracket leaves its ends out: infinite values are points
    return [np.unique(np.concatenate([values[which == i], ends])) for i in range(len(brackets))]


def _counted(rows: DataFrame, brackets: list[Bracket], points: list[np.ndarray] | None, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bracket, cell, count): cells 2 i for the gap before point i and 2 i + 1 for point i; without points the values themselves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for i, v in _inside(brackets, _columns(batch), whole):
                if points is not None:
                    left = np.searchsorted(points[i], v, side="left")
                    hit = np.searchsorted(points[i], v, side="right") > left
                    cells, count = np.unique(2 * left + hit, return_counts=True)
                    v = cells.astype(float)
                else:
                    v, count = np.unique(v, return_counts=True)
                if i in held:
                    v, back = np.unique(np.concatenate([held[i][0], v]), return_inverse=True)
                    count = np.bincount(back, np.concatenate([held[i][1], count]), len(v)).astype(np.int64)
                held[i] = [v, count]
        for i, (v, count) in held.items():
            yield pa.record_batch([pa.array(np.full(len(v), i, np.int32)), pa.array(v), pa.array(count, pa.int64())], names=["bracket", "v", "n"])

    got = rows.mapInArrow(run, "bracket int, v double, n long").groupBy("bracket", "v").agg(F.sum("n").alias("n")).toArrow()
    got = got.sort_by([("bracket", "ascending"), ("v", "ascending")])
    return tuple(got[c].to_numpy() for c in ("bracket", "v", "n"))


def _settle(known: list[dict[int, float]], brackets: list[Bracket], which: np.ndarray, v: np.ndarray, n: np.ndarray) -> None:
    for i, b in enumerate(brackets):
        lo, hi = np.searchsorted(which, [i, i + 1])
        upto = np.cumsum(n[lo:hi]) + b.below
        for r in b.ranks:
            known[b.column][r] = float(v[lo:hi][np.searchsorted(upto, r, side="right")])


def _refined(known: list[dict[int, float]], rows: DataFrame, brackets: list[Bracket], turn: int) -> list[Bracket]:
    points = _sampled(rows, brackets, turn)
    which, cells, n = _counted(rows, brackets, points, turn == 0)
    out = []
    for i, b in enumerate(brackets):
        lo, hi = np.searchsorted(which, [i, i + 1])
        cell, count = cells[lo:hi].astype(int), n[lo:hi]
        upto = np.cumsum(count) + b.below
        edges = np.concatenate([[b.lo], points[i], [b.hi]])
        found: dict[int, Bracket] = {}
        for r in b.ranks:
            k = int(np.searchsorted(upto, r, side="right"))
            gap, point = divmod(int(cell[k]), 2)
            if point:
                known[b.column][r] = float(points[i][gap])
            else:
                found.setdefault(k, Bracket(b.column, edges[gap], edges[gap + 1], int(upto[k] - count[k]), int(count[k]))).ranks.append(r)
        out += found.values()
    return sorted(out, key=lambda b: (b.column, b.lo))


def one_row(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """The values as a one-row frame of doubles."""
    return df.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(c) for c, v in values.items()])
