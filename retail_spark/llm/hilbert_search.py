"""Nearest neighbours by largest inner product along shifted Hilbert curves.

Largest inner product becomes nearest distance with one more coordinate: with
``M`` the largest norm, a vector ``x`` stands at ``(x, sqrt(M^2 - |x|^2))`` and a
query ``q`` at ``(q * M / |q|, 0)``.  Each of several curves has its own random
projection of these points and its own random shift, and orders everything by
Hilbert key.  Spark sorts (curve, key) by range; runs of ``window`` neighbours in
that order are groups, and a query is ranked against its own run and the runs
before and after it.  The windows of all curves merge into a query's first
answer, whose k-th score is a bound for what follows.

The exact check after it: the first curve's order is cut into at most
``MAX_CELLS`` cells with a centre and a radius, so ``q . centre + |q| radius``
bounds every score in a cell.  A query goes on to those cells only whose bound
reaches its k-th score, chunk by chunk of the curve.  On clustered vectors that
is a small share of the cells; on vectors without structure (no index of any
kind helps there) it is nearly all of them, and the answer is exact either way.

Scores are summed in double precision, component by component in order, so equal
vectors have equal scores wherever they are met; ties go to the smaller id.

Edge cases: null or zero vectors and vectors with null or non-finite components
take no part, neither as queries nor as candidates; shorter vectors count as
padded with zeros; a query has fewer than k rows if there are fewer candidates;
repeated rows are candidates each, and each other's; rows without an id are
candidates (after all ids among ties) and never queries; an empty table gives
an empty result; only the id and vector columns are read, so extra columns
cannot clash; very long vectors shrink the chunks (2^20 components each).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retail_spark.llm.text_udf import quoted
from retail_spark.operators.ordered import global_row_number
from retail_spark.session import shared_path

SEED = 20
AXES, BITS = 6, 10       # axes of a curve and bits of an axis
CURVES = 3
WINDOW = 1024            # neighbours in a run
CELL = 1024              # rows of a cell, more when that would pass MAX_CELLS
MAX_CELLS = 4096         # centres and radii that go to every task
CHUNK = 1 << 20          # vector components of a chunk, and of the queries that meet it together
AT_ONCE = 1 << 21        # scores held at a time
_FOUND = "q long, query_id long, row long, vec_id long, score double"


# ---- the curve --------------------------------------------------------------

def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer points [n, axes] with ``bits`` bits each."""
    x = [c.copy() for c in cells.T.astype(np.int64)]
    last = len(x) - 1
    for level in range(bits - 1, 0, -1):            # turn each subcube back into the standard orientation
        low = (1 << level) - 1
        for axis in x:
            flip = (axis >> level & 1).astype(bool)
            swap = np.where(flip, 0, (x[0] ^ axis) & low)
            axis ^= swap
            x[0] ^= np.where(flip, low, swap)
    for a in range(1, len(x)):                      # Gray code across the axes
        x[a] ^= x[a - 1]
    turn = np.zeros(len(cells), dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[last] >> level & 1, (1 << level) - 1, 0)
    key = np.zeros(len(cells), dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | ((axis ^ turn) >> level & 1)
    return key


def curve_keys(points: np.ndarray, top: float, curve: int) -> np.ndarray:
    """Keys of points (norm ``top``) on one curve: a random orthonormal projection, a random shift."""
    rng = np.random.default_rng([SEED, curve])
    d = points.shape[1]
    axes = min(AXES, d)
    basis, _ = np.linalg.qr(rng.standard_normal((d, axes)))
    half = top * min(1.0, 4 / np.sqrt(d))           # nearly all projections lie within four standard deviations
    unit = np.clip((points @ basis / half + 1) / 2, 0, 1)
    scaled = (unit + rng.random(axes)) / 2 * (1 << BITS)
    return hilbert_keys(np.minimum(scaled.astype(np.int64), (1 << BITS) - 1), BITS)


# ---- scores of a group ------------------------------------------------------

def matrix(column, dim: int) -> np.ndarray:
    """The vectors of a list column as rows, shorter ones padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy().astype(float)
    if (size == dim).all():
        return flat.reshape(len(size), dim)
    out = np.zeros((len(size), dim))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def exact_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, component by component in order."""
    total = np.zeros(len(x))
    for a, b in zip(x.T, y.T):
        total += a * b
    return total


def best(asked: pa.Table, rows: pa.Table, k: int, dim: int) -> pa.Table:
    """The k best of ``rows`` for each of ``asked`` with scores not under its ``least``."""
    names = [c.split()[0] for c in _FOUND.split(", ")]
    schema = pa.schema([(c, pa.float64() if c == "score" else pa.int64()) for c in names])
    if not asked.num_rows or not rows.num_rows:
        return schema.empty_table()
    x, y = matrix(asked["v"], dim), matrix(rows["v"], dim)
    q, r, least = asked["row"].to_numpy(), rows["row"].to_numpy(), asked["least"].to_numpy()
    ids = np.where(rows["vec_id"].is_null().to_numpy(), np.iinfo(np.int64).max, rows["vec_id"].fill_null(0).to_numpy())
    slack = 8 * dim * np.finfo(float).eps * np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1).max()
    order = np.argsort(r)
    own = np.minimum(np.searchsorted(r, q, sorter=order), len(r) - 1)
    own = np.where(r[order[own]] == q, order[own], -1)
    out: list[list[np.ndarray]] = []
    step = max(1, AT_ONCE // len(y))
    for at in range(0, len(x), step):
        s = x[at:at + step] @ y.T
        here = own[at:at + step]
        s[np.flatnonzero(here >= 0), here[here >= 0]] = -np.inf
        bound = np.partition(s, len(y) - k, axis=1)[:, len(y) - k] if len(y) > k else np.full(len(s), -np.inf)
        bound = np.maximum(bound, least[at:at + step]) - slack[at:at + step]
        i, j = np.nonzero((s >= bound[:, None]) & (s > -np.inf))
        # many ties make many pairs: their vectors are compared some at a time
        score = np.concatenate([exact_scores(x[at + i[c:c + (1 << 14)]], y[j[c:c + (1 << 14)]]) for c in range(0, max(len(i), 1), 1 << 14)])
        ranked = np.lexsort((r[j], ids[j], -score, i))
        i, j, score = i[ranked], j[ranked], score[ranked]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        chosen = (place < k) & (score >= least[at + i])
        out.append([at + i[chosen], j[chosen], score[chosen]])
    i, j, score = (np.concatenate(c) for c in zip(*out))
    return pa.table([asked["row"].take(pa.array(i)), asked["vec_id"].take(pa.array(i)), rows["row"].take(pa.array(j)),
                     rows["vec_id"].take(pa.array(j)), pa.array(score)], schema=schema)


def _meeting(k: int, dim: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def meet(asked: pa.Table, rows: pa.Table) -> pa.Table:
        return best(asked, rows, k, dim)

    return meet


# ---- the search -------------------------------------------------------------

def usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vec.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vec, lambda c: c != 0)


def _entries(table: DataFrame, top: float, dim: int, curves: int) -> DataFrame:
    """Every vector (and every query, at its own point) on every curve: curve, key, asked, row, vec_id, v."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, asked = matrix(batch.column("v"), dim), batch.column("asked").to_numpy(zero_copy_only=False)
            norm = np.linalg.norm(x, axis=1)
            points = np.hstack([x, np.sqrt(np.maximum(top * top - norm * norm, 0))[:, None]])
            queries = np.hstack([x * (top / norm)[:, None], np.zeros((len(x), 1))])[asked]
            kept = batch.select(["row", "vec_id", "v"])
            for c in range(curves):
                for mine, at, flag in ((kept, points, False), (kept.filter(pa.array(asked)), queries, True)):
                    yield pa.record_batch([pa.array(np.full(len(at), c, np.int32)), pa.array(curve_keys(at, top, c)),
                                           pa.array(np.full(len(at), flag)), *mine.columns],
                                          names=["curve", "key", "asked", "row", "vec_id", "v"])

    return table.mapInArrow(run, f"curve int, key long, asked boolean, row long, vec_id long, v {dict(table.dtypes)['v']}")


def _cells(base: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, centres and radii of the cells of ``base`` (cell, v); MAX_CELLS rows at most reach the driver."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, x = batch.column("cell").to_numpy(), matrix(batch.column("v"), dim)
                own, at = np.unique(cell, return_inverse=True)
                total = np.zeros((len(own), dim))
                np.add.at(total, at, x)
                yield pa.record_batch([pa.array(own), pa.array(np.bincount(at)), pa.array(list(total))], names=["cell", "n", "total"])

    def mean(part: pa.Table) -> pa.Table:
        total = matrix(part["total"], dim).sum(axis=0) / part["n"].to_numpy().sum()
        return pa.table({"cell": part["cell"].slice(0, 1), "centre": pa.array([total], pa.list_(pa.float64()))})

    found = (base.mapInArrow(sums, "cell long, n long, total array<double>").groupBy("cell")
             .applyInArrow(mean, "cell long, centre array<double>").toArrow().sort_by("cell"))
    cells, centres = found["cell"].to_numpy(), matrix(found["centre"], dim)
    sent = base.sparkSession.sparkContext.broadcast((cells, centres))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, middle = sent.value
        for batch in batches:
            if batch.num_rows:
                at = np.searchsorted(numbers, batch.column("cell").to_numpy())
                far = np.zeros(len(numbers))
                np.maximum.at(far, at, np.linalg.norm(matrix(batch.column("v"), dim) - middle[at], axis=1))
                own = np.unique(at)
                yield pa.record_batch([pa.array(numbers[own]), pa.array(far[own])], names=["cell", "radius"])

    radius = base.mapInArrow(reach, "cell long, radius double").groupBy("cell").agg(F.max("radius").alias("radius")).toArrow().sort_by("cell")
    return cells, centres, radius["radius"].to_numpy()


def search(table: DataFrame, asked: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", curves: int = CURVES,
           window: int = WINDOW, cell: int = CELL, chunk: int = CHUNK, exact: bool = True) -> DataFrame:
    """The k nearest other rows for each row of ``table`` that ``asked`` holds for: query_id, rank, vec_id, score.

    Without ``exact`` the answer is that of the curves' windows alone.
    """
    spark = table.sparkSession
    single = table.schema[vec_col].dataType.simpleString() == "array<float>"        # half the bytes to move, and exact
    vec = F.col(quoted(vec_col)).cast("array<float>" if single else "array<double>")
    path = shared_path(spark, "vectors")
    (table.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), vec.alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
     .filter(usable(F.col("v"))).withColumn("row", F.monotonically_increasing_id()).write.parquet(path))
    known = spark.read.parquet(path)
    square = F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda s, c: s + c * c)
    size = known.agg(F.max(F.size("v")).alias("dim"), F.max(F.sqrt(square)).alias("top")).first()
    if not size["dim"]:
        return known.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    dim, top = size["dim"], size["top"]

    placed = global_row_number(_entries(known, top, dim, curves), [F.col(c) for c in ("curve", "key", "asked", "row")], "place")
    run = F.floor(F.col("place") / window).cast("long")
    rows = placed.filter(~F.col("asked")).select("curve", run.alias("run"), "row", "vec_id", "v")
    queries = placed.filter("asked").select("curve", F.explode(F.array(run - 1, run, run + 1)).alias("run"), "row", "vec_id", "v",
                                            F.lit(float("-inf")).alias("least"))
    queries = queries.toDF(*queries.columns)        # both sides come from one table: own names for this one
    near = queries.groupBy("curve", "run").cogroup(rows.groupBy("curve", "run")).applyInArrow(_meeting(k, dim), _FOUND)
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    found = near.dropDuplicates(["q", "row"]).withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    if exact:
        path = shared_path(spark, "near")
        found.write.parquet(path)
        found = spark.read.parquet(path)
        more = _reach_further(known, placed, found, k, dim, cell, chunk // dim or 1)
        found = (found.drop("rank").unionByName(more).dropDuplicates(["q", "row"])
                 .withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k))
    return found.select("query_id", "rank", "vec_id", "score")


def _reach_further(known: DataFrame, placed: DataFrame, found: DataFrame, k: int, dim: int, cell: int, chunk: int) -> DataFrame:
    """All rows that can still be among a query's k best, cell by cell of the first curve."""
    spark = known.sparkSession
    first = placed.filter("curve = 0")
    n = first.count()
    cell = max(cell, -(-n // MAX_CELLS))
    number = lambda size: F.floor(F.col("place") / size).cast("long")
    base = first.filter(~F.col("asked")).select(number(cell).alias("cell"), number(chunk).alias("chunk"), "row", "vec_id", "v")
    cells, centres, radii = _cells(base.select("cell", "v"), dim)
    sent = spark.sparkContext.broadcast((cells, centres, radii))
    queries = (known.filter("asked").select("row", "vec_id", "v")
               .join(found.filter(F.col("rank") == k).select(F.col("q").alias("row"), F.col("score").alias("least")), "row", "left")
               .withColumn("least", F.coalesce("least", F.lit(float("-inf")))))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, middle, radius = sent.value
        lowest, highest = numbers * cell // chunk, (numbers * cell + cell - 1) // chunk     # chunks that a cell lies in
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                x = matrix(some.column("v"), dim)
                norm = np.linalg.norm(x, axis=1)
                bound = x @ middle.T + norm[:, None] * radius[None, :] * (1 + 1e-9) + 1e-9 * norm[:, None] * np.abs(middle).sum(axis=1)[None, :]
                i, c = np.nonzero(bound >= some.column("least").to_numpy()[:, None])
                span = highest[c] - lowest[c] + 1
                pair = np.unique(np.stack([np.repeat(i, span), np.repeat(lowest[c], span) + np.arange(span.sum())
                                           - np.repeat(np.cumsum(span) - span, span)]), axis=1)
                if pair.shape[1]:
                    yield pa.record_batch([pa.array(pair[1]), *some.take(pa.array(pair[0])).columns],
                                          names=["chunk", "row", "vec_id", "v", "least"])

    groups = -(-known.filter("asked").count() // chunk) or 1
    asked = queries.select("row", "vec_id", "v", "least").mapInArrow(ask, f"chunk long, row long, vec_id long, v {dict(known.dtypes)['v']}, least double")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    rows = base.select("chunk", "row", "vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    asked = asked.toDF(*asked.columns)
    return asked.groupBy("chunk", "part").cogroup(rows.groupBy("chunk", "part")).applyInArrow(_meeting(k, dim), _FOUND)


# ---- registered query -------------------------------------------------------

def query(spark, sf_dir: str) -> DataFrame:
    """Rows whose vec_id is divisible by 20 against all rows, their 20 nearest by inner product."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20)


SQL = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
s AS (SELECT q.r, q.vec_id AS query_id, x.r AS other, x.vec_id, list_inner_product(q.v, x.v) AS score FROM e q, e x WHERE q.vec_id % 20 = 0 AND q.r <> x.r),
t AS (SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, other))::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 20"""
