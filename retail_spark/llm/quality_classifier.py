"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text becomes a vector of hashed features: byte trigrams of the whole text
(square roots of their shares) and a few shape facts (length, share of distinct
words, share of words equal to the one before).  One weight vector, shared by
all grades, gives a latent score s; ordered thresholds t_1 < t_2 < ... cut it:
P(grade >= j) = 1 / (1 + exp(t_j - s)).  The sum of these tail probabilities is
the expected grade; the tail probability at one grade selects documents.

The fit uses at most ``max_train`` rated rows, taken in hash order; only their
feature vectors come to the driver, so its cost does not grow with the corpus.
Scoring reads each document whole, in its own row, without a shuffle.

Edge cases: null and empty texts are scored like any other (they have only the
shape facts); rated rows with a null id or rating are left out, the highest
rating of an id counts; without ratings, or with one grade only, every document
gets the prior; repeated rows get equal scores; extra columns pass through,
except those with the names of the outputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retail_spark.llm.text_udf import fresh, quoted, small_batches, without

BUCKETS = 1 << 12     # hashed trigrams
BLOCK = 1 << 20       # bytes hashed at a time
SHAPES = 3 * 16       # sixteen levels for each of the three shape facts


def vector(text: str | None) -> np.ndarray:
    """Hashed features of one whole text (float32, BUCKETS + SHAPES)."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    counts = np.zeros(BUCKETS)
    for at in range(0, max(0, len(raw) - 2), BLOCK):
        b = raw[at:at + BLOCK + 2].astype(np.uint32)
        h = b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x9E3D0001) ^ b[2:] * np.uint32(0x85EBCA77)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        counts += np.bincount(h & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    out = np.zeros(BUCKETS + SHAPES, dtype=np.float32)
    out[:BUCKETS] = np.sqrt(counts / max(1.0, counts.sum()))
    words = (text or "").split()
    n = len(words)
    levels = (min(15, n.bit_length()), int(15 * len(set(words)) / n) if n else 0,
              int(15 * sum(map(eq, words, words[1:])) / (n - 1)) if n > 1 else 0)
    for k, level in enumerate(levels):
        out[BUCKETS + 16 * k + level] = 0.5
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray           # float32, BUCKETS + SHAPES
    thresholds: tuple[float, ...]  # ascending, one less than there are grades


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int, ridge: float = 1e-4, rounds: int = 300, rate: float = 0.3) -> Model:
    """Maximum likelihood of the cumulative logit model with a ridge, by Adam steps on all rows.

    The thresholds are the first one plus positive steps, so their order holds throughout."""
    share = np.array([(np.sum(grade >= j) + 0.5) / (len(grade) + 1.0) for j in range(1, grades)])
    start = -np.log(share / (1 - share))                       # the prior: what the thresholds say at s = 0
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    theta = np.concatenate([np.zeros(x.shape[1], dtype=np.float32), start[:1], gaps]).astype(np.float64)
    if len(grade) == 0 or grade.min() == grade.max():
        return Model(theta[:x.shape[1]].astype(np.float32), tuple(np.maximum.accumulate(start).tolist()))
    d, n, first, second = x.shape[1], len(grade), np.zeros_like(theta), np.zeros_like(theta)
    rows = np.arange(n)

    def cuts(theta: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate([theta[d:d + 1], np.exp(theta[d + 1:])]))

    for k in range(1, rounds + 1):
        below = 1 / (1 + np.exp(-np.clip(cuts(theta)[None, :] - (x @ theta[:d].astype(np.float32))[:, None], -30, 30)))
        cum = np.column_stack([np.zeros(n), below, np.ones(n)])
        lo, hi = cum[rows, grade], cum[rows, grade + 1]
        p, dlo, dhi = np.maximum(hi - lo, 1e-9), lo * (1 - lo), hi * (1 - hi)
        grad = np.empty_like(theta)
        grad[:d] = x.T @ ((dhi - dlo) / p).astype(np.float32) / n + ridge * theta[:d]
        at_cut = np.array([np.sum(np.where(grade == j + 1, dlo / p, 0)) - np.sum(np.where(grade == j, dhi / p, 0)) for j in range(grades - 1)]) / n
        later = np.cumsum(at_cut[::-1])[::-1]                  # a step moves its own threshold and all later ones
        grad[d], grad[d + 1:] = later[0], later[1:] * np.exp(theta[d + 1:])
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        theta -= rate * (1 - k / (rounds + 1)) * (first / (1 - 0.9 ** k)) / (np.sqrt(second / (1 - 0.999 ** k)) + 1e-8)
    return Model(theta[:d].astype(np.float32), tuple(cuts(theta).tolist()))


def fit(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", rating_col: str = "rating",
        text_col: str = "text", max_train: int = 4000) -> Model:
    """Fit on at most ``max_train`` rated rows (ratings 0 .. grades - 1), the first in the order of a hash of the id."""
    small_batches(docs.sparkSession)

    @F.arrow_udf(T.BinaryType())
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([vector(x.as_py()).astype(np.float16).tobytes() for x in batch], pa.binary())

    some = (ratings.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(rating_col)).cast("int").alias("rating")).dropna()
            .filter(F.col("rating").between(0, grades - 1)).groupBy("id").agg(F.max("rating").alias("rating"))
            .orderBy(F.xxhash64("id"), "id").limit(max_train))
    rated = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")).join(F.broadcast(some), "id")   # at most max_train rows
    got = (rated.select("id", "rating", vectors("text").alias("x")).orderBy(F.xxhash64("id", "x"), "id").limit(max_train).collect())
    x = np.frombuffer(b"".join(r["x"] for r in got), dtype=np.float16).reshape(-1, BUCKETS + SHAPES).astype(np.float32)
    return fit_ordinal(x, np.array([r["rating"] for r in got], dtype=np.int64), grades)


def tail(latent: Column, threshold: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(float(threshold)) - latent))


def score(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Add ``{prefix}expected_grade`` and the tail probabilities ``{prefix}tail_1``, ``{prefix}tail_2``, ..."""
    small_batches(docs.sparkSession)
    weights = model.weights

    @F.arrow_udf(T.DoubleType())
    def latent(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([float(vector(x.as_py()) @ weights) for x in batch], pa.float64())

    names = [f"{prefix}tail_{j + 1}" for j in range(len(model.thresholds))]
    s = fresh(docs, "latent")
    scored = without(docs.withColumn(s, latent(F.col(quoted(text_col)))), f"{prefix}expected_grade", *names)
    scored = scored.withColumns({n: tail(F.col(s), t) for n, t in zip(names, model.thresholds, strict=True)})
    total = F.lit(0.0)
    for n in names:
        total = total + F.col(n)
    return scored.withColumn(f"{prefix}expected_grade", total).drop(s)


def select(docs: DataFrame, model: Model, grade: int = 1, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) with P(rating >= ``grade``) of at least ``least``."""
    prefix = "_q"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "q"
    return score(docs, model, text_col, prefix).filter(F.col(f"{prefix}tail_{grade}") >= least).select(*[F.col(quoted(c)) for c in docs.columns])


def ratings_of(labels: DataFrame) -> DataFrame:
    """Three grades from the given labels: 0 poor quality, 1 good but toxic, 2 good."""
    good, toxic = F.col("quality"), F.coalesce(F.col("toxic"), F.lit(0))
    return labels.select("doc_id", F.when(good == 0, 0).when(toxic == 1, 1).otherwise(2).alias("rating")).filter(good.isNotNull())


# ---- registered query -------------------------------------------------------

def query(spark, sf_dir: str) -> DataFrame:
    """Expected grade and tail probabilities of every whole text; selected: P(grade >= 1) of one half or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, ratings_of(spark.read.parquet(f"{sf_dir}/labels.parquet")), 3)
    return score(docs, model).select("doc_id", "expected_grade", "tail_1", "tail_2", (F.col("tail_1") >= 0.5).alias("selected"))
