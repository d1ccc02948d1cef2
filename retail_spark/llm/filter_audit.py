"""Filter interaction audit: what each filter removes under every order of the filters.

Whole texts are judged once: each document gets a mask of the filters that it
fails.  A failure mask decides a document's removal under every order, so
documents of a part shrink to weighted masks (at most 32) before anything is
audited.  The audit is a min-plus product: with cost 0 for a failed filter and
no bound for a passed one, the removal step of mask ``m`` under order ``p`` is
``min over f of (cost[m, f] + position[p, f])``, where the position matrix holds
the inverse permutations.  Removal steps then drive weighted scatter counts.

Filter E (repeated text) compares whole texts by SHA-256, table-wide.  Texts
that hold 1/1024 of the rows or more (1024 at most, a proven bound) are
broadcast, so no group of copies meets in one task; the others meet by a
shuffled join.

Edge cases: a null text is an empty text and fails A, and E after a smaller id
with an empty or null text; a null source is the part ``''``; rows with equal
ids and texts do not make each other fail E; null ids never fail E, make none
fail it and have no labels; several labels of one id count if any is 1; texts of
any length are judged whole; an empty table has no part and gives no row; only
the id, source and text columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_spark.llm.text_udf import quoted, small_batches
from retail_spark.session import shared_path

FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
HEAVY_SHARE = 1024        # texts with 1/1024 of the rows are broadcast
# The limits and characters of the audited filters.
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SIGNS = 50, 65, 5, b"#$%&*|"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))

# ---- the masks --------------------------------------------------------------


def text_mask(text: str) -> int:
    """Bits of the filters A to D that a text fails."""
    raw = text.encode()
    words = raw.split()                        # ASCII white space, as [\x20\x09-\x0D]
    upper = len(raw) - len(raw.translate(None, _UPPER))
    fails = (len(words) < MIN_WORDS, 100 * len(set(words)) < DISTINCT_PERCENT * len(words), 100 * upper > UPPER_PERCENT * len(text),
             len(raw.translate(None, SIGNS)) < len(raw))
    return sum(bad << k for k, bad in enumerate(fails))


def judged(docs: DataFrame, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, part, mask (A to D) and the digest of the text, a row for every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, digests = [], []
            for t in batch.column("text"):
                t = t.as_py() or ""
                masks.append(text_mask(t))
                digests.append(hashlib.sha256(t.encode()).digest())
            yield pa.record_batch([batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
                                  names=["doc_id", "part", "mask", "digest"])

    part = F.coalesce(F.col(quoted(part_col)).cast("string"), F.lit(""))
    return (docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), part.alias("part"), F.col(quoted(text_col)).alias("text"))
            .mapInArrow(run, "doc_id long, part string, mask int, digest binary"))


def with_repeats(rows: DataFrame) -> DataFrame:
    """doc_id, part and the full mask of the written rows of ``judged``."""
    spark = rows.sparkSession
    path = shared_path(spark, "repeated")
    (rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").write.parquet(path))
    repeated, total = spark.read.parquet(path), rows.count()
    heavy = F.col("n") * F.lit(HEAVY_SHARE) >= F.lit(total)                      # HEAVY_SHARE texts at most
    few = F.broadcast(repeated.filter(heavy).select("digest", "first"))
    rest = rows.join(few, "digest", "left_anti").join(repeated.filter(~heavy).select("digest", "first"), "digest", "left")
    later = F.when(F.col("doc_id") > F.col("first"), REPEATED).otherwise(0)
    return rows.join(few, "digest").unionByName(rest).select("doc_id", "part", F.col("mask").bitwiseOR(later).alias("mask"))


# ---- the audit --------------------------------------------------------------

ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: position[p, f]: the step at which order p applies filter f (the inverse permutation).
POSITION = np.array([[order.index(f) + 1 for f in FILTERS] for order in ORDERS])
NEVER = len(FILTERS) + 1
FAILS = np.array([[m >> f & 1 for f in range(len(FILTERS))] for m in range(1 << len(FILTERS))], dtype=bool)


def removal_steps() -> np.ndarray:
    """step[p, m] at which order p removes a document of mask m (NEVER: it stays), a min-plus product."""
    cost = np.where(FAILS, 0, NEVER)
    return np.minimum((POSITION[:, None, :] + cost[None, :, :]).min(axis=2), NEVER)


def audit_counts(n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """Counts [part, order, step] from the weights [part, mask] of all, good and toxic documents."""
    removed_at = removal_steps()
    steps = np.arange(1, NEVER)
    letter = np.argsort(POSITION, axis=1)                                          # filter of each step
    here = removed_at[:, :, None] == steps                                         # order, mask, step
    fails = FAILS.T[letter].transpose(0, 2, 1)                                     # its filter is failed
    early = fails & (removed_at[:, :, None] < steps)
    only = fails & (FAILS.sum(axis=1) == 1)[None, :, None]

    def weighed(weight: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        return np.einsum("gm,pms->gps", weight, chosen.astype(np.int64))

    removed = weighed(n, here)
    total = np.zeros((len(n), len(FILTERS)), dtype=np.int64)
    np.add.at(total.T, letter.ravel(), removed.reshape(len(n), -1).T)              # scatter by filter over all orders
    return {"kept": n.sum(axis=1)[:, None, None] - removed.cumsum(axis=2), "removed": removed, "redundant": weighed(n, early),
            "unique_fails": weighed(n, only), "good_lost": weighed(good, here), "toxic_lost": weighed(toxic, here), "shapley": total[:, letter]}


_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit(masks: DataFrame) -> DataFrame:
    """Rows (part, filter_order, step, counts) from one row per part and mask: part, mask, n, good, toxic."""
    weights = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("w"))     # 32 masks at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                w = np.zeros((3, some.num_rows, len(FAILS)), dtype=np.int64)
                for g, entries in enumerate(some.column("w").to_pylist()):
                    for e in entries:
                        w[:, g, e["mask"]] = e["n"], e["good"], e["toxic"]
                counts = audit_counts(*w)
                shape = (some.num_rows, len(ORDERS), len(FILTERS))
                g, p, s = (x.ravel() for x in np.indices(shape))
                yield pa.record_batch([some.column("part").take(pa.array(g)), pa.array(ORDERS).take(pa.array(p)), pa.array((s + 1).astype(np.int32)),
                                       *[pa.array(counts[c].ravel()) for c in _COUNTS]], names=["part", "filter_order", "step", *_COUNTS])

    return weights.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """The audit of ``docs`` by part; ``labels`` has doc_id, quality and toxic."""
    spark = docs.sparkSession
    path = shared_path(spark, "judged")
    judged(docs, id_col, part_col, text_col).write.parquet(path)
    each = with_repeats(spark.read.parquet(path)).groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    one = lambda c: F.max((F.col(c) == 1).cast("long"))
    marks = labels.groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    weighed = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    return audit(each.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), weighed("good"), weighed("toxic")))


# ---- registered query -------------------------------------------------------

def query(spark, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders, audited for each source."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return filter_audit(read("documents"), read("labels").select("doc_id", "quality", "toxic"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
j AS (SELECT part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
        coalesce(w.doc_id > first, false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM j GROUP BY ALL),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM f p, f q, f r, f s, f t
      WHERE p.x NOT IN (q.x, r.x, s.x, t.x) AND q.x NOT IN (r.x, s.x, t.x) AND r.x NOT IN (s.x, t.x) AND s.x <> t.x),
r AS (SELECT m.*, filter_order, least(CASE WHEN a THEN strpos(filter_order, 'A') ELSE 6 END, CASE WHEN b THEN strpos(filter_order, 'B') ELSE 6 END,
        CASE WHEN c THEN strpos(filter_order, 'C') ELSE 6 END, CASE WHEN d THEN strpos(filter_order, 'D') ELSE 6 END,
        CASE WHEN e THEN strpos(filter_order, 'E') ELSE 6 END) AS gone FROM m, o),
s AS (SELECT r.*, k.step::INT AS step, filter_order[k.step] AS letter,
        CASE filter_order[k.step] WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails,
        a::INT + b::INT + c::INT + d::INT + e::INT AS failed FROM r, range(1, 6) k(step)),
t AS (SELECT part, filter_order, step, any_value(letter) AS letter,
        sum(CASE WHEN gone > step THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN fails AND gone < step THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails AND failed = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN gone = step THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN gone = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM s GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM t"""
