"""SimHash near-duplicates by a binary trie self-join.

Each text gets a 64-bit fingerprint over its word shingles.  The distinct
fingerprints form a binary trie, and the trie is joined with itself: pairs of
nodes of equal depth are followed downwards together, the differing bits of
their paths add up, and a pair is dropped as soon as its error budget is spent.

Two fingerprints within k bits differ in at most k/2 bits of one half or the
other.  The join therefore runs twice, over the bits as they are and with the
halves exchanged, with a budget of k//2 (second run: (k-1)//2, as the first one
has the ties) inside the first 32 levels and k over all 64.  Both runs together
find every pair within k bits, and far fewer node pairs stay alive than with
one budget of k.

Spark deals the top of the trie: a subtree is a value of the first bits (their
number follows the number of fingerprints), and each pair of subtrees within
budget is one group.  A subtree with too many fingerprints is cut into chunks
and each pair of chunks is a group, so no group grows with the corpus.  A group
returns a spanning forest of the links it finds, never all pairs; the forests
are then joined into components.  Copies share a fingerprint and enter once.

Edge cases: null and empty texts (and texts of white space) have fingerprint
zero and link like any other; a text with fewer words than a shingle is one
shingle; very long texts are hashed whole, block by block; repeated rows share
their component; null identifiers belong to the component of their text but
never name one (a component of null identifiers only has a null name); an empty
table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retail_spark.llm.components import connected_components
from retail_spark.llm.text_udf import fresh, quoted, small_batches
from retail_spark.session import cut_lineage

SEED = 42
CELL = 4096           # fingerprints of a subtree that one group may hold, twice over
PAIRS = 1 << 20       # fingerprint pairs compared at a time inside a group
BLOCK = 1 << 16       # shingles hashed at a time


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned fingerprint: a bit is 1 if set in over half of the shingles' XXH64 values (seed 42)."""
    words = text.encode().lower().split() if text else []      # bytes: only A-Z change, only ASCII white space separates
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[min(shingle, len(words)) - 1:].tolist()
    ones, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at:at + BLOCK], last[at:at + BLOCK])], dtype="<u8")
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return sum(1 << int(k) for k in np.flatnonzero(2 * ones > n))


def add_fingerprint(docs: DataFrame, text_col: str, shingle: int, out: str) -> DataFrame:
    """Add ``out``: the fingerprint as a signed 64-bit integer of the same bits."""
    small_batches(docs.sparkSession)

    @F.arrow_udf(T.LongType())
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.array([fingerprint(x.as_py(), shingle) for x in batch], dtype=np.uint64).view(np.int64))

    return docs.withColumn(out, prints(F.col(quoted(text_col))))


# ---- the trie join of one group ---------------------------------------------

class Forest:
    """Union-find over positions, with vectorised unions; the root is the smallest position."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def unite(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def _middle(v: np.ndarray, lo: np.ndarray, depth: int) -> np.ndarray:
    """Where the bit at ``depth`` turns one inside the nodes that begin at ``lo`` (v is sorted)."""
    bit = np.uint64(1) << np.uint64(63 - depth)
    prefix = v[lo] & ~((bit << np.uint64(1)) - np.uint64(1)) if depth else np.zeros(len(lo), dtype=np.uint64)
    return np.searchsorted(v, prefix | bit)


def join_tries(a: np.ndarray, b: np.ndarray | None, depth: int, early: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between values of the sorted arrays a and b (b None: inside a).

    Values of an array share their first ``depth`` bits.  A link has at most
    ``early`` differing bits among the first 32 and at most ``budget`` in all.
    """
    own = b is None
    b = a if own else b
    shift = 0 if own else len(a)
    forest = Forest(len(a) + (0 if own else len(b)))
    if not len(a) or not len(b):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
    top = np.uint64((1 << 32) - 1) << np.uint64(32)

    def compare(alo, ahi, blo, bhi) -> None:
        """Leaves: every pair of the nodes' values, a bounded number at a time."""
        na, nb = ahi - alo, bhi - blo
        each = na * nb
        at = 0
        ends = np.cumsum(each)
        while at < len(each):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            n = each[at:stop]
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = np.repeat(nb[at:stop], n)
            i = np.repeat(alo[at:stop], n) + offset // width
            j = np.repeat(blo[at:stop], n) + offset % width
            diff = a[i] ^ b[j]
            near = (np.bitwise_count(diff) <= budget) & (np.bitwise_count(diff & top) <= early)
            forest.unite(i[near], j[near] + shift)
            at = stop

    one = np.zeros(1, dtype=np.int64)
    alo, ahi, blo, bhi = one, one + len(a), one, one + len(b)
    spent = np.bitwise_count(((a[:1] ^ b[:1]) >> np.uint64(64 - depth)) if depth else np.zeros(1, dtype=np.uint64)).astype(np.int64)
    for d in range(depth, 64):
        small = (ahi - alo) * (bhi - blo) <= 64
        if small.any():
            compare(alo[small], ahi[small], blo[small], bhi[small])
            alo, ahi, blo, bhi, spent = (x[~small] for x in (alo, ahi, blo, bhi, spent))
        if not len(alo):
            break
        am = np.clip(_middle(a, alo, d), alo, ahi)
        bm = np.clip(_middle(b, blo, d), blo, bhi)
        kids = [(alo, am, blo, bm, spent), (am, ahi, bm, bhi, spent), (alo, am, bm, bhi, spent + 1), (am, ahi, blo, bm, spent + 1)]
        alo, ahi, blo, bhi, spent = (np.concatenate(x) for x in zip(*kids))
        alive = (alo < ahi) & (blo < bhi) & (spent <= (early if d < 32 else budget))
        if own:
            alive &= alo <= blo          # the pair of the same two nodes the other way round
        alo, ahi, blo, bhi, spent = (x[alive] for x in (alo, ahi, blo, bhi, spent))
    if len(alo):
        compare(alo, ahi, blo, bhi)
    values = a if own else np.concatenate([a, b])
    child = np.flatnonzero(forest.root != np.arange(len(values)))
    return values[child], values[forest.root[child]]


def _swap(v: np.ndarray) -> np.ndarray:
    return v << np.uint64(32) | v >> np.uint64(32)


def _group_links(depth: int, early: int, budget: int, swapped: bool):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf["fp"].to_numpy().view(np.uint64)
        if swapped:
            v = _swap(v)
        side = pdf["side"].to_numpy()
        a, b = np.sort(v[side == 0]), np.sort(v[side == 1])
        own = not (pdf["a"].iat[0] != pdf["b"].iat[0] or pdf["ac"].iat[0] != pdf["bc"].iat[0])
        x, y = join_tries(a, None if own else b, depth, early, budget)
        if swapped:
            x, y = _swap(x), _swap(y)
        return pd.DataFrame({"u": x.view(np.int64), "v": y.view(np.int64)})
    return links


def _pass(prints: DataFrame, depth: int, early: int, budget: int, swapped: bool) -> DataFrame:
    """Links found by one run of the trie join over the distinct fingerprints ``prints`` (fp)."""
    fp = F.col("fp")
    ordered = F.shiftleft(fp, 32).bitwiseOR(F.shiftrightunsigned(fp, 32)) if swapped else fp
    masks = [sum(1 << k for k in bits) for n in range(min(early, budget) + 1) for bits in combinations(range(depth), n)]
    nodes = prints.select("fp", F.shiftrightunsigned(ordered, 64 - depth).alias("p"))
    hot = nodes.groupBy("p").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * CELL).select(
        "p", F.ceil(F.col("n") / CELL).cast("int").alias("chunks"))
    hot = cut_lineage(hot)
    few = hot.count() <= 50_000          # else the sizes of the hot subtrees are joined by a shuffle
    cells = (lambda d: F.broadcast(d)) if few else (lambda d: d)
    mine = (nodes.join(cells(hot), "p", "left").select("fp", "p", F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int").alias("c"))
            .select("fp", "p", "c", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
            .select("fp", "p", "c", F.col("p").bitwiseXOR(F.col("mask")).alias("q")))
    theirs = hot.select(F.col("p").alias("q"), F.col("chunks").alias("others"))
    dealt = (mine.join(cells(theirs), "q", "left")
             .select("fp", "p", "c", "q", F.explode(F.sequence(F.lit(0), F.coalesce("others", F.lit(1)) - 1)).alias("k")))
    first = (F.col("p") < F.col("q")) | ((F.col("p") == F.col("q")) & (F.col("c") <= F.col("k")))
    dealt = dealt.select(
        "fp", F.when(first, 0).otherwise(1).cast("byte").alias("side"), F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"),
        F.when(first, F.col("c")).otherwise(F.col("k")).alias("ac"), F.when(first, F.col("k")).otherwise(F.col("c")).alias("bc"))
    return dealt.groupBy("a", "b", "ac", "bc").applyInPandas(_group_links(depth, early, budget, swapped), "u long, v long")


def fingerprint_components(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """(node, root) of the distinct fingerprints ``prints`` (fp) that have a partner within ``max_bits`` bits."""
    n = prints.count()
    depth = min(30, max(4, math.ceil(math.log2(max(1, n) / CELL)) if n > CELL else 4))
    links = _pass(prints, depth, max_bits // 2, max_bits, False)
    if max_bits:
        links = links.unionByName(_pass(prints, depth, (max_bits - 1) // 2, max_bits, True))
    return connected_components(links)


def _roots(own: DataFrame, max_bits: int) -> DataFrame:
    """(fp, least, root) of each distinct fingerprint of ``own`` (id, fp): its smallest id and its component."""
    classes = cut_lineage(own.groupBy("fp").agg(F.min("id").alias("least")))
    found = fingerprint_components(classes.select("fp"), max_bits)
    return cut_lineage(classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row (id_col, fingerprint long, component_id) for each row of ``docs``.

    component_id: the smallest id that can be reached over links of at most ``max_bits`` differing bits."""
    ids = F.col(quoted(id_col)).alias("id")
    own = cut_lineage(add_fingerprint(docs.select(ids, F.col(quoted(text_col)).alias("text")), "text", shingle, "fp").select("id", "fp"))
    rooted = _roots(own, max_bits)
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut_lineage(rooted.join(names, "root").select("fp", "component_id"))
    return own.join(named, "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` with one row of each component, all columns: the one with the smallest id (null last), then text hash.

    Rows that repeat both id and text count once."""
    ids, text = F.col(quoted(id_col)), F.col(quoted(text_col))
    own = cut_lineage(add_fingerprint(docs.select(ids.alias("id"), text.alias("text")), "text", shingle, "fp")
                      .select("id", F.xxhash64("text").alias("h"), "fp"))
    chosen = (own.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("c"))
              .join(_roots(own, max_bits).select("fp", "root"), "fp").groupBy("root").agg(F.min("c").alias("c")))
    k, h = fresh(docs, "id_key"), fresh(docs, "text_key")
    as_key = (lambda c: F.coalesce(c.cast("string"), F.lit("")))
    keys = cut_lineage(chosen.select(as_key(F.col("c.id")).alias(k), F.col("c.h").alias(h)))
    return (docs.withColumns({k: as_key(ids), h: F.xxhash64(text)}).join(keys, [k, h], "left_semi")
            .dropDuplicates([k, h]).select(*[F.col(quoted(c)) for c in docs.columns]))


# ---- registered query -------------------------------------------------------

def query(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: four-word shingles, links at four or fewer differing bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
