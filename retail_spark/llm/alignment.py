"""Cross-tokenizer alignment: which tokens of two vocabularies share bytes, and how often corpus-wide.

Both vocabularies spell a document as the same bytes.  The work inside a task is
an Arrow pipeline over some documents at a time:

* a text is cut in front of single spaces that follow a visible character; no
  token of either vocabulary reaches across such a cut, so the cuts are
  numbered and each distinct one is encoded once (a bounded memory per
  worker process only saves time);
* the cuts' id lists are taken by number, flattened, and parent indices lead each
  token back to its document;
* token lengths are summed up within each document (segmented cumulative sums),
  which gives every token a (document, end) key;
* an Acero full outer join of both sides on that key lists all token ends in
  order.  Ends present on both sides cut the tokens into groups, and every end
  of the union is one link: the next A token to end there or later overlaps the
  next B token to end there or later, so filling nulls backwards gives its ids;
* ``Table.group_by`` counts the id pairs of each document.

The counted documents are written to the shared folder.  Their pairs are counted
per task (``Table.group_by`` again) and merged by Spark into corpus-wide counts.
Counts go back to the documents in two ways: of ``L`` links at most ``K`` pairs
can have ``L / K`` links or more, so those are sent to every task (a proven
bound, and they hold all hot pairs); pairs below that share meet their documents
by a shuffled join, in which no key is hot.

Edge cases: null and empty texts, and texts that a vocabulary does not spell
byte for byte, have no tokens, zeros and an empty digest; texts of any length
are aligned whole (one long text has a pipeline run for itself); repeated rows
are counted each; null identifiers are kept; an empty table gives an empty
result; only the id and text columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_spark.llm.text_udf import quoted, small_batches
from retail_spark.llm.token_counts import byte_symbols
from retail_spark.session import shared_path

TOGETHER = 1 << 20     # characters of the documents that go through the pipeline together
MEMORY = 10 << 20      # characters of the cuts that a worker process remembers before it starts anew (all of a run's own come on top)
MERGED = 1 << 21       # pair rows that a task counts together
HOT_PAIRS = 1 << 21    # K: pairs that may be sent to every task
_CUT = re.compile(r"(?<=\S) (?!\Z)")
_SPACE_PIECE = "▁"


class Vocabularies:
    """Both encoders with the bytes of their tokens, and the memory of cuts."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        with open(byte_level, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        spelled = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            spelled[i] = bytes([byte_of[c] for c in token])
        self.a_bytes = pa.array(spelled, pa.binary())
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        spelled = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            spelled.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_SPACE_PIECE, " ").encode())
        self.b_bytes = pa.array(spelled, pa.binary())
        # without such pieces no token of B reaches over a cut
        if any(_SPACE_PIECE in self.b.id_to_piece(i).lstrip(_SPACE_PIECE) for i in range(self.b.get_piece_size())):
            raise ValueError("the piece vocabulary has pieces with a space after other characters")
        self.a_width = pc.binary_length(self.a_bytes).cast(pa.int64())
        self.b_width = pc.binary_length(self.b_bytes).cast(pa.int64())
        digits = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        # decimal ids followed by the sign that comes next in the digest: "," "|" ";"
        self.signs = pa.array([d + s for s in ",|;" for d in digits])
        self.n_ids = len(digits)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}                 # number of a cut in both memories
        self.memories = (Memory(), Memory())
        self.held = 0

    def encode(self, cuts: list[str]) -> tuple[np.ndarray, pa.ListArray, pa.ListArray]:
        """Numbers of the cuts, each read with the space that stands before it, and the id lists by number."""
        if self.held > MEMORY:
            self._forget()
        new = list(set(cuts).difference(self.known))
        for at in range(0, len(new), 1 << 14):
            some = new[at:at + (1 << 14)]
            first = self.a.encode_batch([" " + c for c in some], add_special_tokens=False)
            self.known.update(zip(some, range(len(self.known), len(self.known) + len(some))))
            self.memories[0].add([x.ids for x in first])
            self.memories[1].add(self.b.encode(some, num_threads=1))
        self.held += sum(map(len, new))
        return np.fromiter(map(self.known.__getitem__, cuts), np.int32, len(cuts)), *[m.lists() for m in self.memories]


class Memory:
    """A list array that grows."""

    def __init__(self):
        self.ids, self.ends = array("i"), array("i", [0])

    def add(self, lists: list[list[int]]) -> None:
        for ids in lists:
            self.ids.extend(ids)
            self.ends.append(len(self.ids))

    def lists(self) -> pa.ListArray:
        ends, ids = (np.array(x, np.int32) for x in (self.ends, self.ids))
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))


_VOCABULARIES: dict[tuple[str, str], Vocabularies] = {}


def vocabularies(byte_level: str, pieces: str) -> Vocabularies:
    """One pair of encoders for each worker process, kept between tasks."""
    key = (byte_level, pieces)
    if key not in _VOCABULARIES:
        _VOCABULARIES[key] = Vocabularies(byte_level, pieces)
    return _VOCABULARIES[key]


def _side(lists: pa.ListArray, codes: pa.Array, doc_of_cut: pa.Array, spelled: pa.Array, width: pa.Array, n_docs: int):
    """Ids, documents, (document, end) keys and the joined bytes of one side, with the token bounds of each document."""
    taken = lists.take(codes)
    ids, doc = taken.flatten(), doc_of_cut.take(pc.list_parent_indices(taken))
    first = np.searchsorted(doc.to_numpy(), np.arange(n_docs + 1))
    ends = pc.cumulative_sum(width.take(ids)).to_numpy()
    base = np.concatenate([[0], ends])[first]                      # bytes before each document
    key = pa.array((doc.to_numpy().astype(np.int64) << 32) + ends - base[:-1][doc.to_numpy()])
    return ids, doc, key, spelled.take(ids), first, base


def _in_order(table: pa.Table, column: str) -> pa.Table:
    """Sorted by a column that comes in a few ascending runs, which a merge sort takes as they are."""
    table = table.combine_chunks()
    return table.take(pa.array(np.argsort(table[column].to_numpy(), kind="stable"))).combine_chunks()


def align(own: Vocabularies, texts: list[str]) -> pa.Table:
    """One row for each text: counts, digest, and its id pairs (B id high, A id low) with their links."""
    n = len(texts)
    cut = [_CUT.split(t) if t else [] for t in texts]
    doc_of_cut = pa.array(np.repeat(np.arange(n, dtype=np.int32), [len(c) for c in cut]))
    codes, a_lists, b_lists = own.encode([c for some in cut for c in some])
    a, a_doc, a_key, a_text, a_first, a_base = _side(a_lists, pa.array(codes), doc_of_cut, own.a_bytes, own.a_width, n)
    b, b_doc, b_key, b_text, b_first, b_base = _side(b_lists, pa.array(codes), doc_of_cut, own.b_bytes, own.b_width, n)
    a_buf, b_buf = (memoryview(x.buffers()[2] or b"").cast("B") for x in (a_text, b_text))
    whole = np.zeros(n, bool)
    for i, t in enumerate(texts):
        want = (" " + t).encode() if t else b""
        whole[i] = bool(want) and a_buf[a_base[i]:a_base[i + 1]] == want and b_buf[b_base[i]:b_base[i + 1]] == want

    a_side = pa.table({"key": a_key, "a": a, "i": pa.array(np.arange(len(a)))}).filter(pa.array(whole).take(a_doc))
    b_side = pa.table({"key": b_key, "b": b, "j": pa.array(np.arange(len(b)))}).filter(pa.array(whole).take(b_doc))
    ends = _in_order(a_side.join(b_side, "key", join_type="full outer", use_threads=False), "key")
    shared = pc.and_(pc.is_valid(ends["i"]), pc.is_valid(ends["j"]))
    doc = pc.shift_right(ends["key"], 32)
    pair = pc.add(pc.shift_left(pc.fill_null_backward(ends["b"]).cast(pa.int64()), 32), pc.fill_null_backward(ends["a"]).cast(pa.int64()))
    counted = _in_order(pa.table({"doc": doc, "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]), "doc")

    cuts = ends.filter(shared)
    groups = np.bincount(pc.shift_right(cuts["key"], 32).to_numpy(), minlength=n)
    digest = _digests(own, a, b, cuts["i"].to_numpy(), cuts["j"].to_numpy(), np.concatenate([[0], np.cumsum(groups)]), a_first, b_first, whole)
    offsets = pa.array(np.searchsorted(counted["doc"].to_numpy(), np.arange(n + 1)).astype(np.int32))
    return pa.table({
        "n_a": np.diff(a_first) * whole, "n_b": np.diff(b_first) * whole, "n_groups": groups.astype(np.int64),
        "n_links": np.bincount(doc.to_numpy(), minlength=n).astype(np.int64),
        "groups_sha256": digest,
        "pairs": pa.ListArray.from_arrays(offsets, counted["pair"].combine_chunks()),
        "links": pa.ListArray.from_arrays(offsets, counted["count_all"].combine_chunks()),
    })


def _digests(own: Vocabularies, a: pa.Array, b: pa.Array, i: np.ndarray, j: np.ndarray, group_first: np.ndarray, a_first: np.ndarray,
             b_first: np.ndarray, whole: np.ndarray) -> list[str]:
    """Digest of each document's groups, written as ``a1,a2|b1;a3|b2,b3``.

    ``i`` and ``j`` are the last A and B token of each group, in order; documents
    that are not whole have no group and their tokens lie between the groups' ones.
    """
    # the first tokens of each group: one after the group before, or the document's own first
    doc = np.repeat(np.arange(len(whole)), np.diff(group_first))
    opens = np.zeros(len(i), bool)
    opens[group_first[:-1][whole]] = True
    a_lo = np.where(opens, a_first[doc], np.concatenate([[0], i[:-1] + 1]))
    b_lo = np.where(opens, b_first[doc], np.concatenate([[0], j[:-1] + 1]))
    n_a, n_b = i - a_lo + 1, j - b_lo + 1
    size = n_a + n_b
    start = np.concatenate([[0], np.cumsum(size)])
    sign = np.empty(start[-1], np.int64)

    def place(ids: np.ndarray, lo: np.ndarray, count: np.ndarray, at: np.ndarray, last_sign: int) -> None:
        ranks = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        code = ids[np.repeat(lo, count) + ranks].astype(np.int64)
        code[np.cumsum(count) - 1] += last_sign * own.n_ids
        sign[np.repeat(at, count) + ranks] = code

    if len(i):
        place(a.to_numpy(), a_lo, n_a, start[:-1], 1)
        place(b.to_numpy(), b_lo, n_b, start[:-1] + n_a, 2)
    spelled = own.signs.take(pa.array(sign))
    if not len(i):
        return [""] * len(whole)
    offsets = np.frombuffer(spelled.buffers()[1], np.int32, len(spelled) + 1, spelled.offset * 4)[start[group_first]]
    text = memoryview(spelled.buffers()[2]).cast("B")
    return [hashlib.sha256(text[lo:hi - 1]).hexdigest() if ok else "" for lo, hi, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), whole)]


_LONGS = pa.list_(pa.field("element", pa.int64()))
_ROW = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_PAIRS = "pairs array<long>, links array<long>"


def _schema(columns: str) -> pa.Schema:
    """The Arrow schema of a column list in SQL types."""
    types = {"long": pa.int64(), "string": pa.string(), "array<long>": _LONGS}
    return pa.schema([(name, types[kind]) for name, kind in map(str.split, columns.split(", "))])


def aligned(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group and link counts, digest and id pairs of each document; a row for every row of ``docs``."""
    small_batches(docs.sparkSession)
    columns = f"{_ROW}, {_PAIRS}"
    schema = _schema(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabularies(byte_level, pieces)

        def done(ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
            found = align(own, texts)
            yield from pa.table([pa.array(ids, pa.int64()), *found.columns], names=schema.names).cast(schema).to_batches()

        for batch in batches:
            ids, texts, held = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or "")
                held += len(texts[-1])
                if held >= TOGETHER:
                    yield from done(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield from done(ids, texts)

    return docs.select(F.col(quoted(id_col)).cast("long"), F.col(quoted(text_col))).mapInArrow(run, columns)


def pair_counts(known: DataFrame) -> DataFrame:
    """Corpus-wide links of each id pair, counted per task and merged by Spark, and whether they are the B id's most."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("total", "sum")]).rename_columns(["pair", "total"])

        for batch in batches:
            held.append(pa.table({"pair": batch.column(0).flatten(), "total": batch.column(1).flatten()}))
            rows += held[-1].num_rows
            if rows >= MERGED:
                held = [merged()]
                rows = held[0].num_rows
                if rows >= MERGED // 2:          # mostly different pairs: hand them on
                    yield from held[0].to_batches()
                    held, rows = [], 0
        if held:
            yield from merged().to_batches()

    total = (known.select("pairs", "links").mapInArrow(count, "pair long, total long")
             .groupBy("pair").agg(F.sum("total").alias("total")))
    path = shared_path(known.sparkSession, "pairs")
    total.write.parquet(path)
    total = known.sparkSession.read.parquet(path)
    b = F.shiftrightunsigned("pair", 32)
    most = total.groupBy(b.alias("b")).agg(F.max("total").alias("most"))       # a row for each id of B's vocabulary at most
    return (total.withColumn("b", b).join(F.broadcast(most), "b")
            .select("pair", "total", (F.col("total") == F.col("most")).alias("best")))


def link_scores(known: DataFrame, counts: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Add n_best and count_sum to the written rows ``known`` (with the columns of ``aligned``).

    ``counts`` must be a written table: it is read three times.
    """
    spark = known.sparkSession
    n_links = counts.agg(F.sum("total")).first()[0] or 0
    hot = F.col("total") * F.lit(hot_pairs) >= F.lit(n_links)                    # at most hot_pairs rows
    table = counts.filter(hot).toArrow().combine_chunks().sort_by("pair")
    sent = spark.sparkContext.broadcast([table[c].to_numpy() for c in ("pair", "total", "best")])
    wide = f"{_ROW}, n_best long, count_sum long, {_PAIRS}"
    schema = _schema(wide)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, total, best = sent.value
        for batch in batches:
            lists, n = batch.column("pairs"), batch.num_rows
            doc = pc.list_parent_indices(lists).to_numpy()
            own, links = lists.flatten().to_numpy(), batch.column("links").flatten().to_numpy()
            at = np.minimum(np.searchsorted(pair, own), max(len(pair) - 1, 0))
            found = pair[at] == own if len(pair) else np.zeros(len(own), bool)
            at, d, k = at[found], doc[found], links[found]
            sums = pa.table({"doc": d, "n_best": k * best[at], "count_sum": k * total[at]}).group_by("doc", use_threads=False).aggregate(
                [("n_best", "sum"), ("count_sum", "sum")])
            n_best, count_sum = np.zeros(n, np.int64), np.zeros(n, np.int64)
            n_best[sums["doc"].to_numpy()] = sums["n_best_sum"].to_numpy()
            count_sum[sums["doc"].to_numpy()] = sums["count_sum_sum"].to_numpy()
            rest = np.concatenate([[0], np.cumsum(np.bincount(doc[~found], minlength=n))]).astype(np.int32)
            columns = [batch.column(c) for c in schema.names[:6]]
            left = [pa.ListArray.from_arrays(pa.array(rest), pa.array(x[~found])) for x in (own, links)]
            yield pa.table([*columns, pa.array(n_best), pa.array(count_sum), *left], names=schema.names).cast(schema).to_batches()[0]

    names = schema.names[:8]
    path = shared_path(spark, "scored")
    known.mapInArrow(score, wide).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    scored = spark.read.parquet(path)
    rare = scored.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row", "x.pairs", "x.links")
    rest = (rare.join(counts.filter(~hot).select(F.col("pair").alias("pairs"), "total", "best"), "pairs").groupBy("row")
            .agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("_best"), F.sum(F.col("links") * F.col("total")).alias("_sum")))
    none = F.lit(0).cast("long")
    return (scored.select("row", *names).join(rest, "row", "left")
            .select(*names[:6], (F.col("n_best") + F.coalesce("_best", none)).alias("n_best"),
                    (F.col("count_sum") + F.coalesce("_sum", none)).alias("count_sum")))


def alignment(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text",
              hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """One row for each document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum."""
    spark = docs.sparkSession
    path = shared_path(spark, "aligned")
    aligned(docs, byte_level, pieces, id_col, text_col).write.parquet(path)
    known = spark.read.parquet(path)
    counts = shared_path(spark, "pair-counts")
    pair_counts(known).write.parquet(counts)
    return link_scores(known, spark.read.parquet(counts), hot_pairs)


# ---- registered query -------------------------------------------------------

def query(spark, sf_dir: str) -> DataFrame:
    """Byte-level tokens (A) against pieces (B) for every whole text."""
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return alignment(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
