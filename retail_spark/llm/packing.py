"""Token-id output: best-fit-decreasing packing into fixed-length rows.

Texts become token ids; a text longer than a row is cut into row-long pieces
and a rest, so no id is lost.  The pieces of a task are packed by best fit
decreasing: longest first, each into the row whose free capacity is the smallest
that still takes it.  A segment tree over the capacities 0 .. row length finds
that row in as many steps as the tree is deep, however many rows are open.

Each task packs its own partition, ``window`` ids at a time, so ids are never
shuffled and memory stays bounded; what is lost against one global packing is
at most one window's last rows.  The output has one row for each matrix: a
block of packed rows as raw little-endian ids, with the cumulative segment
lengths and the places where positions restart for each of its rows.  It is
written by Spark (``write_packed``), so lost tasks are simply run again.

Edge cases: null and empty texts are segments of length zero (their ids are
listed, they take no room); texts of any length are kept whole; repeated rows
are packed again; an empty table gives no matrices; only the id and text columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_spark.llm.byte_bpe import Codec
from retail_spark.llm.text_udf import quoted, small_batches

ROW = 2048            # ids of a packed row
WINDOW = 1 << 23      # ids that a task packs together
BLOCK = 64            # packed rows of a matrix
SCHEMA = ("matrix_id string, n_rows int, row_length int, n_tokens long, ids binary, cu_seqlens array<array<int>>, "
          "position_resets array<array<int>>, doc_ids array<array<long>>, doc_starts array<array<int>>")
_INTS, _LONGS = pa.list_(pa.list_(pa.int32())), pa.list_(pa.list_(pa.int64()))
_ARROW = pa.schema([("matrix_id", pa.string()), ("n_rows", pa.int32()), ("row_length", pa.int32()), ("n_tokens", pa.int64()), ("ids", pa.binary()),
                    ("cu_seqlens", _INTS), ("position_resets", _INTS), ("doc_ids", _LONGS), ("doc_starts", _INTS)])


class CapacityTree:
    """Segment tree over free capacities; a leaf holds the rows with that much room, a node how many lie below it."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        node = self.leaves + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, row) of the smallest capacity of at least ``need``."""
        count, node = self.count, self.leaves + need
        while not count[node]:           # climb to the nearest subtree on the right that holds a row
            while node & 1:
                node >>= 1
            if node == 0:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(lengths: list[int], row: int) -> list[list[int]]:
    """Positions in ``lengths`` for each packed row; equal lengths keep their order."""
    tree, out = CapacityTree(row), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        got = tree.take(lengths[i])
        if got is None:
            got = (row, len(out))
            out.append([])
        out[got[1]].append(i)
        tree.add(got[0] - lengths[i], got[1])
    return out


class LibraryCodec(Codec):
    """The codec with the merges left to tiktoken: packing needs ids, not this library's own merging.

    It keeps no queue and no pre-tokens, so more texts go together and more cuts are remembered."""

    together, memory = 1 << 21, 80 << 20

    def __init__(self, path: str, pattern: str):
        super().__init__(path, pattern)
        self.library = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(self.library.encode_ordinary(t), dtype="<u4").tobytes() for t in texts]


_CODECS: dict[tuple[str, str], LibraryCodec] = {}


def _codec(path: str, pattern: str) -> LibraryCodec:
    """One codec for each worker process, kept between tasks."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = LibraryCodec(path, pattern)
    return _CODECS[path, pattern]


def _matrices(pieces: list[tuple[int | None, int, np.ndarray]], row: int, pad: int, dtype: str, name: str) -> Iterator[pa.RecordBatch]:
    """Pack pieces (doc id, first token in the document, ids) and yield matrices of at most BLOCK rows."""
    packed = best_fit_decreasing([len(p[2]) for p in pieces], row)
    for at in range(0, len(packed), BLOCK):
        block = packed[at:at + BLOCK]
        matrix = np.full((len(block), row), pad, dtype=dtype)
        cu, resets, docs, starts, n = [], [], [], [], 0
        for r, members in enumerate(block):
            ends = [0]
            for i in members:
                ids = pieces[i][2]
                matrix[r, ends[-1]:ends[-1] + len(ids)] = ids
                ends.append(ends[-1] + len(ids))
            n += ends[-1]
            cu.append(ends)
            resets.append([a for a, b in zip(ends, ends[1:]) if b > a])
            docs.append([pieces[i][0] for i in members])
            starts.append([pieces[i][1] for i in members])
        yield pa.RecordBatch.from_pylist([{
            "matrix_id": f"{name}-{at // BLOCK:05d}", "n_rows": len(block), "row_length": row, "n_tokens": n, "ids": matrix.tobytes(),
            "cu_seqlens": cu, "position_resets": resets, "doc_ids": docs, "doc_starts": starts}], schema=_ARROW)


def pack(docs: DataFrame, path: str, pattern: str, pad: int, id_col: str = "doc_id", text_col: str = "text", row: int = ROW) -> DataFrame:
    """Matrices of packed rows of ``row`` ids over all of ``docs`` (integer ids), filled up with ``pad``.

    Ids are unsigned 16-bit if the pad and all ranks allow it, else 32-bit.
    matrix_id: partition, window and number of the block."""
    small_batches(docs.sparkSession)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = _codec(path, pattern), TaskContext.get().partitionId()
        dtype = "<u2" if max(pad, *own.ranks.values()) < 1 << 16 else "<u4"
        pieces: list[tuple[int | None, int, np.ndarray]] = []
        held, window = 0, 0
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), own.encode(batch.column(1).to_pylist()), strict=True):
                ids = np.frombuffer(raw, dtype="<u4").astype(dtype)
                for at in range(0, max(1, len(ids)), row):
                    pieces.append((doc_id, at, ids[at:at + row]))
                held += len(ids)
                if held >= WINDOW:
                    yield from _matrices(pieces, row, pad, dtype, f"{part:06d}-{window:04d}")
                    pieces, held, window = [], 0, window + 1
        if pieces:
            yield from _matrices(pieces, row, pad, dtype, f"{part:06d}-{window:04d}")

    return docs.select(F.col(quoted(id_col)).cast("long"), F.col(quoted(text_col))).mapInArrow(packed, SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the matrices below ``path`` (Parquet files with the raw id bytes as binary values)."""
    packed.write.mode("overwrite").parquet(path)


# ---- registered query -------------------------------------------------------

def query(spark, sf_dir: str) -> DataFrame:
    """All documents as packed rows of 2048 ids of the multilingual byte-level vocabulary; 50256 fills up."""
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, 50256)
