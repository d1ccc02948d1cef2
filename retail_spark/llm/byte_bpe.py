"""Byte-level BPE encoding and decoding of whole texts.

Merging uses a rank queue in the form of a hierarchical bitmap.  Every merge
rank has a bucket with the linked-list positions of the pairs that have this
rank; three levels of 64-bit words say which buckets hold anything, and
find-first-set on them gives the next rank.  An entry is stale when the pair at
its position has another rank by now, and is skipped when it comes up.  A merge
costs a few word operations whatever the length of the pre-token, so a text that
is one unbroken run of letters takes time in proportion to its length.  The
pre-tokens of a batch of texts share one queue.

Pre-tokens never reach across a space that stands between two visible
characters, so a text is cut there and each cut is encoded once per worker
process (the memory of cuts is bounded and only saves time).

Edge cases: a null or empty text gives no ids and decodes to no bytes; very
long texts are encoded whole; extra columns pass through, except those with the
names of the outputs, which are replaced; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retail_spark.llm.text_udf import fresh, quoted, small_batches, without

MEMORY = 56 << 20      # bytes of the cuts that a worker process remembers for sure (and a quarter of that for pre-tokens), at most twice that
LONGEST_CUT = 64       # characters of a remembered cut
ENTRY = 150            # bytes of a remembered entry beside its characters and ids
TOGETHER = 1 << 19     # characters of the texts that share a queue; one longer text has it alone
_APART = re.compile(r" (?:\s|$)")   # white space after a space: such texts go through the pattern as a whole


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Ranks:
    """The merge ranks, which are the token ids too, with those of single bytes and byte pairs as arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        self.of = ranks
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.pair = np.full(1 << 16, -1, np.int32)
        for token, r in ranks.items():
            if len(token) == 2:
                self.pair[token[0] << 8 | token[1]] = r


def merge_all(pieces: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pre-tokens in a row, and how many each has: lowest rank first, leftmost first among equals.

    All pre-tokens share one queue: they do not touch each other, so taking ranks
    in order over all of them takes them in order within each.  A pre-token
    whose merge makes a pair of lower rank gets it served before its other pairs.
    """
    data = b"\0".join(pieces) + b"\0"
    size = len(data)
    raw = np.frombuffer(data, np.uint8)
    ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
    boxed = list if size <= TOGETHER else partial(array, "i")    # long pre-tokens: four bytes a position instead of a boxed number
    first = np.full(size + 1, -1, np.int32)                      # rank of the pair that starts at a position
    first[:size - 1] = ranks.pair[raw[:-1].astype(np.int32) << 8 | raw[1:]]
    first[ends] = -1
    first[np.maximum(ends - 1, 0)] = -1
    following, before = np.arange(1, size + 1, dtype=np.int32), np.arange(-1, size - 1, dtype=np.int32)
    following[ends] = 0                                          # an end: no part begins here
    before[0] = -1
    before[ends[:-1] + 1] = -1
    part = ranks.byte[raw]                                       # id of the part that begins at a position, -1: none does
    part[ends] = -1
    nxt, prv, part = (boxed(x.tolist()) for x in (following, before, part))     # part i spans data[i:nxt[i]]
    now = boxed(first.tolist())                                  # another rank than an entry's makes that entry stale
    rank_of = ranks.of.get
    # positions of each rank in descending order, unless in unsorted
    down = np.flatnonzero(first >= 0)[::-1]
    down = down[np.argsort(first[down], kind="stable")]
    found, at = np.unique(first[down], return_index=True)
    bucket: dict[int, list[int]] = {r: x.tolist() for r, x in zip(found.tolist(), np.split(down, at[1:]))}
    unsorted: set[int] = set()
    low: dict[int, int] = {}             # bit r & 63 of low[r >> 6]: bucket r holds something
    mid: dict[int, int] = {}             # bit b & 63 of mid[b >> 6]: low[b] is not zero
    top = 0                              # bit a: mid[a] is not zero
    for r in bucket:
        low[r >> 6] = low.get(r >> 6, 0) | 1 << (r & 63)
    for b in low:
        mid[b >> 6] = mid.get(b >> 6, 0) | 1 << (b & 63)
    for a in mid:
        top |= 1 << a
    while top:
        a = (top & -top).bit_length() - 1
        m = mid[a]
        b = (a << 6) + (m & -m).bit_length() - 1
        w = low[b]
        r = (b << 6) + (w & -w).bit_length() - 1
        entries = bucket[r]
        if r in unsorted:
            entries.sort(reverse=True)
            unsorted.discard(r)
        while entries:
            i = entries.pop()
            if now[i] != r:
                continue
            j = nxt[i]                   # the part at j joins the part at i
            k = nxt[i] = nxt[j]
            now[j] = part[j] = -1
            part[i] = r
            lower = False
            e = nxt[k]
            if e:
                prv[k] = i
                r2 = now[i] = rank_of(data[i:e], -1)
                if r2 >= 0:
                    lower = r2 < r
                    if r2 in bucket:
                        bucket[r2].append(i)
                        unsorted.add(r2)
                    else:
                        bucket[r2] = [i]
                        c = r2 >> 6
                        low[c] = low.get(c, 0) | 1 << (r2 & 63)
                        d = c >> 6
                        mid[d] = mid.get(d, 0) | 1 << (c & 63)
                        top |= 1 << d
            else:
                now[i] = -1
            p = prv[i]
            if p >= 0:
                r2 = now[p] = rank_of(data[p:k], -1)
                if r2 >= 0:
                    lower = lower or r2 < r
                    if r2 in bucket:
                        bucket[r2].append(p)
                        unsorted.add(r2)
                    else:
                        bucket[r2] = [p]
                        c = r2 >> 6
                        low[c] = low.get(c, 0) | 1 << (r2 & 63)
                        d = c >> 6
                        mid[d] = mid.get(d, 0) | 1 << (c & 63)
                        top |= 1 << d
            if lower:
                break
        if not entries:
            del bucket[r]
            unsorted.discard(r)
            low[b] = w = low[b] & ~(1 << (r & 63))
            if not w:
                mid[a] = m = mid[a] & ~(1 << (b & 63))
                if not m:
                    top &= ~(1 << a)
    ids = np.array(part, np.int32)
    counts = np.diff(np.concatenate([[0], np.cumsum(ids >= 0)[ends]]))
    return ids[ids >= 0], counts


class Remembered:
    """Results by key in two generations: ``room`` bytes of the last new keys at least, twice as much at most."""

    def __init__(self, room: int):
        self.room, self.now, self.old, self.held = room, {}, {}, 0

    def missing(self, keys: set[str]) -> list[str]:
        """Keys without a result; results of the older generation that are asked for move to the newer one."""
        rest = []
        for k in keys.difference(self.now):
            if k in self.old:
                self.now[k] = self.old[k]
                self.held += ENTRY + len(k) + len(self.old[k])
            else:
                rest.append(k)
        return rest

    def trim(self, new: list[str]) -> None:
        """Forget the long ones among ``new`` keys, and the older generation when the newer one is full."""
        for k in new:
            if len(k) > LONGEST_CUT:
                del self.now[k]
            else:
                self.held += ENTRY + len(k) + len(self.now[k])
        if self.held > self.room:
            self.now, self.old, self.held = {}, self.now, 0


class Codec:
    """Encoder and decoder for one rank file and pre-token pattern, with bounded memory."""

    together, memory = TOGETHER, MEMORY

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.queue = Ranks(self.ranks)
        self.bytes_of = bytes_by_id(self.ranks)
        self.find = regex.compile(pattern).findall
        self.tokens = Remembered(self.memory // 4)
        self.cuts = Remembered(self.memory)      # what follows a space, up to the next one

    def plain(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, without the memory of cuts."""
        spelled = [self.find(t) for t in texts]
        new = self.tokens.missing(set().union(*spelled))
        known, rest = self.tokens.now, []
        for s in new:
            whole = self.ranks.get(s.encode())
            if whole is None:
                rest.append(s)
            else:
                known[s] = whole.to_bytes(4, "little")
        if rest:
            ids, counts = merge_all([s.encode() for s in rest], self.queue)
            packed, at = ids.astype("<u4").tobytes(), 0
            for s, n in zip(rest, (4 * counts).tolist(), strict=True):
                known[s] = packed[at:at + n]
                at += n
        out = [b"".join(map(known.__getitem__, x)) for x in spelled]
        self.tokens.trim(new)
        return out

    def _group(self, texts: list[str]) -> list[bytes]:
        whole = [bool(_APART.search(t)) for t in texts]
        split = [[t] if w else t.split(" ") for t, w in zip(texts, whole, strict=True)]
        new = self.cuts.missing(set().union(*[s[1:] for s in split]))
        # the first cut of a text has no space before it
        encoded = self.plain([" " + s for s in new] + [s[0] for s in split])
        known = self.cuts.now
        known.update(zip(new, encoded))
        out = [b"".join(chain((first,), map(known.__getitem__, s[1:]))) for s, first in zip(split, encoded[len(new):], strict=True)]
        self.cuts.trim(new)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; texts are taken some TOGETHER characters at a time."""
        out, group, held = [], [], 0
        for t in texts:
            group.append(t or "")
            held += len(group[-1])
            if held >= self.together:
                out += self._group(group)
                group, held = [], 0
        return out + self._group(group)

    def decode(self, ids: bytes | None) -> bytes:
        return spelled(ids, self.bytes_of)


def bytes_by_id(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, r in ranks.items():
        out[r] = token
    return out


def spelled(ids: bytes | None, bytes_of: list[bytes]) -> bytes:
    return b"".join(map(bytes_of.__getitem__, memoryview(ids).cast("I"))) if ids else b""


_CODECS: dict[tuple[str, str], Codec] = {}
_SPELLINGS: dict[str, list[bytes]] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process, kept between tasks."""
    key = (path, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(path, pattern)
    return _CODECS[key]


def spellings(path: str) -> list[bytes]:
    """The bytes of each id, which is all that decoding needs."""
    if path not in _SPELLINGS:
        _SPELLINGS[path] = bytes_by_id(load_ranks(path))
    return _SPELLINGS[path]


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids",
           count_col: str = "n_tokens") -> DataFrame:
    """Add ``ids_col`` (binary, little-endian unsigned 32-bit ids) and ``count_col`` (long)."""
    small_batches(docs.sparkSession)

    @F.arrow_udf(T.BinaryType())
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for batch in batches:
            yield pa.array(own.encode(batch.to_pylist()), pa.binary())

    tmp = fresh(docs, "ids")
    return (without(docs.withColumn(tmp, ids(F.col(quoted(text_col)))), ids_col, count_col)
            .withColumnRenamed(tmp, ids_col).withColumn(count_col, F.expr(f"octet_length({quoted(ids_col)}) div 4").cast("long")))


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add ``out_col``: the bytes that the ids of ``ids_col`` stand for."""
    small_batches(encoded.sparkSession)

    @F.arrow_udf(T.BinaryType())
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bytes_of = spellings(path)
        for batch in batches:
            yield pa.array([spelled(x.as_py(), bytes_of) for x in batch], pa.binary())

    return without(encoded, out_col).withColumn(out_col, text(F.col(quoted(ids_col))))


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Add ``ids``, ``n_tokens`` and the digest ``decoded_sha256`` of what the ids decode to.

    One pass of one worker: the decoded bytes are digested where they are made and do not travel.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("ids binary, decoded_sha256 string")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for batch in batches:
            ids = own.encode(batch.to_pylist())
            digests = [hashlib.sha256(own.decode(x)).hexdigest() for x in ids]
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(digests)], ["ids", "decoded_sha256"])

    coded = fresh(docs, "coded")
    kept = without(docs, "ids", "n_tokens", "decoded_sha256").columns
    return (docs.withColumn(coded, both(F.col(quoted(text_col))))
            .select(*[F.col(quoted(c)) for c in kept], F.col(coded)["ids"].alias("ids"),
                    F.expr(f"octet_length({coded}.ids) div 4").cast("long").alias("n_tokens"), F.col(coded)["decoded_sha256"].alias("decoded_sha256")))


# ---- registered query -------------------------------------------------------

def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, with the multilingual rank file."""
    import public_tokenizers as P

    both = round_trip(docs.select("doc_id", "text"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    """Encode every whole text, decode the ids again, and return digests of both."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
