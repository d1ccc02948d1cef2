"""Token counts by heap-and-linked-list byte-pair merging.

A word's symbols stand in a linked list; a heap holds the rank of every
adjacent pair that the vocabulary can merge.  The lowest rank is popped again
and again, stale entries are passed over, and each merge removes one symbol:
the count is the number of initial symbols minus the number of merges.  No
token identifiers come out.

The vocabulary file says how a text is cut before the merges: special tokens
first (in the raw text, one token each), then composed form (NFC), lower case
and a pattern whose matches leave white space out.  Words between white space
are therefore counted alone, and each is counted once per worker process (the
memory of words is bounded and only saves time).

Edge cases: a null or empty text has no tokens and no bytes; very long texts
and words are counted whole; extra columns pass through, except those with the
names of the outputs, which are replaced; repeated rows give repeated results.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retail_spark.llm.text_udf import fresh, quoted, small_batches, without

MEMORY = 600_000      # words remembered by a worker process
LONGEST_WORD = 64     # characters of a remembered word
#: Characters that Python's split() takes for white space and the vocabulary's pattern does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SHIFT = 1 << 32


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself,
    the other bytes follow from U+0100 in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Counter:
    """Counts for a byte-level vocabulary with a word-end suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + self.end] for s in symbols]
        self.pairs: dict[int, tuple[int, int]] = {}      # left id and right id -> rank, id of the merged symbol
        for rank, (x, y) in enumerate(model["merges"]):
            self.pairs[vocab[x] * _SHIFT + vocab[y]] = (rank, vocab[x + y])
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split).findall
        self.words: dict[str, int] = {}

    def merged(self, piece: bytes) -> int:
        """Tokens of one pre-token."""
        n = len(piece)
        ids = [self.inner[b] for b in piece]
        ids[-1] = self.last[piece[-1]]
        pair_of = self.pairs.get
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        now: list[tuple[int, int] | None] = [None] * n   # rank and merged id of the pair that starts at i
        heap = []
        for i in range(n - 1):
            got = now[i] = pair_of(ids[i] * _SHIFT + ids[i + 1])
            if got:
                heap.append(got[0] * _SHIFT + i)
        heapify(heap)
        left = n
        while heap:
            rank, i = divmod(heappop(heap), _SHIFT)
            got = now[i]
            if not got or got[0] != rank:
                continue
            left -= 1
            j = nxt[i]
            k = nxt[i] = nxt[j]
            ids[i] = got[1]
            now[j] = now[i] = None
            if k < n:
                prv[k] = i
                got = now[i] = pair_of(ids[i] * _SHIFT + ids[k])
                if got:
                    heappush(heap, got[0] * _SHIFT + i)
            p = prv[i]
            if p >= 0:
                got = now[p] = pair_of(ids[p] * _SHIFT + ids[i])
                if got:
                    heappush(heap, got[0] * _SHIFT + p)
        return left

    def _plain(self, s: str) -> int:
        if not s.isascii():
            s = unicodedata.normalize("NFC", s)
            if "Σ" in s:      # lower case goes letter by letter, so the word-final form does not arise
                s = "".join([c.lower() for c in s])
        return sum([self.merged(p.encode()) for p in self.find(s.lower())])

    def _count(self, s: str) -> int:
        if "<" in s and (found := self.special.findall(s)):
            return len(found) + sum(map(self._plain, self.special.split(s)))
        return self._plain(s)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if _SEPARATORS.search(text):
            return self._count(text)
        if len(self.words) > MEMORY:
            self.words.clear()
        words, known = text.split(), self.words
        new = set(words).difference(known)
        for s in new:
            known[s] = self._count(s)
        total = sum(map(known.__getitem__, words))
        for s in new:
            if len(s) > LONGEST_WORD:
                del known[s]
        return total


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter for each worker process, kept between tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""
    small_batches(docs.sparkSession)

    @F.arrow_udf(T.LongType())
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counter(path)
        for batch in batches:
            yield pa.array([own.count(x.as_py()) for x in batch], pa.int64())

    text, size, n = F.col(quoted(text_col)), fresh(docs, "bytes"), fresh(docs, "tokens")
    counted = docs.withColumn(size, F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).withColumn(n, tokens(text))
    return (without(counted, "n_bytes", "n_tokens", "over_limit").withColumnRenamed(size, "n_bytes").withColumnRenamed(n, "n_tokens")
            .withColumn("over_limit", F.col("n_tokens") > limit))


# ---- registered query -------------------------------------------------------

def query(spark, sf_dir: str) -> DataFrame:
    """Tokens of every whole text by the lower-case word vocabulary, and whether they pass 2048."""
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, P.path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
