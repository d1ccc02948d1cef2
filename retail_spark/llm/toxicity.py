"""Toxicity by fuzzy lexicon hits in their context.

A lexicon of words and word stems is mined from labelled rows.  Its trie is
intersected with Levenshtein automata: a state is the set of (trie node, edits
spent) pairs that the letters read so far allow, so one pass over a word
compares it with every lexicon word at once, and a word is given up as soon as
the set is empty.  States are built when first needed and kept; the verdict on
the first four and six letters is remembered, so most words cost one look-up.

Every hit is then weighed by its window of five tokens on either side:
quotation marks, reporting words or talk about words speak for quotation, the
second person and exclamation for abuse.  A small logistic model turns the sums
into a score.

Labels are only used from training rows; lang, source and identifiers are never
inputs.  The lexicon and the logistic model are cross-fitted on two halves of the
training rows (see ``fit``).  They use a bounded sample of labelled rows
(``max_train``, in hash order), so the fit costs the same at every corpus size;
scoring reads every document whole, in its own row, without a shuffle.

Edge cases: null and empty texts get the score of a text without hits; rows
without labels are only scored; repeated rows get equal scores; no labels at
all, or only one class, fall back to the fixed seed lexicon and weights; extra
columns pass through, except those with the names of the outputs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retail_spark.llm.text_udf import fresh, quoted, small_batches, without
from retail_spark.session import cut_lineage

#: Fixed seed words; mined entries come on top.
SEEDS = ("idiot", "moron", "stupid", "scum", "pathetic", "worthless", "disgusting", "loser", "trash", "imbecile", "bastard", "retard")
SEED_WEIGHT = 3.0
REPORTING = frozenset("said says say called calls wrote writes quote quoted quotes word words term phrase insult insulted slur means meaning "
                      "dit mot terme appelé sagte wort nannte bedeutet dijo palabra llamó significa".split())
PERSON = frozenset("you your you're youre yours u ur du dich dir dein deine tu toi te ton ta vous votre tú usted ustedes vosotros su".split())
QUOTES = "\"“”„«»‘’`"
STRIP = "!?.,;:()[]{}<>|#$%&*_-=+/\\~^'…¡¿" + QUOTES
FEATURES = ("exact", "fuzzy", "quoted", "abuse", "dense", "kinds")
#: Used when the labels cannot be fitted: intercept, then one weight for each feature.
DEFAULT = (-4.0, 1.0, 0.5, -0.5, 0.5, 0.5, 1.0)
WINDOW = 5
MEMORY = 200_000       # words whose match a worker process remembers


@dataclass(frozen=True)
class Entry:
    """``stem``: matches every longer word that begins with it, without edits."""
    word: str
    weight: float
    stem: bool = False

    @property
    def edits(self) -> int:
        return 0 if self.stem or len(self.word) < 5 else 1 if len(self.word) < 9 else 2


class FuzzyTrie:
    """Levenshtein automata of all entries, intersected with their trie and made deterministic on demand."""

    def __init__(self, entries: list[Entry]):
        self.children: list[dict[str, int]] = [{}]
        self.word: dict[int, Entry] = {}
        self.stem: dict[int, float] = {}
        self.room = [0]                      # edits that some entry below a node allows
        for e in entries:
            at, path = 0, [0]
            for c in e.word:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.room.append(0)
                at = self.children[at][c]
                path.append(at)
            for node in path:
                self.room[node] = max(self.room[node], e.edits)
            if e.stem:
                self.stem[at] = max(self.stem.get(at, 0.0), e.weight)
            elif at not in self.word or self.word[at].weight < e.weight:
                self.word[at] = e
        self.known: dict[tuple, int] = {}
        self.sets: list[dict[int, int]] = []
        self.next: list[dict[str, int]] = []
        self.start = self._state({0: 0})
        self.dead = self._state({})
        self.alive = _Prefixes(self)
        self.seen: dict[str, tuple[float, int] | None] = {}

    def _state(self, nodes: dict[int, int]) -> int:
        todo = list(nodes.items())
        while todo:                          # a letter of the entry may be missing from the word
            node, e = todo.pop()
            for child in self.children[node].values():
                if e + 1 <= self.room[child] and e + 1 < nodes.get(child, 99):
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        key = tuple(sorted(nodes.items()))
        if key not in self.known:
            self.known[key] = len(self.sets)
            self.sets.append(dict(key))
            self.next.append({})
        return self.known[key]

    def step(self, state: int, c: str) -> int:
        got = self.next[state].get(c)
        if got is None:
            new: dict[int, int] = {}
            for node, e in self.sets[state].items():
                if e + 1 <= self.room[node]:                       # one letter too many in the word
                    new[node] = min(e + 1, new.get(node, 99))
                for letter, child in self.children[node].items():
                    cost = e + (letter != c)
                    if cost <= self.room[child]:
                        new[child] = min(cost, new.get(child, 99))
            got = self.next[state][c] = self._state(new)
        return got

    def best(self, word: str) -> tuple[float, int] | None:
        """``match``, remembered for the words met lately (bounded, only saves time)."""
        if word not in self.seen:
            if len(self.seen) >= MEMORY:
                self.seen.clear()
            self.seen[word] = self.match(word)
        return self.seen[word]

    def match(self, word: str) -> tuple[float, int] | None:
        """The weight and edits of the best entry for a word: fewest edits, then largest weight."""
        state, best = self.start, None
        for n, c in enumerate(word):
            state = self.step(state, c)
            if state == self.dead:
                return best
            if self.stem and n + 1 < len(word):
                for node, e in self.sets[state].items():
                    if e == 0 and node in self.stem and (best is None or self.stem[node] > best[0]):
                        best = (self.stem[node], 0)
        for node, e in self.sets[state].items():
            entry = self.word.get(node)
            if entry is not None and e <= entry.edits and (best is None or (e, -entry.weight) < (best[1], -best[0])):
                best = (entry.weight, e)
        return best


class _Prefixes(dict):
    """First letters (four or six) -> whether any entry is still possible after them, or a stem was passed on the way."""

    def __init__(self, trie: FuzzyTrie):
        super().__init__()
        self.trie = trie

    def __missing__(self, prefix: str) -> bool:
        t = self.trie
        state, found = t.start, False
        for c in prefix:
            state = t.step(state, c)
            found = found or any(e == 0 and node in t.stem for node, e in t.sets[state].items())
        self[prefix] = found = found or state != t.dead
        return found


def context(tokens: list[str], at: int) -> tuple[bool, bool]:
    """Whether the window around a hit speaks for quotation, and for abuse."""
    near = tokens[max(0, at - WINDOW):at + WINDOW + 1]
    bare = [t.strip(STRIP) for t in near]
    inside = sum(t.count(q) for t in tokens[max(0, at - WINDOW):at] for q in "\"“„«") % 2 == 1 or tokens[at][:1] in QUOTES
    quoted_hit = (inside and any(q in t for t in tokens[at:at + WINDOW + 1] for q in "\"”“»")) or any(b in REPORTING for b in bare)
    return quoted_hit, any(b in PERSON for b in bare) or any(t.endswith("!") and not t.endswith("!!!!") for t in tokens[at:at + 3])


def features(text: str | None, trie: FuzzyTrie) -> tuple[float, ...]:
    """FEATURES of one whole text; each distinct word counts once for each kind of context."""
    tokens = text.lower().split() if text else []
    alive = trie.alive
    hits: dict[str, tuple[float, int]] = {}
    for t in set(tokens):
        w = t.strip(STRIP)
        if alive[w[:4]] and alive[w[:6]] and (got := trie.best(w)):
            hits[t] = got
    if not hits:
        return (0.0,) * len(FEATURES)
    exact, fuzzy, quoted_sum, abuse = {}, {}, {}, {}
    for at, t in enumerate(tokens):
        got = hits.get(t)
        if got is None:
            continue
        w, (weight, edits) = t.strip(STRIP), got
        q, a = context(tokens, at)
        if q:
            quoted_sum[w] = weight
            continue
        (fuzzy if edits else exact)[w] = weight
        if a:
            abuse[w] = weight
    x, f, q, a = (sum(d.values()) for d in (exact, fuzzy, quoted_sum, abuse))
    return (math.log1p(x), math.log1p(f), math.log1p(q), math.log1p(a), (x + f) / math.sqrt(len(tokens)), math.log1p(len(exact)))


_TRIES: dict[tuple[Entry, ...], FuzzyTrie] = {}


def _trie(entries: tuple[Entry, ...]) -> FuzzyTrie:
    if entries not in _TRIES:
        _TRIES.clear()
        _TRIES[entries] = FuzzyTrie(list(entries))
    return _TRIES[entries]


def add_features(docs: DataFrame, entries: tuple[Entry, ...], text_col: str, out: str) -> DataFrame:
    small_batches(docs.sparkSession)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def values(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _trie(entries)
        for batch in batches:
            yield pa.array([features(x.as_py(), own) for x in batch], pa.list_(pa.float64()))

    return docs.withColumn(out, values(F.col(quoted(text_col))))


# ---- fit --------------------------------------------------------------------

def _terms(text: str) -> set[str]:
    out = set()
    for w in {t.strip(STRIP) for t in text.lower().split()}:
        if w.isalpha() and len(w) >= 4:
            out.add(w)
            out.update(w[:k] + "*" for k in range(5, min(9, len(w))))
    return out


def mine(train: DataFrame, max_terms: int = 400, min_docs: int = 4, min_odds: float = 2.0) -> tuple[Entry, ...]:
    """Lexicon entries (words, and stems marked ``*`` while counting) that toxic training rows (text, toxic) hold
    far oftener than others.  Counts are summed in each task before they are shuffled."""

    def counted(batches):
        toxic, other = Counter(), Counter()
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                (toxic if label else other).update(_terms(text or ""))
        names = [*{**toxic, **other}]
        for k in range(0, len(names), 50_000):
            part = names[k:k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[n] for n in part], pa.int64()),
                                              pa.array([other[n] for n in part], pa.int64())], ["term", "t", "o"])

    n = train.agg(F.sum(F.col("toxic")).alias("t"), F.sum(1 - F.col("toxic")).alias("o")).first()
    if not n["t"] or not n["o"]:
        return tuple(Entry(w, SEED_WEIGHT) for w in SEEDS)
    odds = F.log((F.col("t") + 0.5) / (n["t"] + 1.0)) - F.log((F.col("o") + 0.5) / (n["o"] + 1.0))
    rows = (train.select("text", "toxic").mapInArrow(counted, "term string, t long, o long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
            .filter(F.col("t") >= min_docs).withColumn("odds", odds).filter(F.col("odds") >= min_odds)
            .orderBy(F.desc(F.col("odds") * F.sqrt("t")), "term").limit(max_terms).collect())
    found = {r["term"]: r["odds"] for r in rows}
    out = {w: Entry(w, SEED_WEIGHT) for w in SEEDS}
    for term, w in sorted(found.items()):
        bare = term.rstrip("*")
        if any(found.get(bare[:k] + "*", -99.0) >= w - 0.5 for k in range(5, len(bare) + (term == bare))):
            continue          # a shorter stem says as much
        if not (term != bare and found.get(bare, -99.0) >= w - 0.5):
            out[term] = Entry(bare, min(w, 6.0), term != bare)
    # whole words stay whole entries, so that their misspellings count too
    out |= {t: Entry(t, min(w, 6.0)) for t, w in found.items() if not t.endswith("*") and w >= 4.0}
    return tuple(sorted(out.values(), key=lambda e: (e.word, e.stem)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; the intercept is free."""
    if len(y) == 0 or y.min() == y.max():
        return DEFAULT
    a = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(a.shape[1]), np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def id_remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


@dataclass(frozen=True)
class Model:
    entries: tuple[Entry, ...]
    weights: tuple[float, ...]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = 6000) -> Model:
    """Fit on at most ``max_train`` labelled rows whose id remainder is not 1, taken in hash order.

    The logistic weights see each half of them (remainder 0, remainder 2) through the lexicon of the other
    half, so that no row is judged by terms it gave itself; the lexicon that is kept comes from both halves."""
    key = F.col(quoted(id_col))
    some = (labels.select(key.alias("id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("id").agg(F.max("toxic").alias("toxic"))
            .filter(id_remainder(F.col("id")) != 1).orderBy(F.xxhash64("id"), "id").limit(max_train))
    rows = docs.select(key.alias("id"), F.col(quoted(text_col)).alias("text")).join(F.broadcast(some), "id")   # at most max_train rows
    train = cut_lineage(rows)
    half = [train.filter(id_remainder(F.col("id")) == r).select("id", "text", "toxic") for r in (0, 2)]
    sums = add_features(half[0], mine(half[1]), "text", "x").unionByName(add_features(half[1], mine(half[0]), "text", "x"))
    got = sums.select("x", "toxic").orderBy(F.xxhash64("id", "x"), "toxic").limit(max_train).collect()
    weights = fit_logistic(np.array([r["x"] for r in got]).reshape(-1, len(FEATURES)), np.array([r["toxic"] for r in got], dtype=float))
    return Model(mine(train), weights)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``, the probability of the label toxic = 1."""
    x = fresh(docs, "features")
    logit = F.lit(model.weights[0])
    for k, w in enumerate(model.weights[1:]):
        logit = logit + F.lit(w) * F.get(F.col(x), F.lit(k))
    scored = without(add_features(docs, model.entries, text_col, x), out)
    return scored.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))).drop(x)


# ---- registered query -------------------------------------------------------

def query(spark, sf_dir: str) -> DataFrame:
    """Score every whole text; labels of rows with id remainder 1 are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (id_remainder(F.col("doc_id")) == 1).alias("held_out"), "score",
                                     (F.col("score") >= 0.7).cast("int").alias("predicted"))
