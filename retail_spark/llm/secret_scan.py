"""Secret scan with corpus-wide ownership frequency.

Every text is searched for candidate credentials.  The hash of a candidate's
value is then counted over the whole corpus by distinct owners and distinct
repositories: a value that several owners hold, or that lies in many
repositories of few owners, is a copied example; a value that stays in few
places and looks random is treated as live.

The scan runs once; its result (spans and hashes, no text unless asked for) is
checkpointed into the shared folder.  The ownership count first reduces the
candidates to distinct (value, owner, repository) triples with map-side
combining, so a value in a third of all rows costs one row per task; the join
back runs only over rows that hold a candidate and is an ordinary shuffle join,
which adaptive execution splits where one value is hot.

Edge cases: a null or empty text has no spans; null owners count together as
one owner (so do null repositories); texts of any length are searched whole;
repeated rows are rows of the same owner and give repeated results; an empty
table gives an empty result; extra columns pass through, except those with the
names of the outputs, which are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retail_spark.llm.text_udf import fresh, quoted, small_batches, without
from retail_spark.session import cut_lineage

#: kind -> (pattern, group with the value, least length of the value); the first three are the base kinds.
#: A match is consumed even when its value is too short to count.
KINDS: dict[str, tuple[str, int, int]] = {
    "assign": (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"""
               r"""[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "pem": (r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )?PRIVATE KEY-----", 0, 64),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 32),
    "vendor": (r"(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,})", 0, 14),
    "url": (r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:([^\s:/@]{3,128})@", 1, 3),
}
BASE = ("assign", "access", "hex")
#: A match needs one of these strings in the text; texts without them are not searched for the kind.
NEEDS = {"assign": (":", "="), "access": ("AKIA",), "pem": ("-----BEGIN ",), "jwt": ("eyJ",),
         "vendor": ("gh", "xox", "AIza", "sk_live_"), "url": ("://",)}
PLACEHOLDER = re.compile(r"(?i)example|sample|change_?me|your[_-]|dummy|placeholder|redacted|x{6}|\*{3}|(.)\1{7}|012345|abcdef0|123456")

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                     T.StructField("value_start", T.IntegerType()), T.StructField("value_end", T.IntegerType()),
                     T.StructField("value_hash", T.StringType()), T.StructField("random", T.BooleanType())])
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32()),
                             ("value_end", pa.int32()), ("value_hash", pa.string()), ("random", pa.bool_())]))
_COMPILED = {k: re.compile(p) for k, (p, _, _) in KINDS.items()}
_PART = re.compile(r"[A-Za-z0-9_-]+")


def jwt_spans(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the jwt pattern, found over its dot-separated parts: time in proportion to the text, whatever it repeats."""
    parts = [m.span() for m in _PART.finditer(text)]
    i = 0
    while i + 2 < len(parts):
        (a, a_end), (b, b_end), (c, c_end) = parts[i:i + 3]
        found = -1
        if b - a_end == c - b_end == 1 and text[a_end] == text[b_end] == "." and b_end - b >= 8 and c_end - c >= 8:
            found = text.find("eyJ", a, max(a, a_end - 8))            # eight characters follow it in its part
        if found >= 0:
            yield found, c_end
        i += 3 if found >= 0 else 1


def matches(kind: str, text: str) -> Iterator[tuple[int, int, int, int]]:
    """start, end, start of the value, end of the value."""
    if kind == "jwt":
        yield from ((a, b, a, b) for a, b in jwt_spans(text))
    else:
        group = KINDS[kind][1]
        yield from ((*m.span(), *m.span(group)) for m in _COMPILED[kind].finditer(text))


def looks_random(value: str) -> bool:
    """At least 12 characters, three bits of entropy per character, and no placeholder wording."""
    if len(value) < 12 or PLACEHOLDER.search(value):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= 3.0


def find_spans(text: str | None) -> list[dict]:
    """All spans of one text in order of start, then kind as listed (code points, end exclusive)."""
    if not text:
        return []
    out = []
    for order, (kind, (_, _, least)) in enumerate(KINDS.items()):
        if kind in NEEDS and not any(s in text for s in NEEDS[kind]):
            continue
        for start, end, a, b in matches(kind, text):
            if b - a >= least:
                value = text[a:b]
                out.append((start, order, {
                    "kind": kind, "start": start, "end": end, "value_start": a, "value_end": b,
                    "value_hash": blake2b(value.encode(), digest_size=16).hexdigest(), "random": looks_random(value)}))
    out.sort(key=lambda x: x[:2])
    return [x[2] for x in out]


def scan(docs: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """Add ``out``: the array of spans of each text."""
    small_batches(docs.sparkSession)

    @F.arrow_udf(T.ArrayType(SPAN))
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([find_spans(x.as_py()) for x in batch], _ARROW)

    tmp = fresh(docs, "spans")
    return without(docs.withColumn(tmp, spans(F.col(quoted(text_col)))), out).withColumnRenamed(tmp, out)


def ownership(candidates: DataFrame) -> DataFrame:
    """value_hash, n_owners, n_repos over candidates (value_hash, owner, repo).

    Two distinct-then-count steps; each shuffles partial aggregates only."""
    triples = candidates.select("value_hash", "owner", "repo").distinct()
    repos = triples.groupBy("value_hash").agg(F.count(F.lit(1)).alias("n_repos"))
    owners = triples.select("value_hash", "owner").distinct().groupBy("value_hash").agg(F.count(F.lit(1)).alias("n_owners"))
    return owners.join(repos, "value_hash")


def classify(scanned: DataFrame, rid: str, owner: Column, repo: Column, out: str = "secrets", min_owners: int = 3,
             min_repos: int = 8) -> DataFrame:
    """Add to every span of ``scanned`` n_owners, n_repos and class; drops ``rid``.

    ``scanned`` is a stored result of ``scan`` with a unique row id ``rid`` in it
    (stored, so that a lost task cannot number the rows anew).  A repository is
    a pair of owner and repo.  class: ``example`` when at least ``min_owners``
    owners or ``min_repos`` repositories hold the value, else ``live`` when it
    looks random, else ``weak``.
    """
    cols = [c for c in scanned.columns if c != rid]
    none = scanned.filter(F.size(out) == 0).drop(rid)
    some = scanned.filter(F.size(out) > 0)
    counted = fresh(scanned, "held")
    found = some.select(F.col(rid).alias("rid"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
                        F.coalesce(repo.cast("string"), F.lit("")).alias("repo"),
                        F.explode(F.array_distinct(F.col(f"{out}.value_hash"))).alias("value_hash"))
    counts = found.select("rid", "value_hash").join(ownership(found), "value_hash")
    held = counts.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct(
        "value_hash", F.struct("n_owners", "n_repos")))).alias(counted)).withColumnRenamed("rid", rid)
    known = some.join(held, rid)

    def labelled(span: Column, n: Column) -> Column:
        kind = (F.when((n["n_owners"] >= min_owners) | (n["n_repos"] >= min_repos), "example").when(span["random"], "live").otherwise("weak"))
        return F.struct(*[span[f].alias(f) for f in SPAN.names], n["n_owners"].alias("n_owners"), n["n_repos"].alias("n_repos"),
                        kind.alias("class"))

    labels = F.transform(F.col(out), lambda s: labelled(s, F.element_at(F.col(counted), s["value_hash"])))
    empty = F.array().cast(T.ArrayType(T.StructType([*SPAN.fields, T.StructField("n_owners", T.LongType()),
                                                     T.StructField("n_repos", T.LongType()), T.StructField("class", T.StringType())])))
    rest = [F.col(quoted(c)) for c in cols if c != out]
    return known.select(*rest, labels.alias(out)).unionByName(none.select(*rest, empty.alias(out)))


def redact(classified: DataFrame, text_col: str = "text", out: str = "secrets", mark: str = "<secret>") -> DataFrame:
    """Replace the values of live spans in ``text_col`` by ``mark``; examples and weak values stay."""
    small_batches(classified.sparkSession)

    @F.arrow_udf(T.StringType())
    def cleaned(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, live in batches:
            done = []
            for text, spans in zip(texts.to_pylist(), live.to_pylist(), strict=True):
                if spans:
                    parts, at = [], 0
                    for a, b in sorted((s["value_start"], s["value_end"]) for s in spans):
                        if a >= at:
                            parts += [text[at:a], mark]
                        at = max(at, b)
                    text = "".join(parts) + text[at:]
                done.append(text)
            yield pa.array(done, pa.string())

    live = F.filter(F.col(out), lambda s: s["class"] == "live")
    return classified.withColumn(text_col, cleaned(F.col(quoted(text_col)), F.transform(
        live, lambda s: F.struct(s["value_start"].alias("value_start"), s["value_end"].alias("value_end")))))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


# ---- registered query -------------------------------------------------------

def query(spark, sf_dir: str) -> DataFrame:
    """Secrets of every whole text: base counts and digest, all spans, how many are live or copied examples, and the
    owners and repositories of each span's value (in the order of ``spans``).

    Owners are the sources; a repository is a source's part in one language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    scanned = cut_lineage(scan(docs).drop("text").withColumn("rid", F.monotonically_increasing_id()))
    d = classify(scanned, "rid", F.col("source"), F.concat_ws("/", F.col("source"), F.col("lang")))
    s = F.col("secrets")

    def n(field: str, value: str) -> Column:
        return F.size(F.filter(s, lambda x: x[field] == value)).cast("long")

    def counts(field: str) -> Column:
        return F.array_join(F.transform(s, lambda x: x[field].cast("string")), ",")

    base = F.filter(s, lambda x: x["kind"].isin(*BASE))
    return d.select("doc_id", n("kind", "assign").alias("n_assign"), n("kind", "access").alias("n_access"), n("kind", "hex").alias("n_hex"),
                    F.sha2(joined(base), 256).alias("base_sha256"), joined(s).alias("spans"),
                    n("class", "live").alias("n_live"), n("class", "example").alias("n_example"), n("class", "weak").alias("n_weak"),
                    counts("n_owners").alias("n_owners"), counts("n_repos").alias("n_repos"))
