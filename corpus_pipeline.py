"""Corpus preparation: quality, near-duplicates, benchmark leaks, secrets, token ids.

Each stage takes the documents that its predecessor kept.  ``run`` writes a
stage's result as Parquet into the shared folder and reads it again for the
next one, so a lost executor never sends a job back before the last stage.

1. quality classifier: documents with P(rating >= 1) under one half go
2. SimHash near-dedup: the document with the smallest id of each component stays
3. benchmark decontamination: documents that hold a benchmark item go
4. secret scans: live-looking values of few owners are replaced by ``<secret>``
   (n_chars follows); widely copied examples stay, and so do all documents
5. byte-level BPE: token ids of each document, decoded again for the digest

Edge cases: null and empty texts are rated and compared as texts without words
(and encode to no ids); rows without an id are compared by their text, and of near
copies one with an id stays first; repeated rows are one group of copies; very long
texts are read whole by every stage; with no labelled row the first stage keeps everything
and an empty benchmark matches nothing; an empty table stays empty; extra columns
pass through the stages up to the fourth, also those with the names of working
columns.

SQL can express none of the stages 1, 2 and 5, so there is no SQL twin; the
tests compare the rows with a brute-force run.
"""

from __future__ import annotations

import public_tokenizers as P
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_spark.llm import byte_bpe, decontamination, quality_classifier, secret_scan, simhash
from retail_spark.llm.text_udf import fresh, quoted
from retail_spark.session import shared_path

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, takes for good ones."""
    ratings = quality_classifier.ratings_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.select(docs, quality_classifier.fit(docs, ratings, 3))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints within four bits."""
    return simhash.one_of_each(docs, shingle=4, max_bits=4)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontamination.clean(docs, found)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking secrets redacted."""
    spans, rid = fresh(docs, "secrets"), fresh(docs, "row")
    path = shared_path(spark, "scanned")
    secret_scan.scan(docs, out=spans).withColumn(rid, F.monotonically_increasing_id()).write.parquet(path)
    known = secret_scan.classify(spark.read.parquet(path), rid, F.col("source"), F.concat_ws("/", "source", "lang"), out=spans)
    live = F.exists(F.col(spans), lambda s: s["class"] == "live")
    done = secret_scan.redact(known.filter(live), out=spans).withColumn("n_chars", F.length("text").cast("long"))
    cols = [F.col(quoted(c)) for c in docs.columns]
    return done.select(*cols).unionByName(known.filter(~live).select(*cols))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document with the digests of the ids and of what they decode to."""
    coded = byte_bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    return coded.select("doc_id", "lang", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256", "ids")


STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secrets_stage),
    ("byte_level_bpe", encode_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
