"""Helpers shared by the operators that run Python over whole texts in Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch.  Texts can be very long, so batches stay small; the setting only ever goes down.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once (``spark.sql.execution.arrow.maxRecordsPerBatch``)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use (Spark compares names without case)."""
    used = {c.lower() for c in df.columns}
    name, n = f"_{stem}", 0
    while name in used:
        n += 1
        name = f"_{stem}{n}"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names, so that outputs may take them."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
