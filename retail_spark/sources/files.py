"""File sources and sinks, schema checks, audits and coercion
(SRC1–SRC7, SNK1–SNK4).

Readers always take an explicit schema (no inference pass over the data);
writers go to a caller-named path — on a cluster a shared folder, never a
machine-local one.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


def read_lines(spark: SparkSession, path: str, schema: StructType | str, sep: str = "|") -> DataFrame:
    """Pipe-separated text with a header row and a fixed schema (SRC1)."""
    return (spark.read.option("sep", sep).option("header", True)
            .option("timestampNTZFormat", TS_FORMAT).option("dateFormat", "yyyy-MM-dd")
            .schema(schema).csv(path))


def read_csv(spark: SparkSession, path: str, schema: StructType | str, date_cols: Sequence[str] = (),
             fmt: str = "yyyy-MM-dd") -> DataFrame:
    """Comma CSV read as text where needed, dates parsed; bad dates → NULL (SRC2)."""
    df = spark.read.option("header", True).schema(schema).csv(path)
    for c in date_cols:
        df = df.withColumn(c, F.try_to_timestamp(F.col(c), F.lit(fmt)).cast("date"))
    return df


def read_json(spark: SparkSession, path: str, schema: StructType | str, multiline: bool = False) -> DataFrame:
    """JSON documents or JSON lines with a fixed schema (SRC3)."""
    return spark.read.option("multiLine", multiline).schema(schema).json(path)


def read_table(spark: SparkSession, name: str, sql: str | None = None) -> DataFrame:
    """A registered table or view, optionally through SQL text (SRC4)."""
    return spark.sql(sql) if sql else spark.table(name)


class MissingColumns(ValueError):
    pass


def require_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Fail fast when required columns are absent (SRC5)."""
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise MissingColumns(f"missing required columns: {missing}")
    return df


def audit(df: DataFrame) -> DataFrame:
    """Rows, duplicate rows and NULL count per column, long form (SRC6).
    One aggregate pass for the counts, one distinct for duplicates."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"_null_{i}") for i, c in enumerate(cols)])
    distinct_rows = df.distinct().agg(F.count(F.lit(1)).alias("_distinct"))
    pairs = ", ".join(f"'{c}', `_null_{i}`" for i, c in enumerate(cols))
    return (agg.crossJoin(distinct_rows)
            .select("_rows", (F.col("_rows") - F.col("_distinct")).alias("duplicate_rows"),
                    F.expr(f"stack({len(cols)}, {pairs}) AS (column_name, null_count)"))
            .withColumnRenamed("_rows", "rows"))


def coerce(df: DataFrame, numeric: Sequence[str] = (), timestamps: Sequence[str] = (),
           fmt: str = TS_FORMAT) -> DataFrame:
    """Text → number / timestamp; unparseable values become NULL (SRC7)."""
    for c in numeric:
        df = df.withColumn(c, F.col(c).cast("string").try_cast("double"))
    for c in timestamps:
        df = df.withColumn(c, F.try_to_timestamp(F.col(c).cast("string"), F.lit(fmt)))
    return df


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> str:
    """CSV with header (SNK1)."""
    (df.write.mode(mode).option("header", True).option("sep", sep)
     .option("timestampNTZFormat", TS_FORMAT).option("dateFormat", "yyyy-MM-dd").csv(path))
    return path


def append_table(df: DataFrame, path: str, bool_cols: Sequence[str] = ()) -> str:
    """Bulk append with 0/1 → boolean fix-up (SNK2)."""
    for c in bool_cols:
        df = df.withColumn(c, F.col(c).cast("int").cast("boolean"))
    df.write.mode("append").parquet(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """JSON lines of the rows (SNK3)."""
    df.write.mode(mode).option("timestampNTZFormat", TS_FORMAT).json(path)
    return path


def to_json_text(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as a JSON object string (SNK3)."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias(name))


def write_partitioned(df: DataFrame, path: str, by: str, mode: str = "overwrite") -> str:
    """One folder per value of ``by`` (SNK4)."""
    df.write.mode(mode).partitionBy(by).parquet(path)
    return path
