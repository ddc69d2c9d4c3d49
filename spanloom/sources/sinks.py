"""Sinks: Markdown, mappings, logs by month, and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.analytics import month_of

LOG_SCHEMA = "id long, ts timestamp, action string, entity_type string, source string, confidence double, text string, document long"


def out_name(name):
    """The name of a rewritten file: its folder and ending are dropped."""
    return F.concat(F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"\.[^.]*$", ""), F.lit("-anon.md"))


def write_markdown(rows: DataFrame, path: str, text_col: str = "rewritten") -> None:
    """One text a row, as text files; a text's own line ends stay within it, a form feed ends it."""
    rows.select(F.col(text_col).alias("value")).write.mode("overwrite").option("lineSep", "\f").text(path)


def write_mappings(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    rows.write.mode("overwrite").json(path)


def append_log(log: DataFrame, path: str) -> None:
    """Rows of a log, appended to the folder of their month."""
    log.withColumn("month", month_of(F.col("ts"))).write.mode("append").partitionBy("month").parquet(path)


def read_log(spark: SparkSession, path: str, months: list[str] | None = None) -> DataFrame:
    """The log, or some of its months: other months' folders aren't read."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("month").isin(*months)) if months else rows


def read_log_json(spark: SparkSession, path: str) -> DataFrame:
    """Entries of correction files, each a JSON object with a list of entries; broken files give no rows, and keys of prototypes are dropped."""
    entry = "id string, timestamp string, action string, entityType string, originalSource string, confidence double, context string, documentHash string"
    schema = f"version string, month string, entries array<struct<{entry.replace(' string', ':string').replace(' double', ':double')}>>, _corrupt string"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = rows.where("_corrupt is null").select("month", F.explode("entries").alias("e")).select("month", "e.*")
    return rows.withColumn("ts", F.col("timestamp").try_cast("timestamp")).where(F.col("action").isin("DISMISS", "ADD") & F.col("ts").isNotNull()).drop("timestamp")


def summary_csv(summary: DataFrame) -> DataFrame:
    """(line): a one-row summary as lines of name and value."""
    pairs = F.array(*[F.concat(F.lit(f"{c},"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in summary.columns])
    return summary.select(F.explode(pairs).alias("line"))
