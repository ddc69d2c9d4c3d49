"""What several operators of this subpackage share: tables, shared folders and cutting lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of this machine by application, for local sessions alone; they go with the process.
_local: dict[str, tempfile.TemporaryDirectory] = {}
#: Working tables that a block of scratch() has made so far, by block.
_made: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the cluster's spark.checkpoint.dir. Only where it is unset and the session is local is a
    folder of this machine taken; RuntimeError on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that the driver and the executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.TemporaryDirectory(prefix="spanloom-")
    return _local[app].name


def fresh_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    for block in _made[-1:]:
        block.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one, wherever that is stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the working tables that are made within it when it ends; what is to stay must be written out by then."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            remove(spark, path)


def settled(df: DataFrame, what: str, instead: tuple[DataFrame, ...] = ()) -> DataFrame:
    """df as a table written to the shared folder and read again: later jobs neither recompute it nor depend
    on any executor. instead: settled tables that nothing needs any more once it is written; they are deleted."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    for gone in [_PATHS.pop(old, None) for old in instead]:
        if gone is not None:
            remove(spark, gone)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


#: Where settled tables are, as long as someone holds them.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def row_key(id_col: str, text_col: str) -> Column:
    """Two longs that stand for a row's id and text; rows with equal keys are copies of one row."""
    return F.struct(
        F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col)).alias("a"),
        F.xxhash64(F.lit(2), F.col(text_col), F.col(id_col)).alias("b"),
    )


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as make it no column of df."""
    while name in df.columns:
        name = f"_{name}"
    return name


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; it reads no more than that many."""
    return df.limit(rows + 1).count() <= rows


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has at most so many rows."""
    return F.broadcast(df) if small_enough(df, rows) else df


#: Rows and bytes of a batch that goes to Python or comes from it. Workers and executors hold a few batches at a time, so their
#: memory is bounded whatever the texts' lengths.
BATCH_ROWS, BATCH_BYTES = 1_000, "2m"


def small_batches(df: DataFrame) -> DataFrame:
    """df, after telling its session to send batches of that size; results don't depend on it."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def exploded(df: DataFrame, array: Column, name: str, *columns: Column | str) -> DataFrame:
    """columns, and a row for each element of array that isn't null. The generator is an outer one: for an inner one the planner
    adds a filter by the array's size, and so works the array out twice."""
    return df.select(*columns, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())
