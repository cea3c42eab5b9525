"""Table sinks and sources (S6-S11): partitioned and plain writes, write
mode switch, table reads, CSV export and CSV scan with optional files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideflow.session import delete_folder


def write_mode(overwrite: bool) -> str:
    """S8."""
    return "overwrite" if overwrite else "append"


ROW_GROUP_BYTES = 8 << 20  # of clustered files
FILE_FORMATS = ("parquet", "orc", "json", "csv", "avro")


def _replace(spark: SparkSession, writer: DataFrameWriter, path: str) -> None:
    """Write beside ``path``, then put the new folder in its place."""
    base, mark = path.rstrip("/"), uuid.uuid4().hex
    new, old = f"{base}.new-{mark}", f"{base}.old-{mark}"
    try:
        writer.mode("error").save(new)
    except Exception:
        delete_folder(spark, new)
        raise
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(hadoop(base))
    if had and not fs.rename(hadoop(base), hadoop(old)):
        raise OSError(f"cannot move {base}")
    if not fs.rename(hadoop(new), hadoop(base)):
        raise OSError(f"cannot move {new}")
    if had:
        delete_folder(spark, old)


def write_table(
    df: DataFrame,
    path: str,
    *,
    overwrite: bool = True,
    partition_by: list[str] | None = None,
    only: list[str] | None = None,
    cluster_by: list[str] | None = None,
    fmt: str = "parquet",
) -> None:
    """Write a table.  An overwrite replaces all of it: the new table
    is written beside the old one and takes its place when it is whole, so a
    job that stops half way leaves the old table as it was (formats with their
    own commits, such as Delta, overwrite in place).

    ``only`` reloads the listed values of a single partition column: their
    partitions are replaced, or removed if ``df`` has no rows of them, and all
    others stay.  Rows are rebalanced on the partition columns first, so small
    partitions share a task and a large one is split over several.

    ``cluster_by`` sorts each file by columns and keeps its row groups small,
    so that a filter on them (one player's frames) skips most of every file by
    the row groups' and pages' statistics.
    """
    out = df.hint("rebalance", *partition_by) if partition_by else df
    options = {}
    if cluster_by:
        out = out.sortWithinPartitions(*(partition_by or []), *cluster_by)
        options = {"parquet.block.size": ROW_GROUP_BYTES}
    if only is None:
        w = out.write.format(fmt).options(**options).option("partitionOverwriteMode", "static")
        if partition_by:
            w = w.partitionBy(*partition_by)
        if overwrite and fmt in FILE_FORMATS:
            _replace(df.sparkSession, w, path)
        else:
            w.mode(write_mode(overwrite)).save(path)
        return
    (key,) = partition_by
    kept = out.filter(F.col(key).cast("string").isin(only))
    kept.write.format(fmt).options(**options).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).save(path)
    there = {str(r[0]) for r in df.select(key).filter(F.col(key).cast("string").isin(only)).distinct().collect()}  # of the list
    for value in set(only) - there:
        delete_folder(df.sparkSession, f"{path.rstrip('/')}/{key}={value}")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """Load a table.  Partition values are kept as strings (no type
    inference), so a ``game_id`` folder like ``0042`` stays "0042"."""
    key = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        r = spark.read.format(fmt)
        if schema is not None:
            r = r.schema(schema)
        return r.load(path)
    finally:
        spark.conf.set(key, before)


def export_csv(df: DataFrame, path: str, order_by: list[str] | None = None, single_file: bool = False) -> None:
    """CSV with a header, written by all tasks (a sorted export is
    range-partitioned, so the parts are in order).  ``single_file`` gives the
    one file of a small table; it takes one task, so the caller asks for it."""
    out = df.orderBy(*order_by) if order_by else df
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").option("header", "true").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, optional: bool = False) -> DataFrame:
    """CSV with header and explicit schema; an absent optional file
    gives an empty table with that schema."""
    try:
        return spark.read.schema(schema).option("header", "true").csv(path)
    except Exception as e:  # noqa: BLE001
        if optional and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
