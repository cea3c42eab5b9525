"""Session helpers: a local session for tests/bench and the shared
checkpoint folder used to cut lineage in the batch job."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "strideflow") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder for stage tables and checkpoints.

    ``spark.checkpoint.dir`` (or a folder set on the context) is used as is.
    Only with a local master may it be unset; then a fresh scratch folder is
    taken.  On a cluster each executor would write to its own disk.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="strideflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a
    DataFrame reading it back.

    This is the stage boundary of the medallion job: the written table cuts
    the lineage (a lost executor re-reads files instead of recomputing the
    frame windows), and reads of it get column pruning, filter pushdown and
    real size statistics for the planner's broadcast decisions.
    """
    return df.sparkSession.read.schema(df.schema).parquet(store_stage(df, name, partition_by))


def store_stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> str:
    """Write a stage table and return its path."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/strideflow-tables/{uuid.uuid4().hex}/{name}"
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


FILE_BYTES = 4 << 20  # of Parquet input a partition of a shuffle of all its rows: some 100 MB to sort


def input_bytes(df: DataFrame) -> int:
    """Size of the files that ``df`` reads, 0 if it reads none."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in df.inputFiles()]
    return sum(at.getFileSystem(conf).getFileStatus(at).getLen() for at in paths)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` partitioned by ``keys`` into as many parts as its input files
    ask for, so a task's rows stay as few as they are however large the input
    is and are sorted in memory.  The session's number of shuffle partitions is
    fixed, and AQE merges them by compressed size.  A small input, or one not
    in files, is left to these."""
    parts = -(-input_bytes(df) // FILE_BYTES)
    return df.repartition(parts, *keys) if parts > df.sparkSession.sparkContext.defaultParallelism else df.repartition(*keys)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of ours in whatever file system it lies; absent is fine."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_stages(*tables: DataFrame) -> None:
    """Remove the folders of stage tables; other DataFrames are left alone."""
    for df in tables:
        for folder in {f.rsplit("/", 2)[0] for f in df.inputFiles() if "/strideflow-tables/" in f}:
            delete_folder(df.sparkSession, folder)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
