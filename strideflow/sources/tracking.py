"""Tracking sources: scan (S1), type normalisation (S2), game id from the
file name (S3) and a per-game reject report (S4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideflow.schema import TRACKING
from strideflow.session import materialize

# Fixed value: suffix of the vendor's per-game raw files.
RAW_SUFFIX = r"\.jsonl\.bz2$"


def scan_tracking(spark: SparkSession, path: str, schema: T.StructType = TRACKING) -> DataFrame:
    """Read a glob / folder of per-game Parquet files as one table with
    an explicit schema (no inference, column pruning and filter pushdown
    reach the files; a ``game_id`` partition folder is pruned by filters)."""
    return spark.read.schema(schema).parquet(path)


def normalise_tracking(df: DataFrame, ingested_at: str | None = None) -> DataFrame:
    """Duration or integer timestamp -> int64 ms; cast ids and
    coordinates; stamp ``_ingested_at`` (ISO string, current time if None)."""
    ts = df.schema["timestamp"].dataType if "timestamp" in df.columns else None
    if isinstance(ts, T.DayTimeIntervalType):
        ms = (F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.col("timestamp")) / 1000).cast("long")
    elif isinstance(ts, (T.TimestampType, T.TimestampNTZType)):
        ms = (F.unix_micros(F.col("timestamp").cast("timestamp")) / 1000).cast("long")
    else:
        ms = F.col("timestamp").cast("long")
    stamp = F.lit(ingested_at) if ingested_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return df.select(
        F.col("game_id").cast("string").alias("game_id"),
        F.col("frame_id").cast("long").alias("frame_id"),
        F.col("period_id").cast("int").alias("period_id"),
        ms.alias("timestamp"),
        F.col("ball_state").cast("string").alias("ball_state"),
        F.col("ball_owning_team_id").cast("string").alias("ball_owning_team_id"),
        F.col("team_id").cast("string").alias("team_id"),
        F.col("player_id").cast("string").alias("player_id"),
        F.col("x").cast("float").alias("x"),
        F.col("y").cast("float").alias("y"),
        F.col("z").cast("float").alias("z"),
        stamp.alias("_ingested_at"),
    )


def game_ids_from_files(spark: SparkSession, path: str) -> DataFrame:
    """S3: sorted distinct game ids taken from raw file names
    (``{game}.jsonl.bz2``): a ``binaryFile`` listing of which only the
    ``path`` column is read, so no file content is loaded."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path"))
    name = F.regexp_extract(F.col("path"), r"([^/]+)$", 1)
    return (
        files.select(F.regexp_replace(name, RAW_SUFFIX, "").alias("game_id"))
        .filter(F.col("game_id") != "")
        .distinct()
        .orderBy("game_id")
    )


_GAME = r"\.(jsonl|json)(\.bz2|\.gz)?$"


_UNREAD = "the file could not be read"
_PACKED = r"\.(bz2|gz)$"
_CODEC = r"\.(bz2|gz|deflate|lz4|snappy|zst|zstd)$"  # suffixes that the text reader unpacks
_BLOCK = 4 << 20  # unpacked text that a task holds at once


def _unpacked(batches):
    """(path, content) of compressed files -> their lines, or one row with the
    reason why a file does not unpack.  A file is tested to its end before its
    first line leaves, so a broken one gives no lines."""
    import bz2
    import gzip
    import io
    import zlib

    import pyarrow as pa

    def opened(path, content):
        return (bz2 if path.endswith(".bz2") else gzip).open(io.BytesIO(content))

    def rows(path, lines, error=None):
        cols = [pa.array([path] * len(lines), pa.string()), pa.array(lines, pa.string()), pa.array([error] * len(lines), pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=["path", "value", "file_error"])

    for batch in batches:
        for path, content in zip(*(batch.column(i) for i in (0, 1)), strict=True):
            path, content = path.as_py(), content.as_py()
            try:
                with opened(path, content) as f:
                    while f.read(_BLOCK):
                        pass
            except (OSError, EOFError, ValueError, zlib.error) as e:
                yield rows(path, [None], f"{type(e).__name__}: {e}")
                continue
            with opened(path, content) as f:
                while lines := f.readlines(_BLOCK):
                    yield rows(path, [x.rstrip(b"\r\n").decode("utf-8", "replace") for x in lines])


def _raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, value, size, file_error): the lines of all files, each file
    opened once.  ``size`` is the line's bytes in a plain file."""
    file_path = F.col("_metadata.file_path")

    def load(fmt, **options):
        return spark.read.format(fmt).options(recursiveFileLookup="true", ignoreCorruptFiles="true", **options).load(path)

    plain = load("text", lineSep="\n").filter(~file_path.rlike(_PACKED))
    # what other codecs unpack cannot be compared with the file's length
    size = F.when(~file_path.rlike(_CODEC), F.octet_length("value"))
    plain = plain.select(file_path.alias("path"), "value", size.alias("size"), F.lit(None).cast("string").alias("file_error"))
    packed = load("binaryFile").filter(file_path.rlike(_PACKED)).select(file_path.alias("path"), "content")
    lines = packed.mapInArrow(_unpacked, "path string, value string, file_error string")
    return plain.unionByName(lines.withColumn("size", F.lit(None).cast("int")))


def read_tracking_json(spark: SparkSession, path: str, schema: T.StructType = TRACKING) -> tuple[DataFrame, DataFrame]:
    """Read long-layout JSON lines so that one broken game never stops
    the others.  Returns (rows, rejects by file with the full path): rows that
    do not parse are rejected one by one; a file that cannot be read whole is
    rejected whole.

    Every file is opened once: its parsed lines go to a stage table in the
    shared folder, of which both outputs are made.  A file is whole if it
    unpacks to its end, or if the lines of a plain file have as many bytes as
    the listing says.  The list of broken files stays a table, whatever its
    length.
    """
    record = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType(), True)])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    blank = F.col("value").isNull() | (F.trim("value") == "")
    parsed = _raw_lines(spark, path).select("path", "size", "file_error", blank.alias("blank"), F.from_json(F.when(~blank, F.col("value")), record, options).alias("r"))
    lines = materialize(parsed, "raw_lines")
    wrong = F.col("r._corrupt_record")
    files = lines.groupBy("path").agg(
        (F.sum("size") + F.count("size")).alias("n"), F.max("file_error").alias("file_error"), F.count(wrong).alias("bad_rows"), F.min(wrong).alias("error")
    )
    listed = spark.read.format("binaryFile").options(recursiveFileLookup="true").load(path).select(F.col("_metadata.file_path").alias("path"), "length")  # opens no file
    lost = F.col("length") - F.coalesce("n", F.lit(0))
    short = F.concat(lost.cast("string"), F.lit(" of "), F.col("length").cast("string"), F.lit(" bytes could not be read"))
    seen = F.col("bad_rows").isNotNull()
    # the last line may have no end, and a byte order mark is no part of a line
    whole = F.when(F.col("path").rlike(_CODEC), F.when(~seen & (F.col("length") > 0) & F.col("path").rlike(_PACKED) & F.col("n").isNull(), F.lit(_UNREAD)).otherwise(F.col("file_error")))
    whole = F.coalesce(whole, F.when(~F.col("path").rlike(_CODEC) & ~lost.isin(-1, 0, 2, 3), short))
    state = materialize(listed.join(files, "path", "left").withColumn("whole", whole), "raw_files")  # a row a file
    broken = state.filter(F.col("whole").isNotNull())
    good = lines.filter(~F.col("blank") & F.col("file_error").isNull() & wrong.isNull()).join(broken.select("path"), "path", "left_anti").select("r.*").drop("_corrupt_record")
    name = F.url_decode(F.replace(F.regexp_extract("path", r"([^/]+)$", 1), F.lit("+"), F.lit("%2B")))
    rejects = state.filter(F.col("whole").isNotNull() | (F.col("bad_rows") > 0)).select(
        F.regexp_replace(name, _GAME, "").alias("game_id"),
        F.when(F.col("whole").isNull(), F.col("bad_rows")).alias("bad_rows"),
        F.coalesce("whole", "error").alias("error"),
        "path",
    )
    return good, rejects
