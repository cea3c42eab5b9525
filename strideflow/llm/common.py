"""Helpers shared by the operators: table access, stage tables in the shared
checkpoint folder, and vectorised hashing over Arrow text buffers."""

from __future__ import annotations

import contextlib
import ctypes
import re
import sys
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 20  # text handled at once by the vectorised code (one longer text is a slice of its own)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).  Only a local
    master may go without one and gets a scratch folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="llm-stages-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the
    lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-stages/{uuid.uuid4().hex}/{name}"
    schema = df.schema
    df.write.mode("error").parquet(path)
    return spark.read.schema(schema).parquet(path)


def process_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker process."""
    mod = sys.modules.setdefault("_llm_process_cache", types.ModuleType("_llm_process_cache"))
    return mod.__dict__.setdefault(name, {})


def text_slices(column: pa.Array, max_bytes: int = SLICE_BYTES, max_rows: int = 1 << 20):
    """Yield ``(first_row, last_row, bytes, offsets)`` over a string column;
    null counts as empty.  ``offsets`` has one entry more than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + max_bytes, side="right")) - 1)
        j = min(j, i + max_rows, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def task(run):
    """A task that at its end gives its worker's free memory back: workers
    live on for other tasks."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return whole


def mix64(z: np.ndarray) -> np.ndarray:
    """Finalizer of the public splitmix64 generator."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def stream64(n: int, seed: int) -> np.ndarray:
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * np.uint64(0x9E3779B97F4A7C15))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n, kept in the worker."""
    cache = process_cache("powers")
    if cache.get("n", 0) < n:
        n = max(n, SLICE_BYTES + (1 << 16))
        base = 0xD1342543DE82EF95
        for key, p in (("p", base), ("q", pow(base, -1, 1 << 64))):
            x = np.full(n, p, dtype=np.uint64)
            x[0] = 1
            cache[key] = np.multiply.accumulate(x)
        cache["n"] = n
    return cache["p"][:n], cache["q"][:n]


_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
IS_WORD = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
BYTE_KEYS = stream64(256, 7)
GRAM_KEYS = stream64(64, 11) | np.uint64(1)


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a slice, A-Z lowered, in text order, and
    the row of each.  A word is a run of 0-9, a-z and non-ASCII characters."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = LOWER[data]
    inside = IS_WORD[low]
    edge = np.zeros(len(data) + 1, dtype=bool)  # a text begins here
    edge[offs] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    p, q = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_KEYS[low] * p[: len(data)], out=total[1:])
    h = mix64((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(offs, starts, side="right") - 1


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive words from each position (len(h)-k+1)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += h[j : j + n] * GRAM_KEYS[j]
    return mix64(out + np.uint64(k))
