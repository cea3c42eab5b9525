"""Token counts as delta-maintained rollups.

A rollup is a folder of committed batches.  A batch holds signed changes:
inserted documents count +1, deleted ones -1, and a document whose count was
revised gives its old row with -1 and its new row with +1.  Changes are
summed by source, language and tokenizer version before they are stored, and
the totals are the sum over all committed batches, so a batch costs its own
size only.  Every attempt at a batch writes a folder of its own; the batch is
there once its marker, a small file named by its identifier that tells the
attempt, has been renamed into place, never over another.  So committing a
batch again changes nothing, and of two writers of one batch one counts.  The
file system has to rename a file in one step, as HDFS does.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import task

from .tokens import encode_column

KEYS = ("source", "lang", "version")
_TOTALS = "source string, lang string, version string, documents bigint, tokens bigint, characters bigint"


def _count(text: str, path: str):
    @task
    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            n = []
            for _, _, _, offs in encode_column(column, path, added=True):
                n += (offs[1:] - offs[:-1]).tolist()
            keep = [c for c in batch.schema.names if c != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(n, pa.int64())], names=[*keep, "tokens"])

    return run


def counted(docs: DataFrame, tokenizer: str, version: str, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """(doc_id, source, lang, version, tokens, characters) of every row.
    Null text counts as empty; null source or language is a group of its own;
    other columns are ignored."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("characters"), F.col(text).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    out = base.mapInArrow(_count("text", tokenizer), f"doc_id {kind}, source string, lang string, characters bigint, tokens bigint")
    return out.select("doc_id", "source", "lang", F.lit(version).alias("version"), "tokens", "characters")


def inserts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sign", F.lit(1))


def deletes(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sign", F.lit(-1))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed changes from one ledger of counted rows to another: rows that
    are equal in both cancel, whatever the number of repeats."""
    names = ["doc_id", *KEYS, "tokens", "characters"]
    both = inserts(after.select(*names)).unionByName(deletes(before.select(*names)))
    return both.groupBy(*names).agg(F.sum("sign").cast("int").alias("sign")).filter("sign <> 0")


class Rollup:
    """Totals by source, language and tokenizer version under ``path``, a
    folder that all executors share.  No batches give no rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _marker(self, batch: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch) or batch.startswith((".", "_")):
            raise ValueError(f"not a batch name: {batch!r}")
        return f"{self.path}/commits/{batch}"

    def _hadoop(self, path: str):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        return jvm, at.getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf), at

    def committed(self) -> list[str]:
        _, fs, _, at = self._hadoop(f"{self.path}/commits")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _attempts(self) -> list[str]:
        """The folders of the committed batches."""
        markers = [self._marker(b) for b in self.committed()]
        return [f"{self.path}/attempts/{r[0]}" for r in self.spark.read.text(markers).collect()] if markers else []

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Store a batch of signed rows.  False, and no effect, if a batch of
        that name is already there."""
        jvm, fs, context, marker = self._hadoop(self._marker(batch))
        if fs.exists(marker):
            return False
        sums = [F.sum(F.col("sign") * x).cast("long").alias(name) for x, name in ((F.lit(1), "documents"), (F.col("tokens"), "tokens"), (F.col("characters"), "characters"))]
        attempt = f"{batch}-{uuid.uuid4().hex}"
        changes.groupBy(*KEYS).agg(*sums).write.mode("error").parquet(f"{self.path}/attempts/{attempt}")
        pending = self._hadoop(f"{self.path}/pending/{attempt}")[3]
        out = fs.create(pending, False)
        out.write(bytearray(attempt.encode()))
        out.close()
        fs.mkdirs(marker.getParent())
        never_over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(pending, marker, never_over)
        except Py4JJavaError:
            if fs.exists(marker):  # another writer was first
                return False
            raise
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, documents, tokens, characters; groups that
        have come down to nothing are left out."""
        paths = self._attempts()
        if not paths:
            return self.spark.createDataFrame([], _TOTALS)
        rows = self.spark.read.schema(_TOTALS).parquet(*paths)
        sums = rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("documents", "tokens", "characters")])
        return sums.filter("documents <> 0 or tokens <> 0 or characters <> 0")
