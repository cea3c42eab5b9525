"""Exact dedup as a tree merge of sorted digest runs, in DataFrame operations
only.

The tasks that hash the rows are the leaves: each reduces its rows to a run,
one entry a digest, sorted by digest.  In each round ``fan`` neighbouring runs
exchange their entries and are merged into one sorted run that keeps the
smallest identifier of a digest, until one run is left; the number of rounds
follows the number of tasks.  A run is spread over tasks by digest, so none
holds a whole one.  The winners then go back down the same tree.  Every
exchange is keyed by (run, digest): a digest that holds a third of all rows
meets itself once a leaf, then in groups of at most ``fan`` entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

FAN = 8  # runs merged at once, at least: three binomial rounds in one
ROUNDS = 3  # beyond FAN ** ROUNDS leaves more runs are merged at once instead
SPACES = "[\\x20\\x09-\\x0D]+"
KEYS = ("run", "digest", "check")


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def fan_for(runs: int, least: int = FAN, rounds: int = ROUNDS) -> int:
    """Smallest fan from ``least`` on that leaves one run after ``rounds``."""
    fan = least
    while fan**rounds < runs:
        fan += 1
    return fan


def _merge(entries: DataFrame, fan: int = 1) -> DataFrame:
    """The sorted runs of the next round: ``fan`` neighbours become one."""
    up = entries.withColumn("run", F.floor(F.col("run") / fan).cast("int"))
    return up.groupBy(*KEYS).agg(F.min("best").alias("best"), F.sum("n").alias("n")).sortWithinPartitions(*KEYS)


def resolve(rows: DataFrame, runs: int, fan: int | None = None) -> DataFrame:
    """``rows`` (run, digest, check, best, ...) with the winner ``keep`` and
    ``group_size`` of the row's digest.  ``best`` orders the candidates."""
    fan = fan or fan_for(runs)
    levels = [stage(_merge(rows.withColumn("n", F.lit(1))), "run_0")]
    while runs > 1:
        runs = -(-runs // fan)
        merged = _merge(levels[-1], fan)
        levels.append(stage(merged, f"run_{len(levels)}") if runs > 1 else merged)
    top = levels.pop().select(*KEYS, F.col("best").alias("keep"), F.col("n").alias("group_size"))
    for entries in reversed(levels):
        up = entries.select("digest", "check", F.col("run").alias("own"), F.floor(F.col("run") / fan).cast("int").alias("run"))
        top = up.join(top, list(KEYS)).select(F.col("own").alias("run"), "digest", "check", "keep", "group_size")
    return rows.join(top, list(KEYS))


def _digest(norm: F.Column) -> list[F.Column]:
    return [F.unhex(F.sha2(norm, 256)).alias("digest"), F.xxhash64(norm).alias("check")]


def _leaves(rows: DataFrame, task: str) -> int:
    """How many tasks hashed the rows."""
    last = rows.agg(F.max(task)).head()[0]
    return 1 if last is None else last + 1


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("best", F.struct(F.col("__id").isNull().alias("no_id"), F.col("__id").alias("id"), F.col("place")))


def exact_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", runs: int | None = None, fan: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after every run of white space becomes one
    space (SHA-256 and a second 64-bit hash of the whole normalised text both
    agree).  Null text counts as empty; empty texts are one group.  The
    smallest id stays, a null id after all others; of rows with the same id
    and text exactly one is kept.  Other columns are ignored.  ``runs`` is the
    number of leaves, by default one for each task that hashed rows.
    """
    hashed = docs.select(F.col(doc_id).alias("__id"), normalised(F.col(text)).alias("__norm")).select(
        "__id", *_digest(F.col("__norm")), F.monotonically_increasing_id().alias("place")
    )
    task = F.shiftright("place", 33).cast("int")  # the task's number stands above the row's
    hashed = stage(hashed, "digests").withColumn("task", task)
    runs = runs or _leaves(hashed, "task")
    rows = _ranked(hashed.withColumn("run", F.pmod("task", F.lit(runs))))
    return resolve(rows, runs, fan).select(
        F.col("__id").alias(doc_id),
        F.col("keep.id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("keep.place") == F.col("place")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", runs: int | None = None, fan: int | None = None) -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, whole.  Rows with
    the same id and text differ in other columns at most: the first in column
    order stays.  A row's run follows from its columns, so that it is the same
    in both readings of ``docs``."""
    rest = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    best = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), rest.alias("place"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # so that no name can clash
    own = docs.select(whole.alias("doc"), normalised(F.col(text)).alias("norm"), best.alias("best")).select("doc", *_digest(F.col("norm")), "best")
    hashed = stage(own.select("digest", "check", "best", F.spark_partition_id().alias("task")), "digests")
    runs = runs or _leaves(hashed, "task")
    run = F.pmod("best.place", F.lit(runs)).cast("int")
    keys = [*KEYS, "best"]
    winners = resolve(hashed.withColumn("run", run).select(*keys), runs, fan).filter("best <=> keep").groupBy(*keys).agg(F.count("*").alias("copies"))
    kept = own.withColumn("run", run).join(winners.withColumnRenamed("best", "kept"), list(KEYS)).filter("best <=> kept")
    # rows equal in every column but the text's white space: only these are grouped
    once = kept.filter("copies = 1").select("doc.*")
    return once.unionByName(kept.filter("copies > 1").dropDuplicates(keys).select("doc.*"))
