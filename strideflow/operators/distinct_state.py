"""Exact distinct counts that merge (A2, G6, G10): bit maps over dense numbers.

Ids get small dense numbers once; a group's ids are then bits, 32,768 to a
map.  The maps of several batches merge by OR, so the games of a player, or
the players of a game, are counted after an append without reading what was
there before but its maps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LANES = 64  # ids are numbered side by side in so many lanes, never in one task


def numbered(ids: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """(column, number): ``known`` numbers stay, new ids get the next ones of
    their lane.  Numbers are unique, and dense up to the lanes' difference in
    length.  Null ids have none."""
    lane = F.pmod(F.xxhash64(column), F.lit(LANES))
    new = ids.select(column).filter(F.col(column).isNotNull()).distinct()
    if known is not None:
        new = new.join(known, column, "left_anti")
    order = Window.partitionBy("_lane").orderBy(column)
    new = new.withColumn("_lane", lane).withColumn("_row", F.row_number().over(order).cast("long") - 1)
    if known is None:
        return new.select(column, (F.col("_row") * LANES + F.col("_lane")).alias("number"))
    used = known.groupBy(lane.alias("_lane")).agg((F.floor(F.max("number") / LANES) + 1).alias("_used"))
    new = new.join(used, "_lane", "left")
    return known.unionByName(new.select(column, ((F.col("_row") + F.coalesce("_used", F.lit(0))) * LANES + F.col("_lane")).alias("number")))


def bitmaps(rows: DataFrame, group: str, column: str, numbers: DataFrame) -> DataFrame:
    """(group, bucket, bits): the state of one batch."""
    at = F.col("number") + 1
    pairs = rows.select(group, column).join(numbers, column)
    return pairs.groupBy(group, F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def merged(states: list[DataFrame], group: str) -> DataFrame:
    return reduce(DataFrame.unionByName, states).groupBy(group, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_counts(state: DataFrame, group: str, name: str) -> DataFrame:
    return state.groupBy(group).agg(F.sum(F.bitmap_count("bits")).alias(name))


def counts_by_batches(batches: list[DataFrame], group: str, column: str, name: str, stage) -> DataFrame:
    """Distinct ``column`` per ``group`` over batches, each read once: its
    numbers and bit maps are stored by ``stage(df, name)``."""
    numbers, states = None, []
    for rows in batches:
        numbers = stage(numbered(rows, column, numbers), f"{column}_numbers")
        states.append(stage(bitmaps(rows, group, column, numbers), f"{group}_bitmaps"))
    return distinct_counts(merged(states, group), group, name)
