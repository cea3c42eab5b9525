"""Runs at all slider thresholds from one pass over the frames.

The frame sets of rising thresholds are nested: a frame has a *level*, the
number of thresholds that its speed reaches, and it lies in a run at each
level up to its own.  One window per frame chunk follows all levels together:
the last frame seen at each level tells whether a frame begins a run there.
Only then is a frame repeated for its levels, in the partitioning of the
window, and reduced to run pieces at once.  So the frames are scanned, shuffled
and sorted once, whatever the number of thresholds, and the runs equal those of
a tagging and extraction for each threshold, the duration gate included.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideflow.operators.frames import CHUNK_KEYS, drop_ball, relative_threshold, with_chunks
from strideflow.operators.runs import PIECE_KEYS, _flagged_projection, piece_measures, runs_from_pieces
from strideflow.params import PROD, SWEEP_THRESHOLDS, EffortParams


def sweep_pieces(speeds: DataFrame, vmax: DataFrame, thresholds: Sequence[float] = SWEEP_THRESHOLDS, params: EffortParams = PROD) -> DataFrame:
    """Run pieces for every threshold, ``level`` counting from 1 for the
    lowest; reads the frames once.  Players of low confidence have none."""
    keys = ["player_id", "game_id"] if "game_id" in vmax.columns else ["player_id"]
    rising = sorted(thresholds)
    limits = [relative_threshold(F.col("vmax_kmh"), params.with_(threshold_pct=t)) for t in rising]
    trusted = vmax.filter(~F.col("low_confidence")).select(*keys, "vmax_kmh", F.array(*limits).alias("_limits"))
    timed = drop_ball(speeds).filter(F.col("speed_kmh").isNotNull()).join(trusted, keys)
    level = F.aggregate("_limits", F.lit(0), lambda n, t: n + (F.col("speed_kmh").cast("double") >= t).cast("int"))
    flagged = _flagged_projection(timed.withColumn("_level", level).filter("_level > 0"), True, "_level")

    chunked = with_chunks(flagged, params.chunk_frames)
    w = Window.partitionBy(*CHUNK_KEYS).orderBy("frame_id", F.col("_carry").desc(), "timestamp")
    before, until = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = range(1, len(rising) + 1)
    last = {f"_last{k}": F.max(F.when(F.col("_level") >= k, F.col("frame_id"))).over(before) for k in levels}
    begins = {
        f"_start{k}": (~F.col("_carry") & (F.col("_level") >= k) & (F.col(f"_last{k}").isNull() | (F.col("frame_id") - F.col(f"_last{k}") > 1))).cast("long")
        for k in levels
    }
    local = {f"_local{k}": F.sum(f"_start{k}").over(until) for k in levels}
    nested = F.array(*[F.struct(F.lit(k).alias("level"), F.col(f"_local{k}").alias("_local")) for k in levels])
    each = chunked.withColumns(last).withColumns(begins).withColumns(local).filter(~F.col("_carry"))
    each = each.withColumn("_at", F.explode(F.slice(nested, 1, F.col("_level")))).withColumns({"level": F.col("_at.level"), "_local": F.col("_at._local")})
    return each.groupBy("_part", *PIECE_KEYS, "level").agg(*piece_measures()).drop("_part")


def sweep_runs(pieces: DataFrame, thresholds: Sequence[float] = SWEEP_THRESHOLDS, params: EffortParams = PROD) -> DataFrame:
    """R1 rows at every threshold, with ``threshold_pct``, from
    ``sweep_pieces``."""
    keyed = pieces.withColumn("player_id", F.concat_ws("|", "level", "player_id")).drop("level")
    runs = runs_from_pieces(keyed, params, relative=True)
    part = F.split("player_id", r"\|", 2)
    steps = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
    return runs.withColumns({"threshold_pct": F.element_at(steps, part[0].cast("int")), "player_id": part[1]})
